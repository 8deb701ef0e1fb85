"""Schemas of stored documents and where each entity keeps its keys in a path."""

from __future__ import annotations

SCORE = "struct<score:int,explain:string>"
SCORES = (
    f"struct<vocab:{SCORE},grammar:{SCORE},idiom:{SCORE},polite:{SCORE},context:{SCORE}>"
)
AUDIO = "struct<path:string,bucket:string>"
MESSAGE = (
    f"struct<role:string,body:string,created_at:timestamp,audio:{AUDIO},translation:string,"
    f"vocab:map<string,struct<bcp47:string,udefn:string,pos:string>>,grammar:string,"
    f"score:{SCORES}>"
)
STREAK = "struct<count:int,last:timestamp,tid:string>"
VOICE = "struct<bcp47:string,model:string,gender:int,type:string>"

# Body of a stored document by entity; keys come from the path.
DOCUMENTS = {
    "user": f"uid string, name string, language string, native_language string, "
    f"streak {STREAK}, created_at timestamp, base_version string",
    "transcript": f"uid string, tid string, aid string, atp string, pid string, bcp47 string, "
    f"created_at timestamp, status string, summary string, grade int, topics array<string>, "
    f"assessment string, feedback string, messages map<string,{MESSAGE}>, base_version string",
    "plan": f"uid string, pid string, aid string, atp string, bcp47 string, level string, "
    f"subtp string, state string, template map<string,string>, topic string, "
    f"vocab array<string>, voice {VOICE}, base_version string",
    "act": "aid string, atp string, bcp47 string, source string, created_at timestamp, "
    "prompt_id string, base_version string",
    "language": f"bcp47 string, voices array<{VOICE}>, base_version string",
}

# Keys that the path of an entity carries; they win over the body.
PATH_KEYS = {
    "user": ["uid"],
    "transcript": ["uid", "tid"],
    "plan": ["uid", "pid"],
    "vocab": ["uid", "bcp47"],
    "act": ["atp", "bcp47", "aid"],
    "language": ["bcp47"],
}

# Model requests and replies.
CHAT = "struct<role:string,content:string>"
CHOICE = "struct<index:int,finish_reason:string,role:string,content:string>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
COMPLETION = (
    f"request_id string, choices array<{CHOICE}>, usage {USAGE}, attempts int, error string"
)
