"""Requests, backends and parsing of replies."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convolytics.operators import backends as bk
from convolytics.operators import effects as fx
from convolytics.operators import requests as rq
from convolytics.operators import terms as tm

MSGS = "uid string, tid string, mid string, role string, body string, created_at timestamp, bcp47 string"
T0 = datetime(2024, 1, 1)


def said(spark, *bodies, role="usr"):
    rows = [("u", "t", f"USR{i}", role, b, T0, "en-US") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, MSGS)


def scripted(expr):
    def answer(requests):
        asked = bk.distinct_requests(requests)
        return bk.replay(bk.recorded_reply(asked.withColumn("reply", F.expr(expr))))(requests)

    return answer


LAST = "element_at(messages, -1).content"


@pytest.mark.parametrize(
    "reply, score",
    [
        ("ADULT; fine", 3), ("adult ; fine", 3), ("ADULT", None), ("ADULT; a; b", None),
        ("WOW; x", None), ("ADULT;x", None), ("YES; x", None),
    ],
)
def test_score(spark, reply, score):
    good, bad = fx.score_messages(said(spark, reply), "vocab", scripted(LAST))
    assert [r.score for r in good.collect()] == ([] if score is None else [score])
    assert bad.count() == (score is None)


def test_equal_requests_are_one(spark):
    df = said(spark, "a", "a", "b").withColumn("chat", F.array(F.struct("role", "body")))
    built, _ = rq.build_requests(df, rq.Effect("x"), fx.MESSAGE)
    assert built.count() == 3 and rq.distinct_requests(built).count() == 2
    other, _ = rq.build_requests(df, rq.Effect("x", top_p=0.5), fx.MESSAGE)
    assert built.join(other, "request_id").count() == 0


def test_nothing_to_do_after_the_assistant(spark):
    df = said(spark, "a", role="ast").withColumn("chat", F.array(F.struct("role", "body")))
    built, bad = rq.build_requests(df, rq.Effect("x"), fx.MESSAGE)
    assert built.count() == 0 and bad.count() == 1
    built, _ = rq.build_requests(df, rq.Effect("x"), fx.MESSAGE, check_user=False)
    assert built.count() == 1


def test_batch_backend_retries_and_keeps_errors(spark):
    def make_client():
        tries = {}

        def call(request):
            text = request["messages"][-1]["content"]
            tries[text] = tries.get(text, 0) + 1
            if text == "never" or (text == "second" and tries[text] < 2):
                raise TimeoutError(text)
            choice = {"index": 0, "finish_reason": "stop", "role": "assistant", "content": text.upper()}
            return {"choices": [choice], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}

        return call

    df = said(spark, "first", "second", "never", "known").withColumn(
        "chat", F.array(F.struct("role", "body"))
    )
    built, _ = rq.build_requests(df, rq.Effect("x"), fx.MESSAGE)
    known = bk.recorded_reply(
        built.where(F.col("body") == "known").select("request_id", F.lit("old").alias("reply"))
    )
    backend = bk.batch(make_client, known, retries=2, backoff_sec=0, partitions=2)
    good, bad = rq.ask(df, rq.Effect("x"), fx.MESSAGE, backend, keep=["body"])
    assert {r.body: r.reply for r in good.collect()} == {
        "first": "FIRST", "second": "SECOND", "known": "old"
    }
    assert [r.reason for r in bad.collect()] == ["TimeoutError: never"]
    done = rq.complete(built, backend)
    tries = {r.request_id: r.attempts for r in done.collect()}
    names = {r.body: tries[r.request_id] for r in built.collect()}
    assert names == {"first": 1, "second": 2, "never": 3, "known": 1}
    usage = rq.token_usage(done, built).first()
    assert (usage.n, usage.total_tokens) == (4, 6)


def test_long_transcripts_are_rejected_whole(spark):
    """A limit is off unless given."""
    rows = spark.range(10_001).select(
        F.lit("u").alias("uid"), F.lit("long").alias("tid"), F.col("id").cast("string").alias("mid"),
        F.lit("usr").alias("role"), F.lit("x").alias("body"), F.timestamp_seconds("id").alias("created_at"),
    )
    short = said(spark, "hello").select(*rows.columns)
    every = rows.unionByName(short)
    assert fx.grade_transcripts(every, scripted("'adult'"))[0].count() == 2
    good, bad = fx.grade_transcripts(every, scripted("'adult'"), 10_000)
    assert [(r.tid, r.grade) for r in good.collect()] == [("t", 11)]
    assert [(r.tid, r.reason) for r in bad.collect()] == [("long", "transcript too long for a request")]


def test_no_transcript_no_grade(spark):
    good, bad = fx.grade_transcripts(said(spark), scripted("'adult'"))
    assert good.count() == 0 and bad.count() == 0


def test_split_skills(spark):
    df = spark.createDataFrame(
        [("u", "1", "a"), ("u", "2", ""), ("u", "3", None), ("u", "4", "b")],
        "uid string, tid string, assessment string",
    )
    good, bad = fx.split_skills(df, scripted(f"if({LAST} = 'a', 'good\\nbad', 'only')"))
    got = {r.tid: (r.strengths, r.weaknesses) for r in good.collect()}
    assert got == {"1": ("good", "bad"), "2": (None, None), "3": (None, None)}
    assert [r.tid for r in bad.collect()] == ["4"]


def test_summary_prompt_is_translated_once(spark):
    memory = spark.createDataFrame([], "text string, source string, target string, translated string")
    asked = []

    def translator(df):
        asked.extend(df.collect())
        return df.withColumn("translated", F.concat("text", F.lit(" [zh]")))

    rows = said(spark, "one", "two").withColumn("bcp47", F.lit("zh-CN"))
    other = rows.withColumn("tid", F.lit("t2"))
    good, _ = fx.summarize(rows.unionByName(other), scripted(LAST), memory, translator, nwords=7)
    assert {r.summary for r in good.collect()} == {"Sum up the talk in 7 words. [zh]"}
    assert len(asked) == 1


def test_curriculum_of_a_sentence(spark):
    # Thai is written without blanks: terms come from recorded replies.
    kinds = {"แมว": "noun", "กิน": "verb", "ปลา": "noun", "แล้ว": "particle"}
    listed = said(spark, "".join(kinds)).withColumn("terms", F.array(*[F.lit(w) for w in kinds]))
    as_json = json.dumps(kinds, ensure_ascii=False)
    poss, _ = fx.extract_pos(listed, scripted(f"'{as_json}'"))
    conju, _ = fx.extract_conjugation(listed, poss, scripted("""'{"กิน": "plain"}'"""))
    itself = json.dumps({k: k for k in kinds}, ensure_ascii=False)
    roots, _ = fx.extract_root(listed, scripted(f"'{itself}'"))
    nothing = poss.where("false")
    terms = listed.select(*fx.MESSAGE, F.posexplode("terms").alias("pos", "term"))
    rows = tm.build_curriculum(terms, nothing, nothing, roots, poss, conju)
    got = {r.term: (r.part_of_speech, r.root, r.conju, r.defn) for r in rows.collect()}
    want = {k: (v, k, "plain" if v == "verb" else "", "") for k, v in kinds.items()}
    assert got == want


def test_vocabulary_of_a_sentence(spark):
    body = "Lanterns drift, and children count them from the pier."
    kind = "CASE WHEN t IN ('drift', 'count') THEN 'verb' ELSE 'other' END"
    terms = f"from_json({LAST}, 'struct<terms:array<string>>').terms"
    reply = f"to_json(map_from_entries(transform({terms}, t -> struct(t, {kind}))))"
    rows, bad = fx.extract_msgv(said(spark, body), scripted(reply))
    got = {r.term: r.part_of_speech for r in rows.collect()}
    assert sorted(t for t, k in got.items() if k == "verb") == ["count", "drift"]
    assert len(got) == 9 and bad.count() == 0


def test_no_reply_is_a_reject(spark):
    good, bad = fx.explain_grammar(
        said(spark, "a"), bk.replay(bk.recorded_reply(spark.createDataFrame([], "request_id string, reply string")))
    )
    assert good.count() == 0 and [r.reason for r in bad.collect()] == [bk.NO_REPLY]


def long_talk(spark, n):
    """A talk of ``n`` messages by turns, the learner's first; equal texts seven apart."""
    return spark.range(n).select(
        F.lit("u").alias("uid"), F.lit("long").alias("tid"), F.format_string("M%06d", "id").alias("mid"),
        F.when(F.col("id") % 2 == 0, "usr").otherwise("ast").alias("role"),
        F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("body"),
        F.timestamp_seconds("id").alias("created_at"), F.lit("en-US").alias("bcp47"),
    )


def echo():
    """Makers of a client that tells the number of messages and a hash of what it was sent."""

    def make_client():
        import hashlib

        def call(request):
            said = [(m["role"], m["content"]) for m in request["messages"]]
            text = f"{len(said)} {hashlib.md5(repr(said).encode()).hexdigest()}"
            return {"choices": [{"index": 0, "finish_reason": "stop", "role": "assistant", "content": text}]}

        return call

    return make_client


def sent(*messages):
    import hashlib

    return f"{len(messages)} {hashlib.md5(repr(list(messages)).encode()).hexdigest()}"


N_LONG = 10_001
SAYS = {"usr": "user", "ast": "assistant"}


def lines_of(n):
    return [("usr" if i % 2 == 0 else "ast", f"text {i % 7}") for i in range(n)]


def test_a_client_gets_whole_long_talks(spark):
    talk = [(SAYS[r], b) for r, b in lines_of(N_LONG)]
    messages = long_talk(spark, N_LONG)
    header = messages.select("uid", "tid", "bcp47").distinct()
    backend = bk.batch(echo(), retries=0)

    grades, bad = fx.grade_transcripts(messages, backend, None)
    assert grades.count() == 0 and [r.reason for r in bad.collect()] == ["grade not understood"]
    good, bad = fx.assess_skills(messages, header, backend)
    prompt = [("system", t.replace("{{LANGUAGE}}", "English")) for _, t in fx.SKILLS.prompt]
    assert [r.assessment for r in good.collect()] == [sent(*prompt[:-4], *talk, *prompt[-4:])]
    assert bad.count() == 0

    good, bad = fx.extract_topics(messages, header, backend)
    text = "\n".join(f"{r}: {b}" for r, b in lines_of(N_LONG))
    prompt = [
        ("system", t.replace("{{LANGUAGE}}", "English").replace("{{MAX_RESPONSES}}", "five"))
        for _, t in fx.TOPICS.prompt
    ]
    assert [r.topics for r in good.collect()] == [[sent(*prompt, ("user", f'"""\n{text}\n"""'))]]
    assert bad.count() == 0

    memory = spark.createDataFrame([], "text string, source string, target string, translated string")
    good, bad = fx.summarize(messages, backend, memory, lambda df: df.withColumn("translated", F.col("text")))
    assert [r.summary for r in good.collect()] == [sent(*talk, ("system", "Sum up the talk in 5 words."))]
    assert bad.count() == 0

    session = fx.talk_parts(messages)[0].select(
        "*", F.lit("unstr").alias("act_type"), F.lit("unstr").alias("plan_type"),
        F.array(rq.message("sys", F.lit("a"))).alias("act_prompt"),
        F.array(rq.message("sys", F.lit("b"))).alias("plan_prompt"),
        F.create_map(F.lit("7"), F.lit(5.0)).alias("logit_bias"),
    )
    good, bad = fx.batch_replies(session, backend)
    assert [r.reply for r in good.collect()] == [sent(("system", "a"), ("system", "b"), *talk)]
    assert bad.count() == 0

    good, bad = fx.assess_skills(messages, header, bk.batch(echo(), retries=0, max_messages=N_LONG))
    assert good.count() == 0 and [r.reason for r in bad.collect()] == [bk.TOO_LONG]


def test_context_of_every_message_of_a_long_talk(spark):
    reply = f"'YES; ' || n || ' ' || {LAST}"
    good, bad = fx.score_messages(long_talk(spark, N_LONG), "context", scripted(reply))
    prompt = len(fx.SCORE_EFFECTS["context"].prompt)
    want = {f"M{i:06d}": f"{prompt + i + 1} text {i % 7}" for i in range(0, N_LONG, 2)}
    assert {r.mid: r.explain for r in good.collect()} == want and bad.count() == 0


def test_context_in_parts_is_the_talk_so_far(spark, monkeypatch):
    talk = [(SAYS[r], b) for r, b in lines_of(24)]
    rules = fx.SCORE_EFFECTS["context"]
    scale = rules.fixed["RANKING"]
    prompt = [("system", t.replace("{{RANKING}}", scale)) for _, t in rules.prompt]

    def asked(size):
        monkeypatch.setattr(rq, "PART_MESSAGES", size)
        seen = {}

        def answer(requests):
            seen["ids"] = [r.request_id for r in requests.where("last").collect()]
            seen["whole"] = {
                tuple((m.role, m.content) for m in r.messages) for r in bk.whole_requests(requests).collect()
            }
            return bk.replay(bk.recorded_reply(requests.select("request_id", F.lit("YES; x").alias("reply"))))(requests)

        good, bad = fx.score_messages(long_talk(spark, 24), "context", answer)
        assert good.count() == 12 and bad.count() == 0
        return seen

    want = {(*prompt, *talk[: i + 1]) for i in range(0, 24, 2)}
    parts, one = asked(5), asked(100)
    assert parts["whole"] == one["whole"] == want
    assert len(set(parts["ids"])) == len(set(one["ids"])) == 12
    # What lies in the first part has the same id however talks are cut.
    assert len(set(parts["ids"]) & set(one["ids"])) == 3


def test_terms_asked_about_bias_the_request(spark):
    listed = fx.term_lists(said(spark, "red fox", "zebra"))
    table = spark.createDataFrame([("red", [1, 2]), ("fox", [2, 3])], "term string, token_ids array<int>")
    reply = "'{}'"
    for effect in (fx.extract_pos, fx.extract_udefn):
        for given, want in ((table, [{}, {"1": 5.0, "2": 5.0, "3": 5.0}]), (None, [None, None])):
            seen = []

            def answer(requests, seen=seen):
                seen.extend(r.params.logit_bias for r in requests.collect())
                return scripted(reply)(requests)

            effect(listed, answer, given)
            assert sorted(seen, key=lambda b: len(b or {})) == want


def test_scripted_replies_leave_messages_out_of_the_shuffle(spark):
    from convolytics.catalog.enrichment import LAST, scripted

    df = said(spark, "a", "b", "a").withColumn("chat", F.array(F.struct("role", "body")))
    built, _ = rq.build_requests(df, rq.Effect("x"), fx.MESSAGE)
    done = scripted(f"concat('r ', {LAST})")(built)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "first(messages" not in plan and "min(reply" in plan
    got = [r.choices[0].content for r in done.collect()]
    assert sorted(got) == ["r a", "r b"]
    parts = built.withColumns({"part": F.lit(0), "n": F.lit(1), "last": F.col("body") == "a"})
    assert [r.choices[0].content for r in scripted(LAST)(parts).collect()] == ["a"]


def test_completions_of_exploded_terms_are_not_broadcast(spark, tmp_path):
    said(spark, "hola amigo").write.parquet(str(tmp_path / "said"))
    rows = fx.term_lists(spark.read.parquet(str(tmp_path / "said")))
    rows = rows.select("uid", "tid", "mid", "body", F.explode("terms").alias("term"))
    good, bad = fx.extract_synonyms(rows, scripted("'[\"x\"]'"))
    for df in (good, bad):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.term, *r.synonyms) for r in good.collect()) == [("amigo", "x"), ("hola", "x")]


def test_terms_of_a_message_are_not_shuffled_one_by_one(spark):
    """A message is one row of the shuffle; keys that are equal once stripped count as one, the last."""
    reply = """CASE effect WHEN 'defn' THEN '{"hola ": "x", "hola": "y"}'
        WHEN 'udefn' THEN '{"amigo": "u", "other": "o"}' WHEN 'pos' THEN 'none' ELSE '{"a": "r", "b": null}' END"""
    found, bad = fx.extract_all(said(spark, "hola amigo", "..."), scripted(reply))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "max_by(" not in plan and "collect_list(" in plan
    got = {r.term: (r.pos, r.bcp47, r.defn, r.udefn, r.root, r.part_of_speech, r.conju) for r in found.collect()}
    assert got == {"hola": (0, "en-US", "y", "", "", "", ""), "amigo": (1, "en-US", "", "u", "", "", "")}
    assert [(r.mid, r.effect) for r in bad.collect()] == [("USR0", "pos")]
