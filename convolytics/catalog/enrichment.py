"""Queries over model enrichment, answered from replies recorded for the same data.

``scripted`` stands for a recording: it derives the reply of each request from the
request with an SQL expression, then answers by the ordinary replay join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import messages, query, strip_sql, transcripts, with_terms
from convolytics.functions import dims
from convolytics.operators import effects as fx
from convolytics.operators import requests as rq
from convolytics.operators import scores as sc
from convolytics.operators.backends import recorded_reply, replay
from convolytics.operators.vocab import extract_terms
from convolytics.plans.next_vocabulary import next_vocabulary
from convolytics.schemas import USAGE
from convolytics.sources.views import raw, view, with_views

M = with_views("v_messages")
MID = "upper(role) || CAST(turn AS varchar)"
LAST = "element_at(messages, -1).content"
FIRST = "messages[0].content"


def scripted(expr: str):
    """A backend that recorded ``expr`` of every request.

    Equal requests have equal replies, so that each row makes its reply: ids and replies go
    through the shuffle, messages do not.
    """

    def answer(requests):
        sent = requests.where("last") if "part" in requests.columns else requests
        recorded = recorded_reply(sent.select("request_id", F.expr(expr).alias("reply")))
        return replay(recorded, unique=True)(requests)

    return answer


def scripted_talks(expr: str):
    """``scripted`` for requests in parts, from ``head`` (the first three messages), ``tail``
    (the last text of the last part), ``n`` messages and ``chars`` of the last texts; plain
    requests are one part."""

    def answer(requests):
        if "part" not in requests.columns:
            requests = requests.withColumns({"part": F.lit(0), "n": F.size("messages")})
        seen = requests.groupBy("request_id", "part").agg(
            F.first("effect").alias("effect"),
            F.first("n").alias("n"),
            F.first("params").alias("params"),
            F.first(F.slice("messages", 1, 3)).alias("head"),
            F.first(F.element_at("messages", -1)["content"]).alias("tail"),
        )
        asked = seen.groupBy("request_id").agg(
            F.first("effect").alias("effect"),
            F.first("n").alias("n"),
            F.first("params").alias("params"),
            F.min_by("head", "part").alias("head"),
            F.max_by("tail", "part").alias("tail"),
            F.sum(F.length("tail")).alias("chars"),
        )
        recorded = recorded_reply(asked.withColumn("reply", F.expr(expr)))
        return replay(recorded, unique=True)(requests)

    return answer


# --- requests -------------------------------------------------------------------------


def _reply_messages(spark, d):
    """A message per event whose text is the reply that its scoring will get."""
    return view(spark, d, "v_replies").select(
        (F.col("tid") % 17).alias("uid"), "tid", "mid", "dim", F.lit("usr").alias("role"),
        F.col("reply").alias("body"), F.timestamp_seconds("mid").alias("created_at"),
    )


CHECK = rq.Effect("check", (("sys", "Check {{THIS}}."),), fixed={"THIS": "this"}, top_p=0.5)


def _checked(spark, d):
    df = messages(spark, d)
    body = F.when(F.col("turn") % 4 == 3, F.lit("{{X}}")).otherwise(F.lit("Be brief."))
    chat = F.concat(
        F.array(rq.message("sys", body)), rq.prompt_messages(CHECK), F.array(F.struct("role", "body"))
    )
    return rq.build_requests(df.withColumn("chat", chat), CHECK, ["tid", "turn"])


@query(
    "l1_build_requests",
    M + """ SELECT tid, turn, 'check' AS effect, 'gpt-3.5-turbo' AS model, 1::bigint AS n,
        128::bigint AS max_tokens, chr(10) AS stop, 0.5::double AS top_p,
        'system:Be brief.|system:Check this.|' || CASE role WHEN 'usr' THEN 'user' ELSE 'system'
        END || ':' || body AS messages FROM v_messages WHERE role <> 'ast' AND turn % 4 <> 3""",
)
def l1(spark, d):
    built, _ = _checked(spark, d)
    text = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return built.select(
        "tid", "turn", "effect", "model", "params.n", "params.max_tokens",
        F.array_join("params.stop", "").alias("stop"), "params.top_p",
        F.array_join(text, "|").alias("messages"),
    )


@query(
    "l1_request_rejects",
    M + """ SELECT tid, turn, CASE WHEN turn % 4 = 3 THEN 'template not substituted'
        ELSE 'the last message is from the assistant' END AS reason
      FROM v_messages WHERE turn % 4 = 3 OR role = 'ast'""",
)
def l1_rejects(spark, d):
    return _checked(spark, d)[1]


def _events(spark, d):
    """A request per event, many of them equal."""
    body = F.concat_ws(" ", "event_type", (F.floor("value") % 50).cast("string"))
    df = raw(spark, d, "events").select("event_id", F.array(rq.message("usr", body)).alias("chat"))
    return rq.build_requests(df, rq.Effect("event"), ["event_id"])[0]


BODY = "event_type || ' ' || CAST(CAST(floor(value) AS bigint) % 50 AS varchar)"


@query("l1_distinct_requests", f"SELECT DISTINCT {BODY} AS content FROM events")
def l1_distinct(spark, d):
    return rq.distinct_requests(_events(spark, d)).select(F.expr(LAST).alias("content"))


@query(
    "l2_complete",
    f"""SELECT event_id, CASE WHEN b LIKE 'view%' THEN NULL ELSE 'r ' || b END AS reply,
        CASE WHEN b LIKE 'view%' THEN 'no recorded completion' END AS error
      FROM (SELECT event_id, {BODY} AS b FROM events)""",
)
def l2(spark, d):
    """Replies were recorded for all requests but those about views."""
    asked = _events(spark, d)
    known = rq.distinct_requests(asked).where(~F.expr(f"{LAST} LIKE 'view%'"))
    recorded = recorded_reply(known.withColumn("reply", F.expr(f"'r ' || {LAST}")))
    done = rq.complete(asked, replay(recorded)).withColumn(
        "reply", F.try_element_at("choices", F.lit(1))["content"]
    )
    return asked.select("event_id", "request_id").join(done, "request_id").select(
        "event_id", "reply", "error"
    )


@query(
    "l3_pick",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' END AS reply,
        CASE event_id % 3 WHEN 0 THEN event_id % 2 = 0 WHEN 1 THEN false END AS odd_role,
        CASE WHEN event_id % 3 = 2 THEN 'no choice' END AS error FROM events""",
)
def l3(spark, d):
    """No choice, one, or two of which the first counts."""
    choice = "named_struct('index', {}, 'finish_reason', 'stop', 'role', {}, 'content', {})"
    one = choice.format(0, "'assistant'", "'b'")
    a = choice.format(
        0, "if(event_id % 2 = 0, 'system', 'assistant')", "concat('a', event_id)"
    )
    choices = f"CASE event_id % 3 WHEN 0 THEN array({a}, {one}) WHEN 1 THEN array({one}) END"
    df = raw(spark, d, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.expr(choices).alias("choices"),
        F.lit(None).cast("string").alias("error"),
    )
    return rq.pick(df).withColumn("event_id", F.col("request_id").cast("long")).drop("request_id")


@query(
    "l4_logit_bias",
    with_terms() + """, v_pick AS (SELECT uid, bcp47, term FROM (SELECT *, row_number() OVER (
          PARTITION BY uid, bcp47 ORDER BY last DESC, first, term) AS r FROM v_ledger
          WHERE n_usgs < 4) WHERE r <= 16),
      v_tokens AS (SELECT DISTINCT uid, bcp47, CAST(unnest([length(term), 100 + strlen(term),
          200 + pos]) AS varchar) AS token FROM v_pick JOIN (SELECT term, max(pos) AS pos
          FROM v_terms GROUP BY term) USING (term))
      SELECT uid, bcp47, token, CAST(CASE token WHEN '5' THEN -1 ELSE 5 END AS double) AS bias FROM v_tokens
      UNION SELECT uid, bcp47, '5', CAST(-1 AS double) FROM v_pick
      UNION SELECT uid, bcp47, 'own', CAST(2 AS double) FROM v_pick""",
)
def l4(spark, d):
    """Bias towards the terms each learner should practise; token ids come from a table."""
    m = messages(spark, d)
    picked = next_vocabulary(m).groupBy("uid", "bcp47").agg(F.collect_list("term").alias("vocab"))
    own = F.create_map(F.lit("5"), F.lit(-1.0), F.lit("own"), F.lit(2.0))
    df = rq.logit_bias(picked.withColumn("own", own), token_table(m), ["uid", "bcp47"], overrides="own")
    return df.select("uid", "bcp47", F.explode("logit_bias").alias("token", "bias"))


@query(
    "a11_token_usage",
    """SELECT 'gpt-3.5-turbo' AS model, 'event' AS effect, count(*) AS n,
        CAST(sum(length(b)) AS bigint) AS prompt_tokens, count(*) * 3 AS completion_tokens,
        CAST(sum(length(b) + 3) AS bigint) AS total_tokens
      FROM (SELECT DISTINCT """ + BODY + " AS b FROM events)",
)
def a11(spark, d):
    asked = _events(spark, d)
    n = F.length(F.expr(LAST)).cast("long")
    usage = F.struct(
        n.alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"),
        (n + 3).alias("total_tokens"),
    ).cast(USAGE)
    done = rq.distinct_requests(asked).select("request_id", usage.alias("usage"))
    return rq.token_usage(done, asked)


# --- scores ---------------------------------------------------------------------------


def _scored(spark, d):
    df = _reply_messages(spark, d)
    out = [
        fx.score_messages(df.where(F.col("dim") == dim).drop("dim"), dim, scripted(LAST))
        for dim in ("vocab", "grammar", "idiom", "polite")
    ]
    scores, rejects = out[0]
    for s, r in out[1:]:
        scores, rejects = scores.unionByName(s), rejects.unionByName(r)
    return scores, rejects


def _value(scale: str) -> str:
    names = " ".join(f"WHEN '{n}' THEN {v}" for v, n in enumerate(dims.SCALES[scale]))
    return f"CAST(CASE upper(split_part(reply, '; ', 1)) {names} END AS bigint)"


SCORED = with_views("v_replies") + f""", s AS (SELECT *, CASE WHEN dim IN ('vocab', 'grammar')
      THEN 'Level' ELSE 'YesNo' END AS scale, CASE WHEN len(string_split(reply, '; ')) = 2
      THEN CASE WHEN dim IN ('vocab', 'grammar') THEN {_value("Level")} ELSE {_value("YesNo")} END
      END AS score FROM v_replies WHERE dim <> 'context')"""


@query(
    "l5_score_messages",
    SCORED + """ SELECT tid, mid, dim, scale, score, split_part(reply, '; ', 2) AS explain FROM s
      WHERE score IS NOT NULL""",
)
def l5(spark, d):
    return _scored(spark, d)[0].select("tid", "mid", "dim", "scale", "score", "explain")


@query(
    "l5_score_rejects",
    SCORED + " SELECT tid, mid, 'score not understood' AS reason FROM s WHERE score IS NULL",
)
def l5_rejects(spark, d):
    return _scored(spark, d)[1].select("tid", "mid", "reason")


@query(
    "l5_score_context",
    M + f""" SELECT uid, tid, mid, CAST(CASE WHEN length(body) % 2 = 0 THEN 4 ELSE 0 END AS bigint)
        AS score, n || ' messages' AS explain FROM (SELECT uid, tid, role, body, {MID} AS mid,
          row_number() OVER (PARTITION BY uid, tid ORDER BY turn) + 3 AS n FROM v_messages)
      WHERE role = 'usr'""",
)
def l5_context(spark, d):
    reply = f"if(length({LAST}) % 2 = 0, 'yes', 'NO') || '; ' || n || ' messages'"
    scores, _ = fx.score_messages(messages(spark, d), "context", scripted(reply))
    return scores.select("uid", "tid", "mid", "score", "explain")


@query(
    "l5_scores_rolled_up",
    M + """, every AS (SELECT uid, tid, body, unnest(['idiom', 'polite', 'context'])
        AS dim FROM v_messages WHERE role = 'usr'),
      s AS (SELECT uid, tid, dim, CASE WHEN length(body) % 2 = 0 THEN 4 ELSE 0 END AS score FROM every)
      SELECT uid, tid, dim, CAST(median(score) AS double) AS median, count(*) AS n FROM s
      GROUP BY uid, tid, dim""",
)
def l5_rollup(spark, d):
    """Scores of messages alone and in context are one frame, rolled up per transcript."""
    reply = f"if(length({LAST}) % 2 = 0, 'yes', 'NO') || '; x'"
    frames = [
        fx.score_messages(messages(spark, d), dim, scripted(reply))[0] for dim in ("idiom", "polite", "context")
    ]
    scores = frames[0].unionByName(frames[1]).unionByName(frames[2]).withColumn("role", F.lit("usr"))
    return sc.transcript_scores(scores).select("uid", "tid", "dim", "median", "n")


# --- transcripts ----------------------------------------------------------------------

FIRST_SQL = M + """, f AS (SELECT uid, tid, min_by(body, turn) AS body, any_value(bcp47) AS bcp47,
    count(*) AS n FROM v_messages GROUP BY uid, tid)"""
GRADES = "', '".join(dims.SCALES["Grade"])


@query(
    "l6_grade_transcripts",
    FIRST_SQL + " SELECT uid, tid, length(body) % 16 AS grade FROM f WHERE length(body) % 16 < 15",
)
def l6(spark, d):
    reply = f"' ' || array('{GRADES}', 'NOBODY')[length(head[0].content) % 16] || ' '"
    return fx.grade_transcripts(messages(spark, d), scripted_talks(reply), None)[0]


@query(
    "l6_grade_rejects",
    FIRST_SQL + " SELECT uid, tid, 'grade not understood' AS reason FROM f "
    "WHERE length(body) % 16 = 15",
)
def l6_rejects(spark, d):
    reply = f"' ' || array('{GRADES}', 'NOBODY')[length(head[0].content) % 16] || ' '"
    return fx.grade_transcripts(messages(spark, d), scripted_talks(reply), None)[1]


LANG_NAME = """CASE bcp47 WHEN 'en-US' THEN 'English' WHEN 'es-MX' THEN 'Spanish'
    WHEN 'fr-FR' THEN 'French' ELSE 'German' END"""


@query(
    "l7_assess_skills",
    FIRST_SQL + f""" SELECT uid, tid, length(body) || ' of ' || (n + {len(fx.SKILLS.prompt)}) || ' '
        || replace('{fx.SKILLS.prompt[-1][1]}', '{{{{LANGUAGE}}}}', {LANG_NAME}) AS assessment FROM f""",
)
def l7(spark, d):
    """The talk stands after the first line of the prompt and before the last four."""
    reply = "' ' || length(head[1].content) || ' of ' || n || ' ' || tail"
    return fx.assess_skills(messages(spark, d), transcripts(spark, d), scripted_talks(reply))[0]


def _split(spark, d):
    text = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    df = raw(spark, d, "documents").select("doc_id", text.alias("assessment"))
    reply = f"if(length({LAST}) % 3 = 0, 'one', 'good ' || length({LAST}) || '\\nbad\\n')"
    return fx.split_skills(df, scripted(reply), ["doc_id"])


@query(
    "l8_split_skills",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 'good ' || length(text) END AS strengths,
        CASE WHEN doc_id % 10 <> 0 THEN 'bad' END AS weaknesses
      FROM documents WHERE doc_id % 10 = 0 OR length(text) % 3 <> 0""",
)
def l8(spark, d):
    return _split(spark, d)[0]


@query(
    "l8_split_rejects",
    "SELECT doc_id, 'not two lines' AS reason FROM documents "
    "WHERE doc_id % 10 <> 0 AND length(text) % 3 = 0",
)
def l8_rejects(spark, d):
    return _split(spark, d)[1]


@query(
    "l9_extract_topics",
    with_views("v_messages", "v_transcripts") + f""" SELECT t.uid, t.tid, {LANG_NAME.replace(
        'bcp47', 't.bcp47')} || '|x' || (length(coalesce(m.text, '')) + 8) AS topics
      FROM v_transcripts t LEFT JOIN (SELECT uid, tid, {strip_sql(
        f"string_agg(role || ': ' || {strip_sql('body')}, chr(10) ORDER BY turn)")} AS text
        FROM v_messages WHERE role IN ('ast', 'usr') GROUP BY uid, tid) m
      ON t.uid = m.uid AND t.tid = m.tid""",
)
def l9(spark, d):
    lang = "regexp_extract(head[2].content, 'Answer in (.*)[.]', 1)"
    df, _ = fx.extract_topics(
        messages(spark, d), transcripts(spark, d), scripted_talks(f"{lang} || ', x' || chars")
    )
    return df.select("uid", "tid", F.array_join("topics", "|").alias("topics"))


@query(
    "l10_summarize",
    FIRST_SQL + """ SELECT uid, tid, CASE bcp47 WHEN 'en-US' THEN '' WHEN 'es-MX' THEN 'known '
        ELSE 'new ' || bcp47 || ' ' END || 'Sum up the talk in 5 words. ' || length(body)
        AS summary FROM f""",
)
def l10(spark, d):
    """The Spanish prompt is in the translation memory; the others are asked for."""
    m = messages(spark, d)
    text = F.lit("Sum up the talk in 5 words.")
    tags = m.select("bcp47").distinct().select(
        text.alias("text"), F.lit("en-US").alias("source"), F.col("bcp47").alias("target")
    )
    memory = tags.where(F.col("target") == "es-MX").withColumn(
        "translated", F.concat(F.lit("known "), "text")
    )
    def translator(asked):
        return asked.withColumn("translated", F.concat(F.lit("new "), "target", F.lit(" "), "text"))

    reply = scripted_talks("tail || ' ' || length(head[0].content)")
    return fx.summarize(m, reply, memory, translator)[0]


@query(
    "l11_explain_grammar",
    M + f" SELECT uid, tid, {MID} AS mid, 'g ' || body AS grammar FROM v_messages",
)
def l11(spark, d):
    return fx.explain_grammar(messages(spark, d), scripted(f"'g ' || {LAST}"))[0]


# --- terms ----------------------------------------------------------------------------

_TERM = r"[\\p{L}\\p{N}]+(?:[-\'][\\p{L}\\p{N}]+)*"
BAD_JSON = "CASE WHEN length(body) % 7 = 0 THEN 1 ELSE 0 END"
BY_MODEL = f"""if(length({LAST}) % 7 = 0, 'sorry', '{{' || array_join(transform(
    regexp_extract_all(lower({LAST}), '{_TERM}', 0), t -> '" ' || t || '": null'), ', ') || '}}')"""


def _by_model(spark, d):
    return fx.extract_terms_by_model(messages(spark, d), scripted(BY_MODEL))


LEN = ", v_len AS (SELECT tid, turn, length(body) AS n FROM v_messages)"


@query(
    "l12_extract_terms_by_model",
    with_terms() + LEN + """ SELECT tid, mid, pos, term FROM v_terms JOIN v_len USING (tid, turn)
      WHERE n % 7 <> 0""",
)
def l12_model(spark, d):
    return _by_model(spark, d)[0].select("tid", "mid", "pos", "term")


@query(
    "l12_terms_rejects",
    M + f""" SELECT tid, {MID} AS mid, 'reply is not a JSON object' AS reason FROM v_messages
      WHERE length(body) % 7 = 0""",
)
def l12_rejects(spark, d):
    return _by_model(spark, d)[1].select("tid", "mid", "reason")


def json_reply(terms: str, value: str) -> str:
    pairs = f"transform({terms}, t -> '\"' || t || '\": \"' || {value} || '\"')"
    return f"'{{' || array_join({pairs}, ', ') || '}}'"


def given(value: str, reply: str) -> str:
    """An SQL expression in which ``x`` stands for a value computed once."""
    return f"element_at(transform(array({value}), x -> {reply}), 1)"


ASKED = f"from_json({LAST}, 'struct<msg:string,terms:array<string>>').terms"
BARE = f"from_json({LAST}, 'array<string>')"
KIND = "CASE length(t) % 4 WHEN 0 THEN 'verb' WHEN 1 THEN 'noun' ELSE 'other' END"
KIND_SQL = KIND.replace("(t)", "(term)")
# Every third message (by length) gets keys in another case, every fifth one key less.
PAYLOAD = f"from_json({LAST}, 'struct<msg:string,terms:array<string>>')"
SHOUTED = """transform(if(length(x.msg) % 5 = 0, slice(x.terms, 2, size(x.terms)), x.terms),
    t -> if(length(x.msg) % 3 = 0, translate(t, 'aeinrst', 'AEINRST'), t))"""
LOWER_KIND = "CASE length(t) % 4 WHEN 0 THEN ' verb ' WHEN 1 THEN 'noun' ELSE 'other' END"


def rows_sql(value: str, cond: str) -> str:
    return (
        with_terms()
        + LEN
        + f" SELECT tid, mid, pos, term, {value} AS value FROM v_terms "
        + f"JOIN v_len USING (tid, turn) WHERE {cond}"
    )


OUT = ["tid", "mid", "pos", "term", "value"]


def listed(spark, d):
    return fx.term_lists(messages(spark, d))


def _pos(spark, d):
    return fx.extract_pos(listed(spark, d), scripted(given(PAYLOAD, json_reply(SHOUTED, LOWER_KIND))))


@query("l13_extract_pos", rows_sql(KIND_SQL, "n % 5 <> 0"))
def l13(spark, d):
    return _pos(spark, d)[0].select(*OUT)


@query(
    "l13_pos_rejects",
    with_terms() + LEN + """ SELECT DISTINCT tid, mid, 'number of terms differs' AS reason
      FROM v_terms JOIN v_len USING (tid, turn) WHERE n % 5 = 0""",
)
def l13_rejects(spark, d):
    return _pos(spark, d)[1].select("tid", "mid", "reason")


def _defn(spark, d):
    return fx.extract_defn(listed(spark, d), scripted(given(PAYLOAD, json_reply(SHOUTED, "'d ' || t"))))


@query(
    "l14_extract_defn",
    with_terms() + LEN + """ SELECT tid, mid, pos, t AS term, 'd ' || t AS value FROM (
        SELECT *, CASE WHEN n % 3 = 0 THEN translate(term, 'aeinrst', 'AEINRST') ELSE term END AS t
        FROM v_terms JOIN v_len USING (tid, turn) WHERE n % 5 <> 0)""",
)
def l14(spark, d):
    """Every third message gets its keys in another case; terms are kept as replied."""
    return _defn(spark, d)[0].select(*OUT)


@query(
    "l14_defn_rejects",
    with_terms() + LEN + """ SELECT DISTINCT tid, mid, 'number of terms differs' AS reason
      FROM v_terms JOIN v_len USING (tid, turn) WHERE n % 5 = 0""",
)
def l14_rejects(spark, d):
    return _defn(spark, d)[1].select("tid", "mid", "reason")


@query(
    "l15_extract_udefn",
    rows_sql(f"{LANG_NAME} || ' ' || term", "true"),
)
def l15(spark, d):
    lang = "regexp_extract(messages[2].content, 'Answer in (.*)[.]', 1)"
    reply = json_reply(ASKED, f"{lang} || ' ' || t")
    return fx.extract_udefn(listed(spark, d), scripted(reply))[0].select(*OUT)


@query("l16_extract_root", rows_sql("substr(term, 1, 2)", "true"))
def l16(spark, d):
    reply = json_reply(BARE, "substring(t, 1, 2)")
    return fx.extract_root(listed(spark, d), scripted(reply))[0].select(*OUT)


@query(
    "l17_extract_conjugation",
    with_terms() + """, verbs AS (SELECT *, row_number() OVER (PARTITION BY tid, turn ORDER BY pos)
        - 1 AS i, count(*) OVER (PARTITION BY tid, turn) AS size FROM v_terms
        WHERE length(term) % 4 = 0)
      SELECT tid, mid, i AS pos, CASE WHEN size % 2 = 0 THEN term || 'x' ELSE term END AS term,
        'past' AS value, size % 2 = 0 AS keys_differ FROM verbs""",
)
def l17(spark, d):
    df = listed(spark, d)
    poss, _ = fx.extract_pos(df, scripted(json_reply(ASKED, KIND)))
    keys = "transform(x, t -> if(size(x) % 2 = 0, t || 'x', t))"
    reply = given(BARE, json_reply(keys, "'past'"))
    return fx.extract_conjugation(df, poss, scripted(reply))[0].select(*OUT, "keys_differ")


TERM_OF = f"from_json({LAST}, 'struct<msg:string,term:string>').term"


@query(
    "l18_extract_synonyms",
    with_terms() + """ SELECT tid, mid, term, CASE WHEN length(term) % 3 = 0 THEN 'bare' ELSE term END
        || '|x' || term AS synonyms FROM v_terms WHERE length(term) % 5 <> 0""",
)
def l18(spark, d):
    df = _synonyms(spark, d)[0]
    return df.select("tid", "mid", "term", F.array_join("synonyms", "|").alias("synonyms"))


def _synonyms(spark, d):
    """Replies are a map, a bare list, or no JSON at all."""
    reply = """CASE WHEN length(x) % 5 = 0 THEN 'none'
      WHEN length(x) % 3 = 0 THEN '["bare", "x' || x || '"]'
      ELSE '{"' || x || '": ["' || x || '", "x' || x || '"]}' END"""
    rows = extract_terms(messages(spark, d).withColumn("text", F.col("body")), "text")
    return fx.extract_synonyms(rows, scripted(given(TERM_OF, reply)))


@query(
    "l19_extract_detail",
    with_terms() + """ SELECT DISTINCT term, bcp47, 'Tell more about the term "' || term || '".'
        AS detail FROM v_terms""",
)
def l19(spark, d):
    return fx.extract_detail(extract_terms(messages(spark, d)), scripted(FIRST))[0]


ALL_REPLIES = f"""CASE effect WHEN 'pos' THEN {json_reply(ASKED, KIND)}
    WHEN 'defn' THEN {json_reply(ASKED, "'d ' || t")}
    WHEN 'udefn' THEN {json_reply(f"filter({ASKED}, t -> length(t) % 3 <> 0)", "'u ' || t")}
    WHEN 'root' THEN {json_reply(BARE, "substring(t, 1, 2)")}
    ELSE {json_reply(BARE, "'past'")} END"""
UDEFN_SQL = "CASE WHEN length(term) % 3 <> 0 THEN 'u ' || term END"


@query(
    "l20_extract_msgv",
    with_terms() + f""" SELECT tid, mid, bcp47, term, pos, {UDEFN_SQL} AS udefn,
        {KIND_SQL} AS part_of_speech FROM v_terms""",
)
def l20(spark, d):
    return fx.extract_msgv(messages(spark, d), scripted(ALL_REPLIES))[0].drop("uid")


@query(
    "l21_extract_all",
    with_terms() + f""" SELECT tid, mid, bcp47, term, pos, 'd ' || term AS defn,
        coalesce({UDEFN_SQL}, '') AS udefn, substr(term, 1, 2) AS root,
        {KIND_SQL} AS part_of_speech, CASE WHEN length(term) % 4 = 0 THEN 'past' ELSE '' END
          AS conju FROM v_terms""",
)
def l21(spark, d):
    return fx.extract_all(messages(spark, d), scripted(ALL_REPLIES))[0].drop("uid")


#: Replies of which some are no JSON or lack a key.
ODD_REPLIES = f"""CASE effect WHEN 'pos' THEN {given(PAYLOAD, json_reply(SHOUTED, LOWER_KIND))}
    WHEN 'defn' THEN {given(PAYLOAD, "if(length(x.msg) % 7 = 0, 'sorry', " + json_reply("x.terms", "'d'") + ")")}
    WHEN 'udefn' THEN {given(PAYLOAD, "if(length(x.msg) % 11 = 0, '[]', " + json_reply("x.terms", "'u'") + ")")}
    WHEN 'root' THEN {given(BARE, json_reply("if(size(x) % 4 = 0, slice(x, 2, size(x)), x)", "'r'"))}
    ELSE {given(BARE, "if(size(x) % 2 = 0, 'none', " + json_reply("x", "'past'") + ")")} END"""
COUNTS = LEN + """, v_counts AS (SELECT tid, mid, any_value(n) AS n, count(*) AS size,
    count(*) FILTER (length(term) % 4 = 0) AS verbs FROM v_terms JOIN v_len USING (tid, turn)
    GROUP BY tid, mid)"""
REJECTED = """SELECT tid, mid, 'pos' AS effect, 'number of terms differs' AS reason FROM v_counts
      WHERE n % 5 = 0
    UNION ALL SELECT tid, mid, 'udefn', 'reply is not a JSON object' FROM v_counts WHERE n % 11 = 0"""


@query("l20_rejects", with_terms() + COUNTS + REJECTED)
def l20_rejects(spark, d):
    found = fx.extract_msgv(messages(spark, d), scripted(ODD_REPLIES))[1]
    return found.select("tid", "mid", "effect", "reason")


@query(
    "l21_rejects",
    with_terms() + COUNTS + REJECTED + """
    UNION ALL SELECT tid, mid, 'defn', 'reply is not a JSON object' FROM v_counts WHERE n % 7 = 0
    UNION ALL SELECT tid, mid, 'root', 'number of terms differs' FROM v_counts WHERE size % 4 = 0
    UNION ALL SELECT tid, mid, 'conju', 'reply is not a JSON object' FROM v_counts
      WHERE n % 5 <> 0 AND verbs > 0 AND verbs % 2 = 0""",
)
def l21_rejects(spark, d):
    """What each effect could not read; no conjugation is asked where the verbs are not known."""
    found = fx.extract_all(messages(spark, d), scripted(ODD_REPLIES))[1]
    return found.select("tid", "mid", "effect", "reason")


NOT_OBJECT = "'reply is not a JSON object'"


@query(
    "l15_udefn_rejects",
    with_terms() + COUNTS + f"SELECT tid, mid, {NOT_OBJECT} AS reason FROM v_counts WHERE n % 11 = 0",
)
def l15_rejects(spark, d):
    return fx.extract_udefn(listed(spark, d), scripted(ODD_REPLIES))[1].select("tid", "mid", "reason")


@query(
    "l16_root_rejects",
    with_terms() + COUNTS
    + "SELECT tid, mid, 'number of terms differs' AS reason FROM v_counts WHERE size % 4 = 0",
)
def l16_rejects(spark, d):
    return fx.extract_root(listed(spark, d), scripted(ODD_REPLIES))[1].select("tid", "mid", "reason")


@query(
    "l17_conjugation_rejects",
    with_terms() + COUNTS + f"""SELECT tid, mid, {NOT_OBJECT} AS reason FROM v_counts
      WHERE n % 5 <> 0 AND verbs > 0 AND verbs % 2 = 0""",
)
def l17_rejects(spark, d):
    df = listed(spark, d)
    poss, _ = fx.extract_pos(df, scripted(ODD_REPLIES))
    return fx.extract_conjugation(df, poss, scripted(ODD_REPLIES))[1].select("tid", "mid", "reason")


@query(
    "l18_synonym_rejects",
    with_terms() + """ SELECT tid, mid, term, 'no list of synonyms' AS reason FROM v_terms
      WHERE length(term) % 5 = 0""",
)
def l18_rejects(spark, d):
    return _synonyms(spark, d)[1].select("tid", "mid", "term", "reason")


@query(
    "l19_detail_rejects",
    with_terms() + """ SELECT DISTINCT term, bcp47, 'no recorded completion' AS reason FROM v_terms
      WHERE length(term) % 2 = 0""",
)
def l19_rejects(spark, d):
    """Requests about half of the terms were never recorded."""

    def answer(requests):
        even = f"length(regexp_extract({FIRST}, '\"(.*)\"', 1)) % 2 = 0"
        return scripted(FIRST)(requests.where(f"NOT ({even})"))

    return fx.extract_detail(extract_terms(messages(spark, d)), answer)[1]


TOKENS = """, v_tokens AS (SELECT term, unnest([length(term), 100 + strlen(term), 200 + max(pos)]) AS token
    FROM v_terms GROUP BY term)"""


def token_table(m):
    """A token encoder's table: made-up ids that follow from the terms of messages."""
    return extract_terms(m).groupBy("term").agg(F.max("pos").alias("p")).select(
        "term", F.array(F.length("term"), F.octet_length("term") + 100, F.col("p") + 200)
        .alias("token_ids"),
    )


def _bias_text(bias):
    """The tokens of a bias map in order, if all have the usual weight."""
    usual = F.forall(F.map_values(bias), lambda v: v == 5.0)
    return F.when(usual, F.array_join(F.array_sort(F.map_keys(bias)), ","))


@query(
    "l20_request_bias",
    with_terms() + TOKENS + """, v_bias AS (SELECT tid, mid, string_agg(token, ',' ORDER BY token) AS bias
        FROM (SELECT DISTINCT tid, mid, CAST(token AS varchar) AS token
              FROM v_terms JOIN v_tokens USING (term)) GROUP BY tid, mid)
      SELECT tid, mid, effect, CASE WHEN effect IN ('pos', 'udefn') THEN bias END AS bias
      FROM v_bias, (VALUES ('pos'), ('udefn'), ('defn'), ('root')) e(effect)""",
)
def l20_bias(spark, d):
    """Part of speech and micro-definitions lean towards the tokens of the terms they ask for."""
    names = ["pos", "udefn", "defn", "root"]
    rows = fx.term_requests(listed(spark, d), names, token_table(messages(spark, d)))
    return rows.select("tid", "mid", "effect", _bias_text(F.col("params.logit_bias")).alias("bias"))


# --- replies --------------------------------------------------------------------------

ACT = "CASE tid % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'unstr' WHEN 2 THEN 'unstr' ELSE 'intro' END"
REASON = """CASE WHEN tid % 13 = 5 THEN 'plan is of another type'
    WHEN tid % 4 = 3 THEN 'unsupported activity type'
    WHEN tid % 4 <> 0 AND role = 'ast' THEN 'the last message is from the assistant' END"""
OPEN_SESSIONS = f""", s AS (SELECT *, {REASON} AS reason FROM (SELECT uid, tid, count(*) AS n,
    max_by(role, turn) AS role, max_by(body, turn) AS body FROM v_messages GROUP BY uid, tid))"""
SESSIONS = M + OPEN_SESSIONS


def _sessions(spark, d):
    talks, _ = fx.talk_parts(messages(spark, d))
    act = F.expr(ACT)
    base = F.array(rq.message("sys", F.lit("You are a tutor.")))
    more = F.array(rq.message("sys", F.lit("Talk about food.")))
    return talks.withColumns(
        {
            "act_type": act,
            "plan_type": F.when(F.col("tid") % 13 == 5, F.lit("story")).otherwise(act),
            "act_prompt": base,
            "plan_prompt": more,
            "logit_bias": F.create_map(F.lit("7"), F.lit(5.0)),
        }
    )


def _replies(spark, d):
    reply = "n || ' ' || params.logit_bias['7'] || ' ' || tail"
    return fx.batch_replies(_sessions(spark, d), scripted_talks(reply))


@query(
    "l22_batch_replies",
    SESSIONS + """ SELECT uid, tid, CASE WHEN tid % 4 = 0 THEN 'Hello, world!'
        ELSE (n + 2) || ' 5.0 ' || body END AS reply FROM s WHERE reason IS NULL""",
)
def l22(spark, d):
    return _replies(spark, d)[0]


@query("l22_reply_rejects", SESSIONS + " SELECT uid, tid, reason FROM s WHERE reason IS NOT NULL")
def l22_rejects(spark, d):
    return _replies(spark, d)[1]


@query(
    "l22_replies_by_vocabulary",
    with_terms() + TOKENS + OPEN_SESSIONS + """, v_pick AS (SELECT uid, bcp47, term FROM (SELECT *, row_number() OVER (
        PARTITION BY uid, bcp47 ORDER BY last DESC, first, term) AS r FROM v_ledger
        WHERE n_usgs < 4) WHERE r <= 16),
      v_bias AS (SELECT uid, bcp47, string_agg(token, ',' ORDER BY token) AS bias
        FROM (SELECT DISTINCT uid, bcp47, CAST(token AS varchar) AS token
              FROM v_pick JOIN v_tokens USING (term)) GROUP BY uid, bcp47),
      v_lang AS (SELECT DISTINCT tid, bcp47 FROM v_messages)
      SELECT s.uid, tid, (n + 2) || ' ' || coalesce(bias, '') || ' ' || body AS reply
      FROM s JOIN v_lang USING (tid)
      LEFT JOIN v_bias v ON v.uid = s.uid AND v.bcp47 = v_lang.bcp47
      WHERE reason IS NULL AND tid % 4 <> 0""",
)
def l22_by_vocabulary(spark, d):
    """Replies biased towards the terms that the learner should practise next.

    Ledger, selection, token maps, request parameters and request id form one chain.
    """
    m = messages(spark, d)
    picked = next_vocabulary(m).groupBy("uid", "bcp47").agg(F.collect_list("term").alias("vocab"))
    bias = rq.logit_bias(picked, token_table(m), ["uid", "bcp47"]).drop("vocab")
    every = transcripts(spark, d).select("uid", "tid", "bcp47").join(bias, ["uid", "bcp47"], "left")
    tokens = "array_join(array_sort(map_keys(params.logit_bias)), ',')"
    reply = f"n || ' ' || coalesce({tokens}, '') || ' ' || tail"
    sessions = _sessions(spark, d).drop("logit_bias").join(every.drop("bcp47"), ["uid", "tid"])
    return fx.batch_replies(sessions, scripted_talks(reply))[0].where("tid % 4 <> 0")
