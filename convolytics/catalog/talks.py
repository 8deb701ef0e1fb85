"""Queries over messages, transcripts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import epoch, hash_sql, messages, query, strip_sql, transcripts
from convolytics.functions import dims
from convolytics.functions.scalars import audio_ordinal, py_strip, rfc3339, transcript_id
from convolytics.operators import messages as op
from convolytics.operators import scores as sc
from convolytics.sources import views
from convolytics.sources.views import raw, view, with_views

M = with_views("v_messages")
MID = "upper(role) || CAST(turn AS varchar)"


@query(
    "p1_map_roles",
    "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'usr' WHEN 'assistant' THEN 'ast' "
    "WHEN 'system' THEN 'sys' END AS role FROM conversations "
    "WHERE role IN ('user', 'assistant', 'system', 'function')",
)
def p1(spark, d):
    good, _ = op.map_roles(raw(spark, d, "conversations"), to="short")
    return good.select("conv_id", "turn", "role")


@query(
    "p1_role_rejects",
    "SELECT conv_id, turn, 'user?' AS role, 'unknown role' AS reason FROM conversations "
    "WHERE role = 'user' AND turn % 3 = 0",
)
def p1_rejects(spark, d):
    odd = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), "user?")
    df = raw(spark, d, "conversations").withColumn("role", F.coalesce(odd, "role"))
    return op.map_roles(df, to="short")[1].select("conv_id", "turn", "role", "reason")


@query(
    "p2_to_chat",
    M + " SELECT tid, turn, CASE role WHEN 'usr' THEN 'user' WHEN 'ast' THEN 'assistant' "
    "ELSE 'system' END AS role, body AS content FROM v_messages",
)
def p2(spark, d):
    return op.to_chat(messages(spark, d)).select("tid", "turn", "chat.role", "chat.content")


@query(
    "p3_rfc3339",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') "
    "ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END || '+00:00' AS at "
    "FROM events",
)
def p3(spark, d):
    df = views.query(spark, d, "SELECT event_id, ts FROM events")
    ts = F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.date_trunc("second", "ts"))
    return df.select("event_id", rfc3339(ts).alias("at"))


@query(
    "p4_py_strip",
    "SELECT conv_id, turn, " + strip_sql("chr(160) || chr(9) || text || chr(12288) || chr(10)")
    + " AS body FROM conversations",
)
def p4(spark, d):
    padded = F.concat(F.lit(" \t"), "text", F.lit("　\n"))
    return raw(spark, d, "conversations").select("conv_id", "turn", py_strip(padded).alias("body"))


@query(
    "p5_make_tid",
    "SELECT o_orderkey, "
    + hash_sql("CAST(o_custkey AS varchar) || '|' || CAST(o_orderkey AS varchar)", 12)
    + " || strftime(o_orderdate, '-%y%m%d-%H%M%S') || '-en-US' "
    "AS tid FROM orders",
)
def p5(spark, d):
    df = views.query(spark, d, "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
    tid = transcript_id(
        F.col("o_orderdate"), F.lit("en-US"), F.col("o_custkey"), F.col("o_orderkey")
    )
    return df.select("o_orderkey", tid.alias("tid"))


@query(
    "p7_audio_ordinal",
    "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id END AS ordinal FROM events",
)
def p7(spark, d):
    n = F.col("event_id").cast("string")
    name = F.when(F.col("event_id") % 9 != 0, F.concat(n, F.lit("-usr.wav"))).otherwise(
        F.concat(F.lit("x"), n, F.lit("-usr.wav"))
    )
    path = F.concat_ws("/", F.lit("audio"), F.col("user_id").cast("string"), name)
    return raw(spark, d, "events").select("event_id", audio_ordinal(path).alias("ordinal"))


def _rank_sql(names: list[str]) -> str:
    return " ".join(f"WHEN '{n}' THEN {v}" for v, n in enumerate(names))


@query(
    "p8_rank_of",
    with_views("v_replies")
    + f""" SELECT mid, CAST(value AS bigint) AS value FROM (SELECT mid, CASE WHEN dim IN ('vocab', 'grammar')
        THEN CASE upper(split_part(reply, ';', 1)) {_rank_sql(dims.SCALES["Level"])} END
        ELSE CASE upper(split_part(reply, ';', 1)) {_rank_sql(dims.SCALES["YesNo"])} END
        END AS value FROM v_replies) WHERE value IS NOT NULL""",
)
def p8(spark, d):
    df = view(spark, d, "v_replies").select(
        "mid",
        F.split_part("reply", F.lit(";"), F.lit(1)).alias("name"),
        dims.lookup(dims.SCORE_DIMS, F.col("dim")).alias("scale"),
    )
    return sc.rank_of(df, "name", "scale")[0].select("mid", "value")


#: Which scale each type of event is rated on; all others: YesNo.
SCALE_OF = {"signup": "Grade", "view": "Level"}


@query(
    "p8_rankings",
    "SELECT user_id, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN '{dims.ranking(s)}'" for e, s in SCALE_OF.items())
    + f" ELSE '{dims.ranking('YesNo')}' END AS ranking, count(*) AS n FROM events GROUP BY 1, 2",
)
def p8_rankings(spark, d):
    """Rankings of the scales that each user's events are rated on, as prompts show them."""
    scale = F.lit("YesNo")
    for event, name in SCALE_OF.items():
        scale = F.when(F.col("event_type") == event, name).otherwise(scale)
    n = raw(spark, d, "events").groupBy("user_id", scale.alias("scale")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(sc.rankings(dims.ranks(spark))), "scale").drop("scale")


@query(
    "p10_each_score",
    "SELECT event_id, 'vocab' AS dim, CAST(floor(value) AS bigint) % 5 AS score, 'Level' AS scale "
    "FROM events WHERE event_type IN ('signup', 'view') UNION ALL "
    "SELECT event_id, 'polite', CAST(floor(value) AS bigint) % 3, 'YesNo' FROM events "
    "WHERE event_type <> 'signup'",
)
def p10(spark, d):
    floor = F.floor("value")
    wide = raw(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("signup", "view"), floor % 5).alias("vocab"),
        F.when(F.col("event_type") != "signup", floor % 3).alias("polite"),
    )
    return sc.each_score(wide, ["event_id"])


@query(
    "p11_filter_roles",
    M + " SELECT tid, turn, role, body FROM v_messages WHERE role IN ('ast', 'usr')",
)
def p11(spark, d):
    return op.filter_roles(messages(spark, d)).select("tid", "turn", "role", "body")


W1_SQL = (
    M + " SELECT uid, tid, turn, upper(role) || CAST(row_number() OVER (PARTITION BY {keys} "
    "ORDER BY created_epoch, {order}) - 1 AS varchar) AS mid FROM v_messages"
)


@query("w1_number_messages", W1_SQL.format(keys="uid, tid", order="turn"))
def w1(spark, d):
    df = messages(spark, d).drop("mid")
    return op.number_messages(df).select("uid", "tid", "turn", "mid")


@query("w1_number_long_groups", W1_SQL.format(keys="uid", order="tid, turn"))
def w1_long(spark, d):
    """Numbers over all transcripts of a learner, with learners counted as hot groups."""
    order = ["created_at", "tid", "turn"]
    # Rows of hot groups are written: bodies stay out.
    df = messages(spark, d).select("uid", "role", *order)
    numbered = op.number_messages(df, ["uid"], order, rows_per_task=20)
    return numbered.select("uid", "tid", "turn", "mid")


@query("k2_ordered", M + " SELECT uid, tid, turn, role FROM v_messages ORDER BY uid, tid, turn")
def k2(spark, d):
    return op.ordered(messages(spark, d)).select("uid", "tid", "turn", "role")


@query(
    "a1_assemble",
    with_views("v_messages", "v_transcripts")
    + f""" SELECT t.uid, t.tid, t.status, 0::bigint AS part, coalesce(m.n, 0) AS n,
             coalesce(m.mids, '') AS mids, coalesce(m.bodies, '') AS bodies
        FROM v_transcripts t LEFT JOIN (
          SELECT uid, tid, count(*) AS n, string_agg({MID}, ',' ORDER BY created_epoch, {MID})
                   AS mids, string_agg(body, '|' ORDER BY created_epoch, {MID}) AS bodies
          FROM v_messages GROUP BY uid, tid) m ON t.uid = m.uid AND t.tid = m.tid""",
)
def a1(spark, d):
    docs = op.assemble(messages(spark, d), transcripts(spark, d).select("uid", "tid", "status"))
    bodies = F.transform(F.map_values("messages"), lambda m: m["body"])
    return docs.select(
        "uid", "tid", "status", "part", F.size("messages").alias("n"),
        F.array_join(F.map_keys("messages"), ",").alias("mids"),
        F.array_join(bodies, "|").alias("bodies"),
    )


LINE = "role || ': ' || " + strip_sql("body")


@query(
    "a2_dialogue",
    with_views("v_messages", "v_transcripts")
    + f""" SELECT t.uid, t.tid, 0::bigint AS part, coalesce(m.text, '') AS text
        FROM v_transcripts t LEFT JOIN (
          SELECT uid, tid, {strip_sql(f"string_agg({LINE}, chr(10) ORDER BY created_epoch, turn)")}
                   AS text
          FROM v_messages WHERE role IN ('ast', 'usr') GROUP BY uid, tid) m
        ON t.uid = m.uid AND t.tid = m.tid""",
)
def a2(spark, d):
    return op.dialogue(messages(spark, d), transcripts=transcripts(spark, d))


@query(
    "a2_dialogue_parts",
    M + f""" SELECT uid, tid, part, CASE WHEN part = max(part) OVER (PARTITION BY uid, tid)
          THEN {strip_sql("text")} ELSE text END AS text
        FROM (SELECT uid, tid, part, string_agg({LINE}, chr(10) ORDER BY i) AS text FROM (SELECT *, (i - 1) // 3 AS part FROM (
                SELECT *, row_number() OVER (PARTITION BY uid, tid ORDER BY created_epoch, turn)
                            AS i FROM v_messages WHERE role IN ('ast', 'usr')))
        GROUP BY uid, tid, part)""",
)
def a2_parts(spark, d):
    """Long dialogues go on in parts; here every three lines, through the hot-group path."""
    return op.dialogue(messages(spark, d), part_rows=3, rows_per_task=6)


@query(
    "a3_transcript_scores",
    with_views("v_scores")
    + """ SELECT uid, tid, dim, CAST(median(score) AS double) AS median,
                 CAST(mad(score) AS double) AS mad, count(*) AS n
          FROM (SELECT uid, tid, dim, CAST(score AS double) AS score FROM v_scores
                WHERE role = 'usr' AND score IS NOT NULL) GROUP BY uid, tid, dim""",
)
def a3(spark, d):
    return sc.transcript_scores(view(spark, d, "v_scores"))


@query(
    "a9_last_updated",
    with_views("v_messages", "v_transcripts")
    + """ SELECT t.uid, t.tid, coalesce(m.latest, t.created_epoch) AS last_updated
          FROM v_transcripts t LEFT JOIN (SELECT uid, tid, max(created_epoch) AS latest
               FROM v_messages GROUP BY uid, tid) m ON t.uid = m.uid AND t.tid = m.tid""",
)
def a9(spark, d):
    df = op.last_updated(transcripts(spark, d), messages(spark, d))
    return df.select("uid", "tid", epoch("last_updated"))


FINAL_CTE = """v_final AS (SELECT t.uid, t.tid, t.bcp47, t.created_epoch,
      CASE WHEN m.tid IS NULL THEN 'empty' ELSE 'final' END AS status
    FROM v_transcripts t LEFT JOIN (SELECT DISTINCT uid, tid FROM v_messages
         WHERE role = 'usr') m ON t.uid = m.uid AND t.tid = m.tid)"""
FINAL_SQL = with_views("v_messages", "v_transcripts") + ", " + FINAL_CTE


@query("a10_finalize", FINAL_SQL + " SELECT uid, tid, status FROM v_final")
def a10(spark, d):
    df = op.finalize(transcripts(spark, d), messages(spark, d))
    return df.select("uid", "tid", "status")


@query("a10_sentinels", FINAL_SQL + " SELECT uid, tid, status FROM v_final WHERE tid % 2 <> 0")
def a10_sentinels(spark, d):
    """Half of the transcripts were finalised before and get no second mark."""
    final = op.finalize(transcripts(spark, d), messages(spark, d))
    done = final.where(F.col("tid") % 2 == 0).select("uid", "tid", "status")
    return op.finalize_sentinels(final, done)


@query("u1_union_live", M + " SELECT tid, turn, role FROM v_messages WHERE role IN ('usr', 'ast')")
def u1(spark, d):
    users, assistants, _ = op.split_live(messages(spark, d))
    return op.union_live(users, assistants).select("tid", "turn", "role")


@query(
    "u2_split_live",
    M + " SELECT tid, turn, CASE role WHEN 'usr' THEN 'umsgs' WHEN 'ast' THEN 'amsgs' "
    "ELSE 'rejects' END AS lane FROM v_messages",
)
def u2(spark, d):
    lanes = zip(op.split_live(messages(spark, d)), ("umsgs", "amsgs", "rejects"))
    users, assistants, rejects = (
        df.select("tid", "turn", F.lit(lane).alias("lane")) for df, lane in lanes
    )
    return users.unionByName(assistants).unionByName(rejects)


GATE_SQL = with_views("v_messages", "v_transcripts") + """
    SELECT m.tid, m.turn, {out} FROM v_messages m LEFT JOIN v_transcripts t
      ON t.uid = m.uid AND t.tid = m.tid AND t.tid % 11 <> 3 WHERE {cond}"""


@query("j4_gate_live", GATE_SQL.format(out="m.role", cond="t.status = 'live'"))
def j4(spark, d):
    known = transcripts(spark, d).where(F.col("tid") % 11 != 3)
    return op.gate_live(messages(spark, d), known)[0].select("tid", "turn", "role")


@query(
    "j4_gate_rejects",
    GATE_SQL.format(
        out="CASE WHEN t.status IS NULL THEN 'transcript not found' "
        "ELSE 'transcript is ' || t.status END AS reason",
        cond="t.status IS NULL OR t.status <> 'live'",
    ),
)
def j4_rejects(spark, d):
    known = transcripts(spark, d).where(F.col("tid") % 11 != 3)
    return op.gate_live(messages(spark, d), known)[1].select("tid", "turn", "reason")


@query(
    "j12_patch_messages",
    M + f""" SELECT uid, tid, {MID} AS mid,
          CASE WHEN turn % 2 = 0 THEN 'edited ' || body ELSE body END AS body,
          CASE WHEN turn % 3 = 0 THEN 'second ' || body WHEN turn % 2 = 0 THEN 'first ' || body END
            AS translation FROM v_messages""",
)
def j12(spark, d):
    """Two rounds of patches: bodies and translations of even turns, then of each third."""
    base = messages(spark, d).select("uid", "tid", "turn", "mid", "body")
    table = base.withColumn("translation", F.lit(None).cast("string"))
    keys = ["uid", "tid", "mid"]
    one = base.where(F.col("turn") % 2 == 0).select(
        *keys, F.concat(F.lit("edited "), "body").alias("body"),
        F.concat(F.lit("first "), "body").alias("translation"), F.lit(1).alias("seq"),
    )
    two = base.where(F.col("turn") % 3 == 0).select(
        *keys, F.lit(None).cast("string").alias("body"),
        F.concat(F.lit("second "), "body").alias("translation"), F.lit(2).alias("seq"),
    )
    return op.patch_messages(table.drop("turn"), one.unionByName(two))


@query(
    "w5_needs_reply",
    M + " SELECT tid, last_role FROM (SELECT tid, max_by(role, turn) AS last_role FROM v_messages "
    "GROUP BY tid) WHERE last_role <> 'ast'",
)
def w5(spark, d):
    return op.needs_reply(messages(spark, d).withColumn("pos", F.col("turn")), "tid")
