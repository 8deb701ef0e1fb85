"""Queries over activities, plans, streaks, languages and the end of sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.catalog.common import epoch, hash_sql, messages, query, transcripts, with_terms
from convolytics.catalog.talks import FINAL_CTE
from convolytics.functions import dims
from convolytics.operators import languages as lg
from convolytics.operators import sessions as op
from convolytics.operators.vocab import summarize_usages
from convolytics.plans.session_end import end_sessions
from convolytics.sources.views import raw, view, with_views

AS_OF = "TIMESTAMP '2024-02-01 10:20:30'"
PLANS = with_views("v_plan_refs", "v_plans", "v_acts")


def _as_of():
    return F.lit("2024-02-01 10:20:30").cast("timestamp")


LATEST_SQL = """ SELECT aid, atp, bcp47, rn FROM (SELECT *, row_number() OVER (
      PARTITION BY atp, bcp47 ORDER BY created_at DESC, aid DESC) AS rn
    FROM v_acts WHERE created_at IS NOT NULL) WHERE rn <= {n}"""


@query("w2_latest_acts", with_views("v_acts") + LATEST_SQL.format(n=16))
def w2(spark, d):
    return op.latest_acts(view(spark, d, "v_acts")).select("aid", "atp", "bcp47", "rn")


@query(
    "w2_latest_act",
    with_views("v_acts") + f" SELECT aid, atp, bcp47 FROM ({LATEST_SQL.format(n=1)})",
)
def w2_one(spark, d):
    return op.latest_acts(view(spark, d, "v_acts"), 1).select("aid", "atp", "bcp47")


RESOLVED = PLANS + """, r AS (SELECT w.uid, w.pid, p.aid, p.atp, p.bcp47,
      CASE WHEN p.pid IS NULL THEN 'plan not found'
           WHEN p.atp IS NULL THEN 'plan has no activity type'
           WHEN p.atp = 'zzz' THEN 'invalid activity type'
           WHEN p.atp NOT IN ('min', 'unstr') THEN 'unsupported activity type'
           WHEN a.aid IS NULL THEN 'activity not found' END AS reason
    FROM v_plan_refs w LEFT JOIN v_plans p ON w.uid = p.uid AND w.pid = p.pid
    LEFT JOIN v_acts a ON a.atp = p.atp AND a.bcp47 = p.bcp47 AND a.aid = p.aid)"""


def _resolved(spark, d):
    tables = (view(spark, d, v) for v in ("v_plan_refs", "v_plans", "v_acts"))
    return op.resolve_plans(*tables)


@query("j1_resolve_plans", RESOLVED + " SELECT uid, pid, aid, atp, bcp47 FROM r WHERE reason IS NULL")
def j1(spark, d):
    return _resolved(spark, d)[0].select("uid", "pid", "aid", "atp", "bcp47")


@query("j1_resolve_rejects", RESOLVED + " SELECT uid, pid, reason FROM r WHERE reason IS NOT NULL")
def j1_rejects(spark, d):
    return _resolved(spark, d)[1].select("uid", "pid", "reason")


NEXT_PLANS = f"""v_next AS (
    SELECT u.uid, a.aid, a.atp, a.bcp47,
      {hash_sql("CAST(u.uid AS varchar) || '|' || CAST(a.aid AS varchar)", 6)} || '-' || a.atp || '-'
      || strftime({AS_OF}, '%Y%m%d-%H%M%S') AS pid
    FROM v_users u JOIN ({LATEST_SQL.format(n=1)}) a
      ON u.language = a.bcp47 AND a.atp IN ('min', 'unstr'))"""


def _plans(spark, d):
    return op.plans_from_acts(view(spark, d, "v_acts"), view(spark, d, "v_users"), _as_of())


@query(
    "j2_plans_from_acts",
    with_views("v_users", "v_acts") + f", {NEXT_PLANS} SELECT uid, aid, atp, bcp47, pid FROM v_next",
)
def j2(spark, d):
    return _plans(spark, d)


TID_SQL = f"""{hash_sql("CAST(uid AS varchar) || '|' || pid", 12)}
      || strftime({AS_OF}, '-%y%m%d-%H%M%S-') || bcp47"""


@query(
    "j3_transcripts_from_plans",
    with_views("v_users", "v_acts") + f""", {NEXT_PLANS} SELECT uid, aid, atp, pid, bcp47,
      'live' AS status, {TID_SQL} AS tid FROM v_next""",
)
def j3(spark, d):
    return op.transcripts_from_plans(_plans(spark, d), _as_of()).drop("created_at")


@query(
    "p5_make_pid",
    with_views("v_plans") + f""" SELECT p.pid AS n,
        {hash_sql("CAST(p.uid AS varchar) || '|' || CAST(p.pid AS varchar)", 4)} || '-' || coalesce(atp || '-', '')
        || strftime(o.o_orderdate, '%Y%m%d-%H%M%S') AS aid
      FROM v_plans p JOIN orders o ON o.o_orderkey = p.pid""",
)
def p5(spark, d):
    when = raw(spark, d, "orders").select(
        F.col("o_orderkey").alias("pid"), F.col("o_orderdate").cast("timestamp").alias("at")
    )
    df = view(spark, d, "v_plans").join(when, "pid")
    aid = op.plan_id(F.col("at"), F.col("atp"), F.col("uid"), F.col("pid"), length=4)
    return df.select(F.col("pid").alias("n"), aid.alias("aid"))


@query(
    "p6_parse_voice",
    with_views("v_plans") + """ SELECT pid, CASE WHEN voice_model IS NULL THEN bcp47 ELSE 'en-US'
        END AS language, coalesce(voice_model, bcp47 || '-Standard-A') AS model,
        CASE WHEN voice_model IS NULL THEN 'Standard' ELSE 'Wavenet' END AS type FROM v_plans""",
)
def p6(spark, d):
    df = op.with_voice(view(spark, d, "v_plans"))
    return df.select("pid", F.col("voice.bcp47").alias("language"), "voice.model", "voice.type")


@query(
    "p6_voice_of_tags",
    with_views("v_tags") + """ SELECT doc_id, split_part(voice_model, '-', 1) || '-'
        || split_part(voice_model, '-', 2) AS language, split_part(voice_model, '-', 3) AS type
      FROM v_tags""",
)
def p6_tags(spark, d):
    df = op.with_voice(view(spark, d, "v_tags").withColumn("bcp47", F.col("tag")))
    return df.select("doc_id", F.col("voice.bcp47").alias("language"), "voice.type")


@query(
    "p9_parse_bcp47",
    with_views("v_tags") + """ SELECT doc_id, lower(split_part(tag, '-', 1)) AS language,
        CASE WHEN contains(tag, '-') THEN split_part(tag, '-', 2) END AS territory,
        tag AS bcp47 FROM v_tags""",
)
def p9(spark, d):
    """Tags come in with odd case, underscores and blanks."""
    odd = F.when(F.col("doc_id") % 2 == 0, F.upper("tag")).otherwise(
        F.concat(F.lit(" "), F.replace(F.lower("tag"), F.lit("-"), F.lit("_")), F.lit(" "))
    )
    df = lg.parse_bcp47(view(spark, d, "v_tags").withColumn("tag", odd))
    return df.select("doc_id", "language", "territory", "bcp47")


def _countries(spark, d):
    return lg.match_country(lg.parse_bcp47(view(spark, d, "v_tags")))


@query(
    "j9_match_country",
    with_views("v_tags") + """ SELECT doc_id, split_part(tag, '-', 2) AS territory FROM v_tags
      WHERE contains(tag, '-') AND NOT contains(tag, 'QQ')""",
)
def j9(spark, d):
    return _countries(spark, d)[0].select("doc_id", "territory")


@query(
    "j9_country_rejects",
    with_views("v_tags") + """ SELECT doc_id, CASE WHEN contains(tag, 'QQ') THEN 'unknown country'
        ELSE 'no country' END AS reason FROM v_tags
      WHERE NOT contains(tag, '-') OR contains(tag, 'QQ')""",
)
def j9_rejects(spark, d):
    return _countries(spark, d)[1].select("doc_id", "reason")


LANGUAGE_NAMES = """(VALUES ('en', 'English', 'eng', 'English'), ('es', 'Spanish', 'spa', 'Español'),
    ('fr', 'French', 'fra', 'français'), ('de', 'German', 'deu', 'Deutsch'))
    AS x(code, name, code3, native)"""
SPELLED = """CASE doc_id % 5 WHEN 0 THEN x.name WHEN 1 THEN x.code3 WHEN 2 THEN x.code
    WHEN 3 THEN x.native ELSE 'Ehnglarsh' END"""


def _names(spark, d):
    given = [("en", "English", "eng", "English"), ("es", "Spanish", "spa", "Español"),
             ("fr", "French", "fra", "français"), ("de", "German", "deu", "Deutsch")]
    x = F.broadcast(spark.createDataFrame(given, "lang string, n string, c3 string, native string"))
    by = F.col("doc_id") % 5
    name = F.when(by == 0, F.col("n")).when(by == 1, F.col("c3")).when(by == 2, F.col("lang"))
    name = name.when(by == 3, F.col("native")).otherwise("Ehnglarsh")
    docs = raw(spark, d, "documents").select("doc_id", "lang").join(x, "lang")
    return lg.match_language(docs.select("doc_id", name.alias("name")))


@query(
    "j8_match_language",
    f"SELECT doc_id, {SPELLED} AS name, lang AS code FROM documents JOIN {LANGUAGE_NAMES} "
    "ON lang = x.code WHERE doc_id % 5 <> 4",
)
def j8(spark, d):
    return _names(spark, d)[0].select("doc_id", "name", "code")


THREE = ["Bemba", "bem", "Magahi", "mag", "Tok Pisin", "tpi"]


@query(
    "j8_three_letters",
    f"""SELECT doc_id, list_extract({THREE}, CAST(doc_id % 6 AS integer) + 1) AS name,
        list_extract(['bem', 'mag', 'tpi'], CAST(doc_id % 6 AS integer) // 2 + 1) AS code FROM documents""",
)
def j8_three_letters(spark, d):
    """Languages that have a code of three letters only, by name and by code."""
    names = F.array(*[F.lit(n) for n in THREE])
    docs = raw(spark, d, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 6).cast("int")).alias("name"))
    return lg.match_language(docs)[0].select("doc_id", "name", "code")


@query(
    "j8_language_rejects",
    "SELECT doc_id, 'Ehnglarsh' AS name, 'unknown language' AS reason FROM documents "
    "WHERE doc_id % 5 = 4",
)
def j8_rejects(spark, d):
    return _names(spark, d)[1].select("doc_id", "name", "reason")


@query(
    "j11_translate",
    with_views("v_messages") + """ SELECT tid, turn, CASE WHEN bcp47 = 'en-US' THEN body
        WHEN tid % 2 = 0 THEN 'known ' || body ELSE 'new ' || body END AS translated
      FROM v_messages""",
)
def j11(spark, d):
    """Half of the transcripts are in the translation memory, the others are asked for."""
    df = messages(spark, d).select(
        "tid", "turn", F.col("body").alias("text"), F.col("bcp47").alias("source"),
        F.lit("en-US").alias("target"),
    )
    known = df.where(F.col("tid") % 2 == 0).select(*lg.TEXT).distinct()
    memory = known.withColumn("translated", F.concat(F.lit("known "), "text"))
    new = df.select(*lg.TEXT).distinct()
    record = new.withColumn("translated", F.concat(F.lit("new "), "text"))
    done = lg.translate(df, memory, lg.replay_translations(record))
    return done.select("tid", "turn", "translated")


def _streak_sql(bound: str = "true") -> str:
    """Runs of days with a final transcript, of those that ended within ``bound``."""
    return with_views("v_days") + f""", days AS (SELECT uid, CAST(ended_at AS date) AS day,
      max(ended_at) AS last, max_by(tid, (ended_at, tid)) AS tid
      FROM v_days WHERE status = 'final' AND {bound} GROUP BY 1, 2),
    runs AS (SELECT uid, day - CAST(row_number() OVER (PARTITION BY uid ORDER BY day) AS integer)
      AS run, day, last, tid FROM days),
    ends AS (SELECT uid, count(*) AS n, max(day) AS day, max(last) AS last,
      max_by(tid, day) AS tid FROM runs GROUP BY uid, run)"""


@query(
    "a12_streaks",
    _streak_sql() + """ SELECT uid, max_by(n, day) AS count, max_by(tid, day) AS tid,
        CAST(epoch(max(last)) AS bigint) AS last FROM ends GROUP BY uid""",
)
def a12(spark, d):
    df = op.streaks(view(spark, d, "v_days"))
    return df.select("uid", "count", "tid", F.unix_seconds("last").alias("last"))


@query(
    "a12_streaks_as_of",
    _streak_sql("ended_at <= TIMESTAMP '1999-12-31'")
    + """ SELECT uid, CASE WHEN max(day) >= DATE '1999-12-30' THEN max_by(n, day) ELSE 0 END
        AS count, max_by(tid, day) AS tid FROM ends GROUP BY uid""",
)
def a12_as_of(spark, d):
    as_of = F.lit("1999-12-31").cast("timestamp")
    return op.streaks(view(spark, d, "v_days"), as_of).select("uid", "count", "tid")


@query(
    "p8_act_types",
    with_views("v_acts") + f""" SELECT aid, CAST(CASE atp
        {" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(dims.ACT_TYPES))} END AS bigint) AS ord
      FROM v_acts""",
)
def act_types(spark, d):
    types = F.broadcast(dims.act_types(spark))
    return view(spark, d, "v_acts").join(types, "atp").select("aid", "ord")


@query(
    "t3_session_end",
    with_terms("v_transcripts", "v_users", "v_acts")
    + ", "
    + FINAL_CTE
    + f""", v_ended AS (SELECT u.* FROM v_uses u JOIN v_final f ON u.uid = f.uid AND u.tid = f.tid
        WHERE f.status = 'final'),
      v_sums AS (SELECT uid, bcp47, term, count(*) AS n, min(at_epoch) AS first,
        max(at_epoch) AS last FROM v_ended GROUP BY uid, bcp47, term),
      v_best AS (SELECT *, count(*) OVER (PARTITION BY uid, bcp47) AS size,
        row_number() OVER (PARTITION BY uid, bcp47 ORDER BY last DESC, first, term) AS r,
        row_number() OVER (PARTITION BY uid, bcp47 ORDER BY first, term) AS f
        FROM v_sums WHERE n < 4 AND last <= epoch({AS_OF})),
      v_vocab AS (SELECT uid, bcp47, string_agg(term, ',' ORDER BY
        CASE WHEN size < 16 THEN f ELSE r END) AS vocab FROM v_best WHERE r <= 16
        GROUP BY uid, bcp47),
      {NEXT_PLANS}
      SELECT n.uid, n.aid, n.atp, n.bcp47, n.pid, coalesce(v.vocab, '') AS vocab
      FROM v_next n LEFT JOIN v_vocab v ON v.uid = n.uid AND v.bcp47 = n.bcp47""",
)
def t3(spark, d):
    """Plans of all learners for their next session, with the vocabulary to practise.

    Uses of half of the transcripts are already in the ledger; they count once.
    """
    from convolytics.catalog.vocabulary import uses

    done = end_sessions(
        messages(spark, d),
        transcripts(spark, d),
        uses(spark, d).where(F.col("tid") % 2 == 0),
        view(spark, d, "v_acts"),
        view(spark, d, "v_users"),
        _as_of(),
    )
    vocab = F.coalesce(F.array_join("vocab", ","), F.lit(""))
    return done["plans"].select("uid", "aid", "atp", "bcp47", "pid", vocab.alias("vocab"))


def _ended(spark, d, **more):
    from convolytics.catalog.vocabulary import uses

    return end_sessions(
        messages(spark, d),
        transcripts(spark, d),
        uses(spark, d).where(F.col("tid") % 2 == 0),
        view(spark, d, "v_acts"),
        view(spark, d, "v_users"),
        _as_of(),
        **more,
    )


@query(
    "t3_session_ledger",
    with_terms("v_transcripts") + ", " + FINAL_CTE + """ SELECT u.uid, u.bcp47, term, count(*) AS n_usgs,
        min(at_epoch) AS first, max(at_epoch) AS last FROM v_uses u JOIN v_final f
        ON u.uid = f.uid AND u.tid = f.tid WHERE f.status = 'final' OR u.tid % 2 = 0
      GROUP BY u.uid, u.bcp47, term""",
)
def t3_ledger(spark, d):
    """The ledger after a session: uses of finalised transcripts, and those it held before."""
    df = summarize_usages(_ended(spark, d)["usages"])
    return df.select("uid", "bcp47", "term", "n_usgs", epoch("first"), epoch("last"))


#: What a model is made to say at the end of a session, by effect.
END_REPLIES = f"""CASE effect
    WHEN 'grade' THEN if(n % 7 = 3, 'none', array('{"', '".join(dims.SCALES["Grade"])}')[n % 15])
    WHEN 'skills' THEN if(n % 2 = 0, 'even talk', 'odd talk')
    WHEN 'split_skills' THEN if(tail = 'even talk', 'was even\\nbe odd', 'one line')
    WHEN 'topics' THEN 'food, ' || if(contains(tail, '?'), 'questions', 'answers')
    ELSE tail || n END"""


@query(
    "t3_session_effects",
    with_views("v_messages", "v_transcripts") + ", " + FINAL_CTE + f""", f AS (
        SELECT m.uid, m.tid, count(*) AS n, any_value(m.bcp47) AS bcp47,
          bool_or(contains(body, '?') AND role IN ('usr', 'ast')) AS asks
        FROM v_messages m JOIN v_final s ON s.uid = m.uid AND s.tid = m.tid AND s.status = 'final'
        GROUP BY m.uid, m.tid),
      v_out AS (
        SELECT uid, tid, 'grades' AS output, CAST((n + 2) % 15 AS varchar) AS value FROM f
          WHERE (n + 2) % 7 <> 3
        UNION ALL SELECT uid, tid, 'reject grades', 'grade not understood' FROM f
          WHERE (n + 2) % 7 = 3
        UNION ALL SELECT uid, tid, 'skills', CASE WHEN n % 2 = 1 THEN 'even talk|was even|be odd'
          ELSE 'odd talk||' END FROM f
        UNION ALL SELECT uid, tid, 'reject skills', 'not two lines' FROM f WHERE n % 2 = 0
        UNION ALL SELECT uid, tid, 'topics', 'food|' || CASE WHEN asks THEN 'questions'
          ELSE 'answers' END FROM f
        UNION ALL SELECT uid, tid, 'summaries', CASE WHEN bcp47 = 'en-US' THEN '' ELSE bcp47 || ' ' END
          || 'Sum up the talk in 5 words.' || (n + 1) FROM f
        UNION ALL SELECT uid, tid, 'status', status FROM v_final)
      SELECT uid, tid, output, value FROM v_out""",
)
def t3_effects(spark, d):
    """Status of all transcripts, and what models say about the finalised ones."""
    from convolytics.catalog.enrichment import scripted_talks

    def translator(asked):
        return asked.withColumn("translated", F.concat("target", F.lit(" "), "text"))

    nothing = spark.createDataFrame([], "text string, source string, target string, translated string")
    out = _ended(
        spark, d, backend=scripted_talks(END_REPLIES), memory=nothing, translator=translator
    )
    values = {
        "grades": F.col("grade").cast("string"),
        "skills": F.concat_ws(
            "|", "assessment", F.coalesce("strengths", F.lit("")), F.coalesce("weaknesses", F.lit(""))
        ),
        "topics": F.array_join("topics", "|"),
        "summaries": F.col("summary"),
    }
    rows = [
        out[name].select("uid", "tid", F.lit(name).alias("output"), value.alias("value"))
        for name, value in values.items()
    ]
    bad = out["effect_rejects"]
    rows.append(bad.select("uid", "tid", F.concat(F.lit("reject "), "effect").alias("output"), F.col("reason").alias("value")))
    rows.append(out["transcripts"].select("uid", "tid", F.lit("status").alias("output"), F.col("status").alias("value")))
    return reduce(DataFrame.unionByName, rows)
