"""Queries over terms, the usage ledger and what to practise next."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import epoch, messages, query, with_terms
from convolytics.operators import messages as ms
from convolytics.operators import terms as tm
from convolytics.operators import vocab as op
from convolytics.plans.next_vocabulary import next_vocabulary
from convolytics.session import cut
from convolytics.sources.views import view, with_views

FLAGS = with_views("v_usage_flags")
ISO = "'%Y-%m-%dT%H:%M:%S.000Z'"


def terms(spark, d):
    return op.extract_terms(messages(spark, d))


def uses(spark, d):
    return op.usages_of(terms(spark, d))


def flags(spark, d):
    return view(spark, d, "v_usage_flags").withColumn("when", F.timestamp_seconds("mid"))


@query("l12_extract_terms", with_terms() + " SELECT tid, turn, pos, term FROM v_terms")
def l12(spark, d):
    return terms(spark, d).select("tid", "turn", "pos", "term")


@query(
    "p12_explode_vocab",
    with_terms() + """ SELECT tid, turn, term, bcp47, CASE length(term) % 4 WHEN 0 THEN 'verb'
        WHEN 1 THEN 'noun' ELSE 'other' END AS pos FROM v_terms""",
)
def p12(spark, d):
    listed = messages(spark, d).withColumn("terms", op.terms_of(F.col("body")))
    vocab = F.expr(
        "map_from_entries(transform(terms, t -> struct(t, struct(bcp47, "
        "CASE length(t) % 4 WHEN 0 THEN 'verb' WHEN 1 THEN 'noun' ELSE 'other' END AS pos))))"
    )
    return ms.explode_vocab(listed.select("tid", "turn", vocab.alias("vocab")))


LEDGER_DOCS = """ SELECT uid, bcp47, term, 0::bigint AS part, n_usgs, first, last, uses FROM (
    SELECT uid, bcp47, term, count(*) AS n_usgs, min(at_epoch) AS first, max(at_epoch) AS last,
           string_agg(CAST(tid AS varchar) || '/' || mid, ',' ORDER BY at_epoch, tid, mid) AS uses
    FROM {source} GROUP BY uid, bcp47, term)"""


def _flat_docs(docs):
    spots = F.transform("usgs", lambda u: F.concat_ws("/", u["tid"].cast("string"), u["mid"]))
    return docs.select(
        "uid", "bcp47", "term", "part", F.size("usgs").alias("n_usgs"), epoch("first"),
        epoch("last"), F.array_join(spots, ",").alias("uses"),
    )


@query("a4_user_vocab", with_terms() + LEDGER_DOCS.format(source="v_uses"))
def a4(spark, d):
    return _flat_docs(op.build_user_vocab(uses(spark, d)))


@query(
    "a4_user_vocab_parts",
    with_terms() + """ SELECT uid, bcp47, term, part, count(*) AS n_usgs,
        min(min(at_epoch)) OVER (PARTITION BY uid, bcp47, term) AS first,
        max(max(at_epoch)) OVER (PARTITION BY uid, bcp47, term) AS last,
        string_agg(CAST(tid AS varchar) || '/' || mid, ',' ORDER BY at_epoch, tid, mid) AS uses
      FROM (SELECT *, (row_number() OVER (PARTITION BY uid, bcp47, term
                 ORDER BY at_epoch, tid, mid) - 1) // 4 AS part FROM v_uses)
      GROUP BY uid, bcp47, term, part""",
)
def a4_parts(spark, d):
    """Long ledgers go on in parts; here every four uses, through the hot-group path."""
    return _flat_docs(op.build_user_vocab(uses(spark, d), part_rows=4, rows_per_task=20))


@query("a5_merge_user_vocab", with_terms() + LEDGER_DOCS.format(source="v_uses"))
def a5(spark, d):
    """A ledger of two thirds of the transcripts, then two thirds again, overlapping."""
    new = uses(spark, d)
    old = op.build_user_vocab(new.where(F.col("tid") % 3 != 0))
    return _flat_docs(op.merge_user_vocab(old, new.where(F.col("tid") % 3 != 1)))


STATS = """count(*) AS n, count(*) FILTER (used_correctly) AS correct,
    count(*) FILTER (NOT used_correctly) AS incorrect,
    CAST(count(*) FILTER (used_correctly) AS double) / count(*) AS pct_correct"""


@query(
    "a6_usage_stats",
    FLAGS + f" SELECT uid, bcp47, term, {STATS} FROM v_usage_flags GROUP BY uid, bcp47, term",
)
def a6(spark, d):
    return op.usage_stats(flags(spark, d))


@query(
    "a7_usage_stats_per_transcript",
    FLAGS + f" SELECT uid, bcp47, term, tid, {STATS} FROM v_usage_flags "
    "GROUP BY uid, bcp47, term, tid",
)
def a7(spark, d):
    return op.usage_stats(flags(spark, d), [*op.LEDGER, "tid"])


FIRST_SQL = """, v_first AS (SELECT *, row_number() OVER (PARTITION BY uid, bcp47, term
    ORDER BY at_epoch, tid, mid) = 1 AS is_first FROM v_uses)"""


@query(
    "w3_flag_first_use",
    with_terms() + FIRST_SQL + " SELECT uid, bcp47, term, tid, mid, is_first FROM v_first",
)
def w3(spark, d):
    return op.flag_first_use(uses(spark, d)).select(*op.USE, "is_first")


@query(
    "a8_new_terms_per_message",
    with_terms() + FIRST_SQL + " SELECT uid, bcp47, tid, mid, count(*) AS n_new FROM v_first "
    "WHERE is_first GROUP BY uid, bcp47, tid, mid",
)
def a8(spark, d):
    return op.new_terms(uses(spark, d))


@query(
    "a8_new_terms_per_transcript",
    with_terms() + FIRST_SQL + " SELECT uid, bcp47, tid, count(*) AS n_new FROM v_first "
    "WHERE is_first GROUP BY uid, bcp47, tid",
)
def a8_transcript(spark, d):
    return op.new_terms(uses(spark, d), "transcript")


def select_sql(n: int, max_usg: int, cond: str = "true") -> str:
    return f""" SELECT uid, bcp47, term, n_usgs, last, CASE WHEN size < {n} THEN by_first
          ELSE by_last END AS rank
      FROM (SELECT *, count(*) OVER (PARTITION BY uid, bcp47) AS size,
              row_number() OVER (PARTITION BY uid, bcp47 ORDER BY first, term) AS by_first,
              row_number() OVER (PARTITION BY uid, bcp47 ORDER BY last DESC, first, term)
                AS by_last
            FROM v_ledger WHERE n_usgs < {max_usg} AND {cond})
      WHERE size < {n} OR by_last <= {n}"""


@query("k1_select_vocabulary", with_terms() + select_sql(16, 4))
def k1(spark, d):
    return next_vocabulary(messages(spark, d))


@query(
    "k1_select_vocabulary_as_of",
    with_terms()
    + f""", v_cut AS (SELECT uid, bcp47, term, n_usgs, first, last FROM v_ledger)
    {select_sql(300, 2, "last <= 1704067200 + 40 * 3600")}""",
)
def k1_as_of(spark, d):
    """With a cut in time, and more terms wanted than some learners have."""
    ledger = op.summarize_usages(uses(spark, d))
    as_of = F.timestamp_seconds(F.lit(1704067200 + 40 * 3600))
    df = op.select_vocabulary(ledger, n=300, max_usg=2, as_of=as_of)
    return df.select("uid", "bcp47", "term", "n_usgs", epoch("last"), "rank")


@query(
    "d11_vocab_size_audit",
    with_terms() + f""" SELECT uid, bcp47, CAST(sum(strlen(doc)) AS bigint) AS bytes,
        sum(strlen(doc)) > 20000 AS too_big FROM (
      SELECT uid, bcp47, '{{"term":"' || term || '","usgs":[' || string_agg(
          '{{"tid":' || tid || ',"mid":"' || mid || '","when":"'
          || strftime(make_timestamp(at_epoch * 1000000), {ISO}) || '"}}', ',') || '],"first":"'
          || strftime(make_timestamp(min(at_epoch) * 1000000), {ISO}) || '","last":"'
          || strftime(make_timestamp(max(at_epoch) * 1000000), {ISO}) || '"}}' AS doc
      FROM v_uses GROUP BY uid, bcp47, term) GROUP BY uid, bcp47""",
)
def d11(spark, d):
    return op.vocab_size_audit(op.build_user_vocab(uses(spark, d)), limit=20000)


@query(
    "d12_paginate",
    with_terms() + """ SELECT uid, bcp47, term, (row_number() OVER (PARTITION BY uid, bcp47
        ORDER BY first, term) - 1) // 25 AS page FROM v_ledger""",
)
def d12(spark, d):
    ledger = op.summarize_usages(uses(spark, d))
    return op.paginate(ledger, 25).select("uid", "bcp47", "term", "page")


NOTES = """, v_notes AS (SELECT tid, turn, mid, uid, term, pos, length(term) AS n FROM v_terms)"""


def _notes(df, cond, text):
    return df.where(cond).select("uid", "tid", "mid", "term", text.alias("value"), "pos")


@query(
    "j5_annotate_terms",
    with_terms() + NOTES + """ SELECT uid, tid, mid, term, pos,
        CASE WHEN n % 3 <> 0 THEN 'about ' || term END AS udefn,
        CASE WHEN n % 4 <> 1 THEN 'pos' || n END AS part_of_speech FROM v_notes""",
)
def j5(spark, d):
    rows = terms(spark, d)
    n = F.length("term")
    udefns = _notes(rows, n % 3 != 0, F.concat(F.lit("about "), "term"))
    poss = _notes(rows, n % 4 != 1, F.concat(F.lit("pos"), n.cast("string")))
    return tm.annotate_terms(rows.select("uid", "tid", "mid", "term", "pos"), udefns, poss)


@query(
    "j6_build_curriculum",
    with_terms() + NOTES + """ SELECT uid, tid, mid, term, pos,
        CASE WHEN n % 2 = 0 THEN 'defn ' || term ELSE '' END AS defn,
        CASE WHEN n % 3 <> 0 THEN 'about ' || term ELSE '' END AS udefn,
        substr(term, 1, 3) AS root,
        CASE n % 3 WHEN 0 THEN 'verb' WHEN 1 THEN 'noun' ELSE '' END AS part_of_speech,
        CASE WHEN n % 3 = 0 THEN 'past' ELSE '' END AS conju FROM v_notes""",
)
def j6(spark, d):
    rows = terms(spark, d)
    n = F.length("term")
    return tm.build_curriculum(
        rows.select("uid", "tid", "mid", "term", "pos"),
        _notes(rows, n % 2 == 0, F.concat(F.lit("defn "), "term")),
        _notes(rows, n % 3 != 0, F.concat(F.lit("about "), "term")),
        _notes(rows, F.lit(True), F.substring("term", 1, 3)),
        _notes(rows, n % 3 != 2, F.when(n % 3 == 0, "verb").otherwise("noun")),
        _notes(rows, F.lit(True), F.lit("past")),
    )


# Reply keys: same terms, some letters upper-case in every third message, one term missing
# in every fifth. (The engines differ in the upper case of a sharp s.)
CASED = ("aeinrst", "AEINRST")


def _reply(listed):
    term = F.when(F.col("tid") % 3 == 0, F.transform("terms", lambda t: F.translate(t, *CASED))).otherwise(F.col("terms"))
    cut = F.when((F.col("tid") + F.col("turn")) % 5 == 0, F.slice(term, 2, F.size(term)))
    return listed.withColumn("reply_terms", F.coalesce(cut, term))


REPLY_SQL = """, v_lists AS (SELECT uid, tid, turn, list(term ORDER BY pos) AS terms FROM v_terms
      GROUP BY uid, tid, turn),
    v_cased AS (SELECT *, CASE WHEN tid % 3 = 0 THEN list_transform(terms, lambda x: translate(x, 'aeinrst', 'AEINRST'))
      ELSE terms END AS changed FROM v_lists),
    v_replied AS (SELECT *, CASE WHEN (tid + turn) % 5 = 0 THEN changed[2:] ELSE changed END
      AS reply_terms FROM v_cased)"""


def _listed(spark, d):
    m = messages(spark, d).withColumn("terms", op.terms_of(F.col("body")))
    return _reply(m.where(F.size("terms") > 0))


@query(
    "u3_term_diff",
    with_terms() + REPLY_SQL + """ SELECT tid, turn,
        array_to_string(list_sort(list_filter(terms, lambda x: NOT list_contains(reply_terms, x))),
          ',') AS missing,
        array_to_string(list_sort(list_filter(list_distinct(reply_terms),
          lambda x: NOT list_contains(terms, x))), ',') AS surplus FROM v_replied""",
)
def u3(spark, d):
    df = tm.term_diff(_listed(spark, d))
    return df.select("tid", "turn", *[
        F.array_join(F.array_sort(c), ",").alias(c) for c in ("missing", "surplus")
    ])


def _repaired(spark, d):
    value = F.transform(
        "reply_terms", lambda k: F.struct(k.alias("key"), F.concat(F.lit("v "), k).alias("value"))
    )
    return tm.repair_keys(_listed(spark, d).withColumn("entries", value))


@query(
    "j7_repair_keys",
    with_terms() + REPLY_SQL + """ SELECT tid, turn, terms[i] AS term, 'v ' || reply_terms[i]
        AS value FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM v_replied
                       WHERE len(terms) = len(reply_terms))""",
)
def j7(spark, d):
    good, _ = _repaired(spark, d)
    return good.select("tid", "turn", F.inline("entries")).select(
        "tid", "turn", F.col("key").alias("term"), "value"
    )


@query(
    "j7_repair_rejects",
    with_terms() + REPLY_SQL + """ SELECT tid, turn, 'number of terms differs' AS reason
        FROM v_replied WHERE len(terms) <> len(reply_terms)""",
)
def j7_rejects(spark, d):
    return _repaired(spark, d)[1].select("tid", "turn", "reason")


@query(
    "j10_soft_match",
    with_terms() + """ SELECT uid, tid, mid, term, CASE WHEN length(term) % 3 = 0
        THEN translate(term, 'aeinrst', 'AEINRST') ELSE term || '#' END AS reply_term,
        CASE WHEN length(term) % 3 = 0 THEN 1.0::double
          ELSE round(2.0::double * length(term) / (2 * length(term) + 1), 9) END AS ratio
      FROM v_terms WHERE length(term) > 1""",
)
def j10(spark, d):
    """Replies in another case, or with a sign that no term has at the end.

    The nearest reply is then the term's own: it shares all n characters, 2n / (2n + 1),
    and any other lacks one of them at least.
    """
    rows = cut(terms(spark, d).select("uid", "tid", "mid", "term"))
    case = F.translate("term", "aeinrst", "AEINRST")
    spelled = F.when(F.length("term") % 3 == 0, case).otherwise(F.concat("term", F.lit("#")))
    found = tm.soft_match(rows, rows.withColumn("term", spelled), 0.8)
    return found.withColumn("ratio", F.round("ratio", 9))


# Slips of the pen: the first two letters change places, the last one is doubled or missing.
_SLIP = """CASE length(term) % 3 WHEN 0 THEN substr(term, 2, 1) || substr(term, 1, 1) || substr(term, 3)
    WHEN 1 THEN term || substr(term, length(term), 1) ELSE substr(term, 1, length(term) - 1) END"""


@query(
    "j10_soft_match_slips",
    f"""WITH RECURSIVE {with_terms().removeprefix("WITH ")},
      v_asked AS (SELECT uid, tid, mid, lower(term) AS term FROM v_terms WHERE length(term) > 3),
      v_given AS (SELECT uid, tid, mid, {_SLIP} AS reply FROM v_asked),
      v_exact AS (SELECT DISTINCT uid, tid, mid, term FROM v_asked JOIN v_given
        USING (uid, tid, mid) WHERE term = reply),
      v_both AS (SELECT DISTINCT uid, tid, mid, term, reply FROM v_asked JOIN v_given
        USING (uid, tid, mid)
        WHERE 2 * least(length(term), length(reply)) >= 0.8 * (length(term) + length(reply)) - 1e-9
          AND (uid, tid, mid, term) NOT IN (FROM v_exact)
          AND (uid, tid, mid, reply) NOT IN (FROM v_exact)),
      v_seg AS (
        SELECT term, reply, term AS x, reply AS y, 0 AS got
        FROM (SELECT DISTINCT term, reply FROM v_both)
        UNION ALL
        SELECT term, reply, unnest([substr(x, 1, b.i - 1), substr(x, b.i + b.n)]),
          unnest([substr(y, 1, b.j - 1), substr(y, b.j + b.n)]), unnest([b.n, 0])
        FROM (SELECT *, list_extract(flatten(list_transform(range(least(length(x), length(y)), 0, -1),
            lambda n: list_transform(list_filter(range(1, length(x) - n + 2),
              lambda i: contains(y, substr(x, i, n))),
              lambda i: {{'n': n, 'i': i, 'j': instr(y, substr(x, i, n))}}))), 1) AS b FROM v_seg)
        WHERE b IS NOT NULL),
      v_ratio AS (SELECT term, reply, 2.0::double * sum(got) / (length(term) + length(reply)) AS r
        FROM v_seg GROUP BY term, reply),
      v_best AS (SELECT uid, tid, mid, term, reply, r, row_number() OVER
          (PARTITION BY uid, tid, mid, term ORDER BY r DESC, reply) AS k
        FROM v_both JOIN v_ratio USING (term, reply) WHERE r >= 0.8)
      SELECT uid, tid, mid, term, term AS reply_term, 1.0::double AS ratio FROM v_exact
      UNION ALL SELECT uid, tid, mid, term, reply, round(r, 9) FROM v_best WHERE k = 1""",
)
def j10_slips(spark, d):
    """Replies with transposed, doubled and missing letters; each takes its best partner."""
    rows = cut(terms(spark, d).where("length(term) > 3").select("uid", "tid", "mid", F.lower("term").alias("term")))
    found = tm.soft_match(rows, rows.withColumn("term", F.expr(_SLIP)), 0.8)
    return found.withColumn("ratio", F.round("ratio", 9))
