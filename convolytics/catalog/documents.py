"""Queries over stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.catalog.common import messages, query
from convolytics.operators import docs as op
from convolytics.sources import views
from convolytics.sources.documents import export_json, parse_docs, parse_paths
from convolytics.sources.views import raw, view, with_views

P = with_views("v_paths")
DOCS = with_views("v_docs_old", "v_docs_new")
SEG = "split_part(path, '/', {})"


def old_new(spark, d):
    return view(spark, d, "v_docs_old"), view(spark, d, "v_docs_new")


def _stored(spark, d):
    """Transcripts as JSON: the body claims another uid, every fifth body is broken."""
    n = F.col("n").cast("string")
    data = F.to_json(F.struct(
        F.lit("someone").alias("uid"), "status",
        F.when(F.col("n") % 3 == 0, F.concat(F.lit("sum "), n)).alias("summary"),
        F.lit("x").alias("unknown_field"),
    ))
    text = F.when(F.col("n") % 5 == 0, F.substring(data, 2, 1000)).otherwise(data)
    return parse_docs(view(spark, d, "v_paths").select("n", "path", text.alias("data")), "transcript")


@query(
    "d1_read_docs",
    P + f""" SELECT n, {SEG.format(2)} AS uid, {SEG.format(4)} AS tid, status,
        CASE WHEN n % 3 = 0 THEN 'sum ' || n END AS summary FROM v_paths
        WHERE n % 8 = 1 AND n % 5 <> 0""",
)
def d1(spark, d):
    return _stored(spark, d)[0].select("n", "uid", "tid", "status", "summary")


@query(
    "d1_read_rejects",
    P + """ SELECT n, path, CASE n % 8 WHEN 1 THEN 'invalid document'
          WHEN 4 THEN 'invalid activity type' WHEN 5 THEN 'empty part'
          WHEN 6 THEN 'invalid language' ELSE 'odd number of parts' END AS reason
        FROM v_paths WHERE n % 8 > 3 OR (n % 8 = 1 AND n % 5 = 0)""",
)
def d1_rejects(spark, d):
    return _stored(spark, d)[1].select("n", "path", "reason")


@query(
    "d2_parse_paths",
    P + f""" SELECT n, CASE n % 8 WHEN 0 THEN 'plan' WHEN 1 THEN 'transcript' WHEN 2 THEN 'act'
          ELSE 'user' END AS entity, CASE WHEN n % 8 <> 2 THEN {SEG.format(2)} END AS uid,
        CASE WHEN n % 8 = 1 THEN {SEG.format(4)} END AS tid,
        CASE WHEN n % 8 = 0 THEN {SEG.format(4)} END AS pid,
        CASE WHEN n % 8 = 2 THEN 'min' END AS atp, CASE WHEN n % 8 = 2 THEN 'en-US' END AS bcp47,
        CASE WHEN n % 8 = 2 THEN {SEG.format(4)} END AS aid
        FROM v_paths WHERE n % 8 < 4""",
)
def d2(spark, d):
    good, _ = parse_paths(view(spark, d, "v_paths"))
    return good.select("n", "entity", "uid", "tid", "pid", "atp", "bcp47", "aid")


@query(
    "d2_path_rejects",
    P + """ SELECT n, path, CASE n % 8 WHEN 4 THEN 'invalid activity type' WHEN 5 THEN 'empty part'
          WHEN 6 THEN 'invalid language' ELSE 'odd number of parts' END AS reason
        FROM v_paths WHERE n % 8 > 3""",
)
def d2_rejects(spark, d):
    return parse_paths(view(spark, d, "v_paths"))[1].select("n", "path", "reason")


@query(
    "d3_create_docs",
    DOCS + """ SELECT * FROM v_docs_old UNION ALL
        SELECT * FROM v_docs_new WHERE k NOT IN (SELECT k FROM v_docs_old)""",
)
def d3(spark, d):
    return op.create_docs(*old_new(spark, d), ["k"])[0]


@query(
    "d3_create_conflicts",
    DOCS + " SELECT k, name FROM v_docs_new WHERE k IN (SELECT k FROM v_docs_old)",
)
def d3_conflicts(spark, d):
    return op.create_docs(*old_new(spark, d), ["k"])[1].select("k", "name")


@query(
    "d4_set_docs",
    DOCS + """ SELECT * FROM v_docs_old WHERE k NOT IN (SELECT k FROM v_docs_new)
        UNION ALL SELECT * FROM v_docs_new""",
)
def d4(spark, d):
    return op.set_docs(*old_new(spark, d), ["k"])


def _repeated(spark, d):
    """New documents, every third of them once more with another name."""
    old, new = old_new(spark, d)
    again = new.where("k % 3 = 0").withColumn("name", F.concat(F.lit("later "), F.col("k").cast("string")))
    return old, new.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))


LATER = "CASE WHEN k % 3 = 0 THEN 'later ' || k ELSE name END"


@query(
    "d3_create_repeats",
    DOCS + """ SELECT k, name, 'new' AS side FROM v_docs_new WHERE k NOT IN (SELECT k FROM v_docs_old)
        UNION ALL SELECT k, name, 'old' FROM v_docs_old
        UNION ALL SELECT k, name, 'conflict' FROM v_docs_new WHERE k IN (SELECT k FROM v_docs_old)
        UNION ALL SELECT k, 'later ' || k, 'conflict' FROM v_docs_new WHERE k % 3 = 0""",
)
def d3_repeats(spark, d):
    """Of two new documents with one key the first is created, the second a conflict."""
    old, new = _repeated(spark, d)
    made, conflicts = op.create_docs(old, new, ["k"], seq="seq")
    known = old.select("k", F.lit("old").alias("side"))
    side = made.join(known, "k", "left").select("k", "name", F.coalesce("side", F.lit("new")).alias("side"))
    return side.unionByName(conflicts.select("k", "name", F.lit("conflict").alias("side")))


@query(
    "d4_set_repeats",
    DOCS + f""" SELECT * FROM v_docs_old WHERE k NOT IN (SELECT k FROM v_docs_new)
        UNION ALL SELECT k, {LATER}, language, amount FROM v_docs_new""",
)
def d4_repeats(spark, d):
    return op.set_docs(*_repeated(spark, d), ["k"], seq="seq")


@query(
    "d5_merge_repeats",
    DOCS + f""", n AS (SELECT k, {LATER} AS name, language, amount FROM v_docs_new)
      SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name,
        coalesce(n.language, o.language) AS language, coalesce(n.amount, o.amount) AS amount
      FROM v_docs_old o FULL OUTER JOIN n ON o.k = n.k""",
)
def d5_repeats(spark, d):
    return op.merge_docs(*_repeated(spark, d), ["k"], seq="seq")


MAPS_SQL = """, o AS (SELECT *, 'old ' || k AS a, 'old ' || k AS b FROM v_docs_old),
    n AS (SELECT *, 'new ' || k AS b, 'new ' || k AS c FROM v_docs_new)"""


@query(
    "d5_merge_docs",
    DOCS + MAPS_SQL + """ SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name,
        coalesce(n.language, o.language) AS language, coalesce(n.amount, o.amount) AS amount,
        o.a AS tags_a, coalesce(n.b, o.b) AS tags_b, n.c AS tags_c
      FROM o FULL OUTER JOIN n ON o.k = n.k""",
)
def d5(spark, d):
    old, new = old_new(spark, d)

    def tags(word, *names):
        value = F.concat(F.lit(word + " "), F.col("k").cast("string"))
        return F.create_map(*[x for n in names for x in (F.lit(n), value)])

    merged = op.merge_docs(
        old.withColumn("tags", tags("old", "a", "b")),
        new.withColumn("tags", tags("new", "b", "c")),
        ["k"],
    )
    cols = [F.try_element_at("tags", F.lit(t)).alias(f"tags_{t}") for t in "abc"]
    return merged.select("k", "name", "language", "amount", *cols)


@query(
    "d6_update_docs",
    DOCS + """ SELECT o.k, coalesce('later ' || n.name, o.name) AS name, n.language IS NULL AS keeps,
        coalesce(n.language, o.language) AS language, o.amount
      FROM v_docs_old o LEFT JOIN v_docs_new n ON o.k = n.k""",
)
def d6(spark, d):
    """Patches by field path: the flattened new side, names patched a second time."""
    old, new = old_new(spark, d)
    target = old.select(
        "k", F.struct("name", "language").alias("profile"), "amount"
    )
    first = op.flatten_docs(
        new.select("k", F.struct("name", "language").alias("profile"), "amount"), ["k"]
    ).withColumn("seq", F.lit(1))
    second = first.where(F.col("path") == "profile.name").select(
        "k", "path", F.concat(F.lit("later "), "value").alias("value"), F.lit(2).alias("seq")
    )
    result, _ = op.update_docs(target, first.unionByName(second), ["k"])
    patched = new.select("k", F.col("language").alias("_new"))
    return result.join(patched, "k", "left").select(
        "k", "profile.name", F.col("_new").isNull().alias("keeps"), "profile.language", "amount"
    )


@query(
    "d6_update_rejects",
    DOCS + """ SELECT k, 'name' AS path, 'document not found' AS reason FROM v_docs_new
        WHERE name IS NOT NULL AND k NOT IN (SELECT k FROM v_docs_old)
      UNION ALL SELECT k, 'colour', 'unknown field' FROM v_docs_new WHERE name IS NOT NULL""",
)
def d6_rejects(spark, d):
    old, new = old_new(spark, d)
    named = new.where(F.col("name").isNotNull())
    patches = named.select(
        "k", F.explode(F.array(F.lit("name"), F.lit("colour"))).alias("path"),
        F.col("name").alias("value"), F.lit(1).alias("seq"),
    )
    return op.update_docs(old, patches, ["k"])[1].select("k", "path", "reason")


TRA = with_views("v_transcripts", "v_messages")


@query(
    "d7_delete_docs",
    TRA + """ SELECT 'doc' AS what, tid, CAST(NULL AS bigint) AS turn FROM v_transcripts
        WHERE status <> 'live' UNION ALL SELECT 'message', m.tid, m.turn FROM v_messages m
        WHERE m.tid IN (SELECT tid FROM v_transcripts WHERE status <> 'live')""",
)
def d7(spark, d):
    docs = view(spark, d, "v_transcripts")
    gone = docs.where(F.col("status") == "live")
    left, kids = op.delete_docs(docs, gone, ["uid", "tid"], [messages(spark, d)])
    return left.select(
        F.lit("doc").alias("what"), "tid", F.lit(None).cast("long").alias("turn")
    ).unionByName(kids.select(F.lit("message").alias("what"), "tid", "turn"))


@query(
    "d8_flatten_docs",
    """SELECT o_orderkey AS k, 'a.status' AS path, o_orderstatus AS value FROM orders
       UNION ALL SELECT o_orderkey, 'a.b.cust', CAST(o_custkey AS varchar) FROM orders
         WHERE o_orderkey % 3 <> 0
       UNION ALL SELECT o_orderkey, 'list', '["' || o_orderstatus || '","x"]' FROM orders
       UNION ALL SELECT o_orderkey, 'm.p', CAST(o_custkey AS varchar) FROM orders
         WHERE o_orderkey % 4 <> 0
       UNION ALL SELECT o_orderkey, 'm.q', 'y' FROM orders WHERE o_orderkey % 4 <> 0
       UNION ALL SELECT o_orderkey, 'm', '{}' FROM orders WHERE o_orderkey % 4 = 0""",
)
def d8(spark, d):
    cust = F.col("o_custkey").cast("string")
    some = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    full = F.create_map(F.lit("p"), cust, F.lit("q"), F.lit("y"))
    none = F.expr("map()").cast("map<string,string>")
    df = raw(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.struct(
            F.col("o_orderstatus").alias("status"), F.struct(some.alias("cust")).alias("b")
        ).alias("a"),
        F.array("o_orderstatus", F.lit("x")).alias("list"),
        F.when(F.col("o_orderkey") % 4 == 0, none).otherwise(full).alias("m"),
    )
    return op.flatten_docs(df, ["k"])


@query(
    "d9_export_json",
    with_views("v_messages") + """ SELECT uid, tid, turn, '{"role":"' || role || '","body":'
        || CAST(to_json(body) AS varchar) || ',"created_at":"'
        || strftime(make_timestamp(created_epoch * 1000000), '%Y-%m-%dT%H:%M:%S')
        || '+00:00"' || CASE WHEN turn % 2 = 0 THEN ',"translation":"t' || turn || '"' ELSE '' END
        || '}' AS data FROM v_messages""",
)
def d9(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string")))
    df = messages(spark, d).select(
        "uid", "tid", "turn", "role", "body", "created_at", text.alias("translation")
    )
    return export_json(df, ["uid", "tid", "turn"])


@query(
    "d10_version_audit",
    """SELECT CASE WHEN o_orderstatus = 'O' THEN 'plan' ELSE 'transcript' END AS entity,
         CASE WHEN o_custkey % 4 <> 3 THEN '23.12.' || (o_custkey % 4) END AS base_version,
         count(*) AS n
       FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1, 2""",
)
def d10(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "plan").otherwise("transcript")
    version = F.concat(F.lit("23.12."), (F.col("o_custkey") % 4).cast("string"))
    df = raw(spark, d, "orders").select(
        kind.alias("entity"),
        F.when(F.col("o_custkey") % 4 != 3, version).alias("base_version"),
    )
    return op.version_audit(df, "23.12.1")


@query(
    "d13_refresh_docs",
    DOCS + " SELECT * FROM v_docs_old WHERE k IN (SELECT k FROM v_docs_new)",
)
def d13(spark, d):
    old, new = old_new(spark, d)
    return op.refresh_docs(new, old, ["k"])


@query(
    "d14_by_ids",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders "
    "WHERE o_orderpriority = '1-URGENT')",
)
def d14(spark, d):
    urgent = views.query(
        spark, d, "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"
    )
    return op.by_ids(raw(spark, d, "customer").select("c_custkey", "c_name"), urgent)
