"""Learning-platform tables derived from the given benchmark tables.

The texts run unchanged in Spark SQL and in the SQL engine used as oracle, so both
sides start from the same rows. Times are epoch seconds here and become timestamps
in ``table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANG_OF = (
    "CASE conv_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'es-MX' WHEN 2 THEN 'fr-FR' ELSE 'de-DE' END"
)
ATP_OF = (
    "CASE o_custkey % 5 WHEN 0 THEN 'min' WHEN 1 THEN 'unstr' WHEN 2 THEN 'intro' "
    "WHEN 3 THEN 'guided' ELSE 'drill' END"
)
ORDER_LANG = "CASE o_orderstatus WHEN 'O' THEN 'en-US' WHEN 'F' THEN 'es-MX' ELSE 'fr-FR' END"
COUNTRY_OF = (
    "CASE lang WHEN 'en' THEN 'US' WHEN 'es' THEN 'MX' WHEN 'fr' THEN 'FR' ELSE 'DE' END"
)
EVENT_DIM = (
    "CASE event_type WHEN 'signup' THEN 'vocab' WHEN 'purchase' THEN 'grammar' "
    "WHEN 'error' THEN 'idiom' WHEN 'view' THEN 'polite' ELSE 'context' END"
)

VIEWS = {
    "v_messages": f"""
        SELECT conv_id % 17 AS uid, conv_id AS tid, turn,
               CASE role WHEN 'user' THEN 'usr' WHEN 'assistant' THEN 'ast'
                         WHEN 'system' THEN 'sys' END AS role,
               text AS body, 1704067200 + conv_id * 3600 + turn * 60 AS created_epoch,
               {LANG_OF} AS bcp47
        FROM conversations""",
    "v_transcripts": f"""
        SELECT DISTINCT conv_id % 17 AS uid, conv_id AS tid,
               CASE WHEN conv_id % 5 = 0 THEN 'live' ELSE 'final' END AS status,
               1704067200 + conv_id * 3600 - 30 AS created_epoch, {LANG_OF} AS bcp47
        FROM conversations
        UNION ALL
        SELECT DISTINCT conv_id % 17, -conv_id, 'live', 1704067200 + conv_id * 3600, 'en-US'
        FROM conversations WHERE conv_id % 7 = 0 AND conv_id > 0""",
    "v_scores": f"""
        SELECT user_id % 17 AS uid, user_id AS tid, event_id AS mid,
               CASE WHEN event_id % 3 = 0 THEN 'ast' ELSE 'usr' END AS role, {EVENT_DIM} AS dim,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    ELSE CAST(floor(value) AS bigint) % 5 END AS score
        FROM events""",
    "v_replies": f"""
        SELECT event_id AS mid, user_id AS tid, {EVENT_DIM} AS dim,
               CASE WHEN event_id % 13 = 0 THEN 'ADULT'
                    WHEN event_id % 17 = 0 THEN 'ADULT; a; b'
                    WHEN event_id % 19 = 0 THEN 'WOW; not a level'
                    WHEN event_type IN ('signup', 'purchase') THEN
                         CASE CAST(floor(value) AS bigint) % 5
                              WHEN 0 THEN 'ERROR' WHEN 1 THEN 'baby' WHEN 2 THEN 'CHILD'
                              WHEN 3 THEN 'Adult' ELSE 'EXPERT' END
                         || '; because ' || CAST(event_id AS varchar(20))
                    ELSE CASE CAST(floor(value) AS bigint) % 5
                              WHEN 0 THEN 'NO' WHEN 1 THEN 'slight' WHEN 2 THEN 'SOMEWHAT'
                              WHEN 3 THEN 'Mostly' ELSE 'YES' END
                         || '; because ' || CAST(event_id AS varchar(20)) END AS reply
        FROM events""",
    "v_usage_flags": """
        SELECT user_id % 17 AS uid, 'en-US' AS bcp47, event_type AS term, user_id AS tid,
               event_id AS mid,
               CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS used_correctly
        FROM events""",
    "v_acts": f"""
        SELECT o_orderkey AS aid, {ATP_OF} AS atp, {ORDER_LANG} AS bcp47,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS created_at
        FROM orders""",
    "v_plans": f"""
        SELECT o_orderkey AS pid, o_custkey AS uid,
               CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS aid,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'zzz'
                    ELSE {ATP_OF} END AS atp,
               {ORDER_LANG} AS bcp47,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'en-US-Wavenet-A' END AS voice_model
        FROM orders WHERE o_orderkey % 41 <> 0""",
    "v_plan_refs": "SELECT o_orderkey AS pid, o_custkey AS uid FROM orders",
    "v_users": """
        SELECT c_custkey AS uid, c_name AS name,
               CASE c_custkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'es-MX' ELSE 'fr-FR' END
                   AS language
        FROM customer""",
    "v_days": """
        SELECT o_custkey AS uid, o_orderkey AS tid, o_orderdate AS ended_at,
               CASE WHEN o_orderstatus = 'P' THEN 'empty' ELSE 'final' END AS status
        FROM orders""",
    "v_paths": """
        SELECT o_orderkey AS n,
               CASE o_orderkey % 8
                 WHEN 0 THEN 'users/' || CAST(o_custkey AS varchar(20)) || '/plans/'
                             || CAST(o_orderkey AS varchar(20))
                 WHEN 1 THEN 'users/' || CAST(o_custkey AS varchar(20)) || '/transcripts/'
                             || CAST(o_orderkey AS varchar(20))
                 WHEN 2 THEN 'acts/min/en-US/' || CAST(o_orderkey AS varchar(20))
                 WHEN 3 THEN 'users/' || CAST(o_custkey AS varchar(20))
                 WHEN 4 THEN 'acts/zzz/en-US/' || CAST(o_orderkey AS varchar(20))
                 WHEN 5 THEN 'users/None/plans/' || CAST(o_orderkey AS varchar(20))
                 WHEN 6 THEN 'acts/unstr/en/' || CAST(o_orderkey AS varchar(20))
                 ELSE 'users/' || CAST(o_custkey AS varchar(20)) || '/plans' END AS path,
               o_orderstatus AS status
        FROM orders""",
    "v_docs_old": """
        SELECT c_custkey AS k, c_name AS name, c_mktsegment AS language, c_acctbal AS amount
        FROM customer WHERE c_custkey % 3 <> 0""",
    "v_docs_new": """
        SELECT c_custkey AS k,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new ' || c_name END AS name,
               CASE WHEN c_custkey % 5 = 0 THEN 'en-US' ELSE NULL END AS language,
               CAST(NULL AS double) AS amount
        FROM customer WHERE c_custkey % 2 = 0""",
    "v_tags": f"""
        SELECT doc_id,
               CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 11 = 0 THEN lang || '-QQ'
                    ELSE lang || '-' || {COUNTRY_OF} END AS tag,
               lang || '-' || {COUNTRY_OF}
                    || CASE WHEN doc_id % 2 = 0 THEN '-Wavenet-A' ELSE '-Standard-B' END
                    AS voice_model
        FROM documents""",
    "v_logs": """
        SELECT event_id, ts,
               CASE event_type WHEN 'signup' THEN 'SUCCESS' WHEN 'purchase' THEN 'TRACE'
                    WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
               CASE WHEN event_id % 2 = 0
                    THEN '[START] fn' || CAST(user_id % 10 AS varchar(20))
                    ELSE '[END] fn' || CAST(user_id % 10 AS varchar(20)) || ' ('
                         || CAST(CAST(floor(value) AS bigint) AS varchar(20)) || '.'
                         || lpad(CAST(event_id % 1000 AS varchar(20)), 3, '0') || 's)' END
                    AS message
        FROM events""",
}

_TABLES = ("conversations", "events", "documents", "orders", "customer")


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(
    spark: SparkSession, folder: str, text: str, given: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run Spark SQL over the given tables; wall-clock times are taken as UTC.

    ``given`` replaces tables, for instance by streams of them.
    """
    given = given or {}
    named = {t: given[t] if t in given else raw(spark, folder, t) for t in _TABLES if t in text}
    for t in named:
        text = _name(text, t)
    df = spark.sql(text, **named)
    ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def _name(text: str, table: str) -> str:
    return text.replace(f"FROM {table}", "FROM {" + table + "}")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return query(spark, folder, VIEWS[name])


def with_views(*names: str) -> str:
    """``WITH`` clause of an oracle text."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
