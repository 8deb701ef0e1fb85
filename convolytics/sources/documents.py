"""Stored documents: paths, reading, JSON export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolytics.functions import dims
from convolytics.functions.scalars import let, once, rfc3339, territory_part
from convolytics.schemas import DOCUMENTS, PATH_KEYS

# Collection of a user's sub-documents, the entity and its key name.
_UNDER_USER = {"plans": ("plan", "pid"), "transcripts": ("transcript", "tid"),
               "vocab": ("vocab", "bcp47")}


def parse_paths(
    df: DataFrame, col: str = "path", countries: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split document paths into ``entity`` and key columns; invalid ones are rejects."""
    codes = list(countries or dims.countries(df.sparkSession))
    path = F.col(col)

    def keys_of(parts: Column) -> Column:
        return let(_entity(parts), lambda entity: _path_keys(path, parts, entity, codes))

    parsed = once(df, _p=let(F.split(path, "/"), keys_of))
    reason = F.col("_p.reason")
    keys = [F.col(f"_p.{k}") for k in ("entity", "uid", "tid", "pid", "atp", "aid", "bcp47")]
    good = parsed.where(reason.isNull()).select(*df.columns, *keys)
    return good, parsed.where(reason.isNotNull()).select(*df.columns, reason)


def _part(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i))


def _entity(parts: Column) -> Column:
    n, first, third = F.size(parts), _part(parts, 1), _part(parts, 3)
    entity = F.when((n == 2) & (first == "users"), "user")
    for collection, (name, _) in _UNDER_USER.items():
        entity = entity.when((n == 4) & (first == "users") & (third == collection), name)
    return entity.when((n == 4) & (first == "acts"), "act").when(
        (n == 2) & (first == "languages"), "language"
    )


def _path_keys(path: Column, parts: Column, entity: Column, codes: Sequence[str]) -> Column:
    second, fourth = _part(parts, 2), _part(parts, 4)
    tag = F.when(entity == "act", _part(parts, 3)).when(entity == "language", second)
    reason = (
        F.when(path.isNull(), "no path")
        .when(F.size(parts) % 2 != 0, "odd number of parts")
        .when(F.exists(parts, lambda p: p.isin("", "None")), "empty part")
        .when(entity.isNull(), "unknown collection")
        .when((entity == "act") & ~second.isin(*dims.ACT_TYPES), "invalid activity type")
        .when(tag.isNotNull() & ~F.coalesce(territory_part(tag).isin(*codes), F.lit(False)),
              "invalid language")
    )
    return F.struct(
        reason.alias("reason"),
        entity.alias("entity"),
        F.when(_part(parts, 1) == "users", second).alias("uid"),
        F.when(entity == "transcript", fourth).alias("tid"),
        F.when(entity == "plan", fourth).alias("pid"),
        F.when(entity == "act", second).alias("atp"),
        F.when(entity == "act", fourth).alias("aid"),
        F.when(entity == "vocab", fourth).otherwise(tag).alias("bcp47"),
    )


def parse_docs(
    df: DataFrame, entity: str, col: str = "path", data: str = "data"
) -> tuple[DataFrame, DataFrame]:
    """Documents of one entity from a path and a JSON text; keys of the path win.

    Paths of other entities are left out; broken JSON and broken paths are rejects.
    """
    good, rejects = parse_paths(df, col)
    schema = T.StructType.fromDDL(f"{DOCUMENTS[entity]}, _broken string")
    keys = PATH_KEYS[entity]
    mine = once(
        good.where(F.col("entity") == entity),
        _doc=F.from_json(data, schema, {"columnNameOfCorruptRecord": "_broken"}),
    )
    broken = F.col("_doc").isNull() | F.col("_doc._broken").isNotNull()
    extra = [c for c in df.columns if c not in (col, data)]
    body = [F.col(f"_doc.{f.name}") for f in schema if f.name not in (*keys, "_broken")]
    bad = mine.where(broken).select(*df.columns, F.lit("invalid document").alias("reason"))
    return mine.where(~broken).select(*extra, *keys, *body), rejects.unionByName(bad)


def read_docs(
    spark: SparkSession, location: str, entity: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Read stored documents: rows of ``path`` and JSON ``data`` in parquet or JSON lines."""
    reader = spark.read.schema("path string, data string")
    return parse_docs(reader.format(fmt).load(location), entity)


def explode_messages(docs: DataFrame) -> DataFrame:
    """Message rows of transcript documents."""
    return docs.select("uid", "tid", F.explode("messages").alias("mid", "_m")).select(
        "uid", "tid", "mid", "_m.*"
    )


def _json_ready(col: Column, kind: T.DataType) -> Column:
    """The same value with times as RFC 3339 text, at any depth."""
    if isinstance(kind, T.TimestampType):
        return rfc3339(col)
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_json_ready(col[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(col.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _json_ready(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: _json_ready(v, kind.valueType))
    return col


def export_json(
    df: DataFrame, drop: Sequence[str], keep: Sequence[str] | None = None, out: str = "data"
) -> DataFrame:
    """Documents as JSON text without nulls and without the ``drop`` fields.

    The columns in ``keep`` (by default ``drop``) stay next to the text.
    """
    fields = [f for f in df.schema if f.name not in drop]
    body = F.struct(*[_json_ready(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return df.select(*(drop if keep is None else keep), F.to_json(body).alias(out))
