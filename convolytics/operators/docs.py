"""Document tables: create, set, merge, update by field path, delete, flatten, audit.

Targets hold one row per key. All joins are equi-joins on that key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _arrival(new: DataFrame, k: Sequence[str], seq: str | None) -> Column:
    """What orders rows of one key: ``seq``, then the content."""
    fields = [c for c in new.columns if c not in (*k, seq)]
    content = F.to_json(F.struct(*fields)) if fields else F.lit("")
    return content if seq is None else F.struct(F.col(seq), content)


def _latest(new: DataFrame, k: Sequence[str], seq: str | None) -> DataFrame:
    """One row per key: the last to arrive."""
    row = F.struct(*[c for c in new.columns if c != seq])
    last = new.groupBy(*k).agg(F.max_by(row, _arrival(new, k, seq)).alias("_row"))
    return last.select("_row.*")


def create_docs(
    target: DataFrame, new: DataFrame, k: Sequence[str], seq: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Insert documents whose key is absent; the others come back as conflicts.

    Of new rows with one key the first by ``seq`` (a column that is dropped; else by
    content) is inserted, the later ones are conflicts.
    """
    keys, known = list(k), target.select(*k)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(_arrival(new, k, seq)))
    rows = new.withColumn("_n", nth)
    rows = rows.drop(seq) if seq else rows
    fresh = rows.join(known, keys, "left_anti")
    late = fresh.where(F.col("_n") > 1).unionByName(rows.join(known, keys, "left_semi"))
    return target.unionByName(fresh.where(F.col("_n") == 1).drop("_n")), late.drop("_n")


def set_docs(
    target: DataFrame, new: DataFrame, k: Sequence[str], seq: str | None = None
) -> DataFrame:
    """Replace whole documents, or insert them; of new rows with one key the last counts."""
    return target.join(new.select(*k), list(k), "left_anti").unionByName(_latest(new, k, seq))


def _merge(old: Column, new: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        both = F.struct(*[_merge(old[f.name], new[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)
    if isinstance(kind, T.MapType):
        zipped = F.map_zip_with(old, new, lambda _, a, b: _merge(a, b, kind.valueType))
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(zipped)
    return F.coalesce(new, old)


def merge_docs(
    target: DataFrame, new: DataFrame, k: Sequence[str], seq: str | None = None
) -> DataFrame:
    """Set the fields that are present (not NULL) and keep the rest.

    Structs and maps merge by field and key; arrays are replaced. Of new rows with one key
    the last by ``seq`` (a column that is dropped; else by content) counts.
    """
    new = _latest(new, k, seq)
    fields = [f for f in target.schema if f.name not in k]
    old = target.withColumnsRenamed({f.name: f"_old_{f.name}" for f in fields})
    joined = old.join(new, list(k), "full_outer")
    merged = [
        _merge(F.col(f"_old_{f.name}"), F.col(f.name), f.dataType).alias(f.name) for f in fields
    ]
    return joined.select(*k, *merged)


def _leaves(kind: T.StructType, at: Column | None = None, prefix: str = ""):
    """(path, value, type) of every leaf of a schema; structs are descended."""
    for f in kind:
        col = F.col(f.name) if at is None else at[f.name]
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, col, f"{path}.")
        else:
            yield path, col, f.dataType


def _as_text(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def _flat_map(path: Column, col: Column, kind: T.DataType) -> Column:
    """Path and value pairs below a map (or one pair for any other value)."""
    if isinstance(kind, T.StructType):
        pairs = [_flat_map(F.concat(path, F.lit(f".{f.name}")), col[f.name], f.dataType)
                 for f in kind]
        return F.concat(*pairs)
    one = F.array(F.struct(path.alias("path"), _as_text(col, kind).alias("value")))
    if isinstance(kind, T.MapType):
        inner = F.flatten(
            F.transform(
                F.map_entries(col),
                lambda e: _flat_map(
                    F.concat(path, F.lit("."), e["key"].cast("string")),
                    e["value"],
                    kind.valueType,
                ),
            )
        )
        empty = F.array(F.struct(path.alias("path"), F.lit("{}").alias("value")))
        nothing = F.filter(one, lambda _: F.lit(False))
        return F.when(col.isNull(), nothing).when(F.size(col) == 0, empty).otherwise(inner)
    return one


def flatten_docs(df: DataFrame, k: Sequence[str]) -> DataFrame:
    """One row per leaf: dotted path and value as text; NULL leaves have no row.

    An empty map is the leaf ``{}``; lists are leaves, as JSON.
    """
    body = T.StructType([f for f in df.schema if f.name not in k])
    pairs = [_flat_map(F.lit(p), col, kind) for p, col, kind in _leaves(body)]
    return (
        df.select(*k, F.explode(F.concat(*pairs)).alias("_p"))
        .select(*k, "_p.path", "_p.value")
        .where(F.col("value").isNotNull())
    )


def _paths_of(kind: T.DataType) -> str:
    """Pattern of what may follow a field of this type in a path."""
    if isinstance(kind, T.StructType):
        names = [re.escape(f.name) + _paths_of(f.dataType) for f in kind]
        return rf"\.(?:{'|'.join(names)})"
    if isinstance(kind, T.MapType):
        return rf"(?:\.[^.]+{_paths_of(kind.valueType)})?"
    return ""


def _patched(kind: T.DataType, patch: Column, old: Column, path: Column) -> Column:
    """``old`` with the entries of ``patch`` at or below ``path`` put in."""
    below = F.concat(path, F.lit("."))
    if isinstance(kind, T.StructType):
        fields = [
            _patched(f.dataType, patch, old[f.name], F.concat(below, F.lit(f.name))).alias(f.name)
            for f in kind
        ]
        touched = F.exists(F.map_keys(patch), lambda p: F.startswith(p, below))
        return F.when(old.isNotNull() | touched, F.struct(*fields))
    text = F.try_element_at(patch, path)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.from_json(text, kind), old)
    if not isinstance(kind, T.MapType):
        return F.coalesce(text.cast(kind), old)

    whole = F.coalesce(F.from_json(text, kind), old)
    hits = F.filter(F.map_keys(patch), lambda p: F.startswith(p, below))
    named = F.transform(
        hits, lambda p: F.split_part(F.substr(p, F.length(below) + 1), F.lit("."), F.lit(1))
    )
    new = F.transform(
        F.array_distinct(named),
        lambda k: F.struct(
            k.alias("key"),
            _patched(
                kind.valueType, patch, F.try_element_at(whole, k), F.concat(below, k)
            ).alias("value"),
        ),
    )
    none = F.expr("map()").cast(kind.simpleString())
    return F.when(F.size(hits) == 0, whole).otherwise(
        F.map_zip_with(
            F.coalesce(whole, none),
            F.map_from_entries(new).cast(kind.simpleString()),
            lambda _, a, b: F.coalesce(b, a),
        )
    )


def update_docs(
    target: DataFrame, patches: DataFrame, k: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Patch named leaves only. ``patches`` holds the key, ``path``, ``value`` and ``seq``.

    Paths go into structs and, by key, into maps (keys without dots); a list or a whole
    map is given as JSON. Of several patches of one path the highest ``seq`` wins.
    Patches of missing documents are rejects, as are paths the documents do not have.
    """
    keys = list(k)
    body = [f for f in target.schema if f.name not in k]
    pattern = "|".join(re.escape(f.name) + _paths_of(f.dataType) for f in body)
    fits = F.coalesce(F.col("path").rlike(f"^(?:{pattern})$"), F.lit(False))
    known = patches.where(fits)
    latest = known.groupBy(*keys, "path").agg(F.max_by("value", "seq").alias("value"))
    # The patches of one document are no more than its leaves.
    maps = latest.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_patch")
    )
    patch = F.coalesce("_patch", F.expr("map()").cast("map<string,string>"))
    patched = [
        _patched(f.dataType, F.col("_patch"), F.col(f.name), F.lit(f.name)).alias(f.name)
        for f in body
    ]
    result = (
        target.join(maps, keys, "left").withColumn("_patch", patch).select(*keys, *patched)
    )
    no_doc = known.join(target.select(*keys), keys, "left_anti")
    return result, no_doc.withColumn("reason", F.lit("document not found")).unionByName(
        patches.where(~fits).withColumn("reason", F.lit("unknown field"))
    )


def delete_docs(
    target: DataFrame, gone: DataFrame, k: Sequence[str], children: Sequence[DataFrame] = ()
) -> tuple[DataFrame, ...]:
    """Drop documents and the rows of their child tables (which carry the same key)."""
    keys = list(k)
    marks = gone.select(*keys).distinct()
    return tuple(t.join(marks, keys, "left_anti") for t in (target, *children))


def refresh_docs(local: DataFrame, stored: DataFrame, k: Sequence[str]) -> DataFrame:
    """The stored version of local rows; local changes are lost."""
    return stored.join(local.select(*k).distinct(), list(k), "left_semi")


def by_ids(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is listed."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def version_audit(df: DataFrame, current: str) -> DataFrame:
    """How many documents of an entity were written by another version."""
    return (
        df.where(~F.col("base_version").eqNullSafe(F.lit(current)))
        .groupBy("entity", "base_version")
        .agg(F.count(F.lit(1)).alias("n"))
    )
