"""A keyed table that streams append to: hash buckets, a base and later batches.

Layout under ``path``::

    base/version=V/bucket=B/        everything up to version V
    batches/source=S/batch_id=K/bucket=B/    what batch K of stream S brought
    pointer/version=V/              which base is valid, and the last batch in it, per stream

A batch overwrites its own folder when Spark replays it. Compaction writes a new base first and
its pointer last, so a reader sees either the old base with its batches or the new one; batches
that a base holds are left out, a late replay of one included.

Rows lie in buckets by the hash of their key. A reader that names its keys reads only the
buckets they fall into. Compaction doubles the number of buckets while they hold more than
``bucket_rows`` rows on average, and is due when the batches outgrow the base, so that a
batch's lookup reads a bounded number of rows per key and rows are rewritten a logarithmic
number of times. Older bases are not removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "depth int, rows long, batches map<string,long>, version long"
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
#: Compaction is not due before the batches hold so many rows.
LEAST_ROWS = 100_000


def source_of(checkpoint: str) -> str:
    """A name for a stream: its batch numbers count within its checkpoint."""
    return uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex


class KeyedTable:
    """Rows of ``schema`` by ``keys`` under ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str | T.StructType,
        keys: Sequence[str],
        bucket_rows: int = 1_000_000,
        first_depth: int = 4,
    ):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        self.bucket_rows, self.first_depth = bucket_rows, first_depth

    def _read(self, folder: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() in MISSING:
                return None
            raise

    def pointer(self) -> dict:
        """The newest pointer; there are as many as compactions."""
        nothing = {"version": -1, "depth": self.first_depth, "rows": 0, "batches": {}}
        known = self._read("pointer", T.StructType.fromDDL(POINTER))
        row = None if known is None else known.orderBy(F.col("version").desc()).first()
        return nothing if row is None else row.asDict()

    def bucket(self, depth: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(1 << depth)).cast("int")

    def _placed(self, rows: DataFrame, depth: int, folder: str) -> None:
        # One file per bucket and at most one bucket per task; a batch with few keys has few.
        parts = min(1 << depth, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        placed = rows.select(*self.columns).withColumn("bucket", self.bucket(depth))
        placed.repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/{folder}"
        )

    def holds(self, source: str, batch_id: int) -> bool:
        """Whether the base has this batch already."""
        return batch_id <= self.pointer()["batches"].get(source, -1)

    def append(self, rows: DataFrame, source: str, batch_id: int) -> None:
        """Write what a batch brings. A batch that the base holds changes nothing."""
        now = self.pointer()
        if batch_id > now["batches"].get(source, -1):
            self._placed(rows, now["depth"], f"batches/source={source}/batch_id={batch_id}")

    def _batches(self, now: dict) -> DataFrame | None:
        extra = "source string, batch_id long, bucket int"
        schema = T.StructType([*self.schema.fields, *T.StructType.fromDDL(extra).fields])
        rows = self._read("batches", schema)
        if rows is None:
            return None
        in_base = [
            (F.col("source") == s) & (F.col("batch_id") <= k) for s, k in now["batches"].items()
        ]
        return rows.where(~reduce(lambda a, b: a | b, in_base)) if in_base else rows

    def read(
        self, touching: DataFrame | None = None, without: tuple[str, int] | None = None
    ) -> DataFrame:
        """All rows; with ``touching`` (keys) the buckets of these keys only; ``without`` one
        (source, batch_id) that is being written, and later ones of its stream."""
        now = self.pointer()
        parts = []
        if now["version"] >= 0:
            schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
            parts.append(self._read(f"base/version={now['version']}", schema))
        batches = self._batches(now)
        if batches is not None:
            if without is not None:
                source, batch_id = without
                batches = batches.where((F.col("source") != source) | (F.col("batch_id") < batch_id))
            parts.append(batches)
        parts = [p for p in parts if p is not None]
        if touching is not None and parts:
            # At most as many numbers as there are buckets.
            wanted = [r[0] for r in touching.select(self.bucket(now["depth"])).distinct().collect()]
            parts = [p.where(F.col("bucket").isin(wanted)) for p in parts]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return reduce(DataFrame.unionByName, [p.select(*self.columns) for p in parts])

    def compact(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Write a new base of ``merge`` over all rows, then point to it."""
        now = self.pointer()
        batches = self._batches(now)
        if batches is None:
            return
        newest = {r[0]: r[1] for r in batches.groupBy("source").agg(F.max("batch_id")).collect()}
        version, depth = now["version"] + 1, now["depth"]
        rows = merge(self.read())
        while (now["rows"] + batches.count()) >> depth > self.bucket_rows:
            depth += 1
        self._placed(rows, depth, f"base/version={version}")
        written = self._read(f"base/version={version}", self.schema)
        n = 0 if written is None else written.count()
        pointer = T.StructType.fromDDL(POINTER.rsplit(",", 1)[0])
        row = (depth, n, now["batches"] | newest)
        self.spark.createDataFrame([row], pointer).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/pointer/version={version}"
        )

    def compact_if_due(self, merge: Callable[[DataFrame], DataFrame], least: int = LEAST_ROWS) -> bool:
        """Compact once the batches hold at least as many rows as the base, and ``least``."""
        now = self.pointer()
        batches = self._batches(now)
        if batches is None or batches.count() < max(least, now["rows"]):
            return False
        self.compact(merge)
        return True
