"""The score cache: appended in small parts, compacted now and then, read at any time.

An append publishes one part, `delta=n`. A compaction merges the base and the parts there are, the last entry of each key,
into a new base in folders by hash of the key, and then publishes a state that names it and the last part in it. The
newest state is the cache, together with the parts behind it. States, bases and parts appear whole by a rename and
are never changed, so a reader sees the cache before a compaction or after it, and of two compactions at once the
second is dropped. What no state needs any more is removed by vacuum().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders
from .io import latest


class ScoreCache:
    """schema: of the entries, with the key and `order`, which tells entries of one append apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets
        self.full = f"{schema}, cache_part bigint"

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(map(int, folders.names(self.spark, f"{self.path}/{folder}", prefix)))

    def append(self, rows: DataFrame) -> int:
        """The number of the part."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        while True:
            n = max(self._numbers("delta", "delta="), default=max(0, self.state()["upto"])) + 1
            if folders.publish(rows.select(*names), f"{self.path}/delta", f"delta={n}", "parquet"):
                return n

    def state(self) -> dict:
        """version, base and the last part in it; of the newest state."""
        known = self._numbers("state", "version=")
        if not known:
            return {"version": 0, "base": None, "upto": 0}
        row = self.spark.read.schema("base string, upto bigint").json(f"{self.path}/state/version={known[-1]}").first()
        return {"version": known[-1], "base": row["base"], "upto": row["upto"]}

    def _entries(self, state: dict, last: int | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.full)
        if state["base"]:
            base = self.spark.read.parquet(f"{self.path}/base/{state['base']}")
            out = base.select(*out.columns).unionByName(out)
        for n in self._numbers("delta", "delta="):
            if state["upto"] < n <= (n if last is None else last):
                part = self.spark.read.schema(self.schema).parquet(f"{self.path}/delta/delta={n}")
                out = out.unionByName(part.withColumn("cache_part", F.lit(n).cast("long")))
        return out

    def _merged(self, entries: DataFrame) -> DataFrame:
        at = entries.withColumn("cache_at", F.struct("cache_part", self.order))
        return latest(at, self.key, "cache_at").drop("cache_at")

    def read(self) -> DataFrame:
        """The last entry of each key: of later parts first, then by `order`."""
        return self._merged(self._entries(self.state())).drop("cache_part")

    def compact(self) -> bool:
        """False if there is nothing to merge, or another compaction was first."""
        state, parts = self.state(), self._numbers("delta", "delta=")
        if not parts or parts[-1] <= state["upto"]:
            return False
        base = f"base-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).alias("cache_bucket")
        merged = self._merged(self._entries(state, parts[-1])).select("*", bucket).repartition("cache_bucket")
        folders.publish(merged, f"{self.path}/base", base, "parquet", ("cache_bucket",))
        new = self.spark.createDataFrame([(base, parts[-1])], "base string, upto bigint").coalesce(1)
        if folders.publish(new, f"{self.path}/state", f"version={state['version'] + 1}"):
            return True
        folders.remove(self.spark, f"{self.path}/base/{base}")
        return False

    def vacuum(self) -> None:
        """Removes what the newest state does not need; readers of older states must be done."""
        state = self.state()
        for base in folders.names(self.spark, f"{self.path}/base", "base-"):
            if f"base-{base}" != state["base"]:
                folders.remove(self.spark, f"{self.path}/base/base-{base}")
        for n in self._numbers("delta", "delta="):
            if n <= state["upto"]:
                folders.remove(self.spark, f"{self.path}/delta/delta={n}")
        for n in self._numbers("state", "version="):
            if n < state["version"]:
                folders.remove(self.spark, f"{self.path}/state/version={n}")
