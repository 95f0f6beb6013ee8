"""An append-only log of scored rows, written batch by batch, each key once, whatever is replayed.

A batch is written to a folder of its own as JSON lines, its share of the metrics beside it, and then entered in the ledger
by one rename. Readers take the batches that the ledger names. A batch that is stopped between writing and entering is
written again over what it left; one that is replayed after it was entered does nothing. Keys that entered batches
hold are skipped, so a run that starts with a new checkpoint, or is fed the same rows again, adds nothing. The
metrics of the log are the sum of the batches' own and need no scan of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import first_of
from ..sources import folders


class Ledger:
    """out: the folder; key: what is logged once; sums: metrics by `by`, as sums over the rows of a batch; between: called with
    the number of a batch after it is written and before it is entered, for tests."""

    def __init__(self, spark: SparkSession, out: str, key: str, schema: str, by: tuple[str, ...], sums: dict[str, Column], between: Callable[[int], None] | None = None):
        self.spark, self.out, self.key, self.schema, self.by, self.sums, self.between = spark, out, key, schema, by, sums, between

    def entered(self) -> list[str]:
        return folders.names(self.spark, f"{self.out}/ledger", "batch=")

    def _read(self, part: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json([f"{self.out}/{part}/batch={b}" for b in batches])

    def log(self) -> DataFrame:
        return self._read("log", self.schema, self.entered())

    def keys(self) -> DataFrame:
        return self.log().select(self.key)

    def metrics(self) -> DataFrame:
        """by and the sums over all that is logged."""
        parts = self._read("metrics", self._metric_schema(), self.entered())
        return parts.groupBy(*self.by).agg(*(F.sum(k).alias(k) for k in self.sums))

    def _metric_schema(self) -> str:
        kinds = self.spark.createDataFrame([], self.schema).groupBy(*self.by).agg(*(c.alias(k) for k, c in self.sums.items()))
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema)

    def write(self, batch: DataFrame, number: int) -> None:
        """The sink of foreachBatch."""
        done = self.entered()
        if str(number) in done:
            return
        new = first_of(batch, [self.key]).join(self._read("log", self.schema, done).select(self.key), self.key, "left_anti")
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        new.select(*names).write.mode("overwrite").json(f"{self.out}/log/batch={number}")
        written = self._read("log", self.schema, [str(number)])  # what was written, and nothing that is worked out anew
        written.groupBy(*self.by).agg(*(c.alias(k) for k, c in self.sums.items())).write.mode("overwrite").json(f"{self.out}/metrics/batch={number}")
        if self.between:
            self.between(number)
        entry = written.agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).coalesce(1)
        folders.publish(entry, f"{self.out}/ledger", f"batch={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All that is there now; numbers of batches are those of this checkpoint."""
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
