"""Incremental scoring: a stream of records is deduplicated by key, scored and appended, with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.rules import score_rows
from ..operators.selection import by_value
from ..sources import folders, scratch


def once_within(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream's rows, each key once within `late` of its event time. Rows that come after the watermark has passed them are
    dropped, and so is what is kept of a key, so what is kept grows with the delay and not with the stream; a key that
    comes again after that counts as new."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def scored_stream(records: DataFrame, key: str = "response_id", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """records with rules scored, each key once: within `late` of event time if there is one, else for good."""
    once = once_within(records, key, time, late) if time else records.dropDuplicates([key])
    return score_rows(once)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there now, appended as Parquet; run again after a stop it goes on where it was."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def score_available(records: DataFrame, out: str, checkpoint: str, key: str = "response_id") -> None:
    """Like run_available(scored_stream(records, key)), for large streams: keys that were seen are kept in RocksDB on disk and not in
    memory, and equal texts of a batch are scored once. A batch is a folder of `out` that appears whole, so one that is replayed adds
    nothing."""
    spark, provider = records.sparkSession, "spark.sql.streaming.stateStore.providerClass"

    def write(batch: DataFrame, number: int) -> None:
        if not folders.exists(spark, f"{out}/batch={number}"):
            rows = by_value(scratch.keep(batch, "batch"), ["question", "answer"], score_rows)
            folders.publish(rows, out, f"batch={number}", "parquet")

    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        once = records.dropDuplicates([key])
        once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)


def finalized(spark: SparkSession, out: str) -> DataFrame:
    """Batch metrics of what has been scored."""
    return spark.read.parquet(out).groupBy("constraint_family").agg(F.count("*").alias("n"), F.avg("constraint_score").alias("mean_constraint"))


def violation_rate(events: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Beyond the batch metrics: the rate of flagged events by window, for monitoring; `flagged` is boolean."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(F.col("flagged").cast("double")).alias("rate"))


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch took in; `told(rows)` is called whenever `every` more rows have been scored."""

    def __init__(self, every: int = 25, told=print):
        self.every, self.told, self.rows = every, told, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        before, self.rows = self.rows, self.rows + event.progress.numInputRows
        if self.rows // self.every > before // self.every:
            self.told(self.rows)
