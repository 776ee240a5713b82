"""Structured Streaming jobs for the incremental paths; each runs with ``availableNow`` and ends."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quotemill.operators.keyed import ranked_dedupe
from quotemill.sources import sinks


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files at ``path``, a folder or one file: as a pattern it may be either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")


class KeyedTable:
    """A keyed table in partitions under a folder: a batch replaces the partitions that its keys lie in, and no other file.

    ``part`` says from the keys where a row lies, a hash of the keys by default.  Of rows of one key the first in ``order`` (descending, nulls
    last) stays, so a batch that is played again changes nothing, and one that breaks off is finished by the next."""

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], root: str | None = None, part: Column | None = None, parts: int = 32):
        self.spark, self.keys, self.order = spark, keys, order
        self.root = root or sinks.scratch(spark, "table")
        self.rows = f"{self.root}/rows"
        self.part = F.pmod(F.xxhash64(*keys), F.lit(parts)) if part is None else part

    def read(self) -> DataFrame:
        sinks.recover(self.spark, self.rows)
        return sinks.stored_table(self.spark, self.rows).drop("part")

    def take(self, batch: DataFrame, number: int) -> None:
        best = lambda df: ranked_dedupe(df, self.keys, [F.desc_nulls_last(c) for c in self.order])
        new = best(batch).withColumn("part", self.part)
        if not sinks.exists(self.spark, self.rows):
            sinks.overwrite_partitions(new, self.rows, "part")
            return
        sinks.recover(self.spark, self.rows)
        stored = sinks.stored_table(self.spark, self.rows).join(new.select("part").distinct(), "part", "left_semi")
        had = stored.join(new.select(*self.keys), self.keys, "left_semi")
        sinks.merge_partitions(best(had.unionByName(new, allowMissingColumns=True)), self.rows, self.keys, "part")


class LateRows(StreamingQueryListener):
    """The progress of queries as rows: what each batch read and what its watermark dropped.

    Dropped rows are counted where a stateful operator meets them: for aggregates these are partial groups, for
    ``dropDuplicatesWithinWatermark`` they are rows of the stream."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.rows.append((str(p.runId), p.batchId, p.numInputRows, dropped, dict(p.eventTime).get("watermark")))

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def write(self, spark: SparkSession, path: str) -> None:
        """Append what was heard since the last call to a table: run_id, batch, rows_in, dropped, watermark."""
        heard, self.rows = self.rows, []
        spark.createDataFrame(heard, "run_id string, batch long, rows_in long, dropped long, watermark string").coalesce(1).write.mode("append").parquet(path)


@contextlib.contextmanager
def audited(spark: SparkSession, path: str):
    """Notes of the batches of one query that is run inside, as a table at ``path``."""
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
        listener.write(spark, path)


def late_by_batch(rows: DataFrame, batch: str, at: str, late: str) -> DataFrame:
    """The same count from stored rows with their batch: batch, rows_in, dropped.

    A batch's rows are late at or before the watermark that the batch before it was run with, which is the greatest time (in whole
    milliseconds) of the batches before that one, less ``late``."""
    each = rows.groupBy(batch).agg(F.max(at).alias("top"), F.count("*").alias("rows_in"))
    before = W.orderBy(batch).rowsBetween(W.unboundedPreceding, -2)  # one row for each batch
    mark = F.date_trunc("millisecond", F.max("top").over(before)) - F.expr(f"interval {late}")
    marks = each.select(F.col(batch).alias("of"), "rows_in", mark.alias("mark"))
    out = rows.join(marks, F.col(batch) == F.col("of"))
    return out.groupBy(F.col("of").alias("batch"), "rows_in").agg(F.count_if(F.coalesce(F.col(at) <= F.col("mark"), F.lit(False))).alias("dropped"))


def run_into(source: DataFrame, table: KeyedTable) -> StreamingQuery:
    """Drain a stream into a keyed table; offsets stay with the table, so the next run goes on where this one ends."""
    q = source.writeStream.foreachBatch(table.take).option("checkpointLocation", f"{table.root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_by_day(board: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of quotes -> the newest of each symbol and day, in update mode."""
    b = board.withWatermark("snapshot_at", late).groupBy("symbol", F.window("snapshot_at", "1 day").alias("day"))
    return b.agg(F.max("snapshot_at").alias("snapshot_at"), F.max_by("close_price", "snapshot_at").alias("close_price")).select("symbol", F.to_date("day.start").alias("trading_date"), "snapshot_at", "close_price")


def first_articles(news: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of articles without repeats of an id within the watermark."""
    return news.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["article_id"])


def drained(source: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """A stream's output as a table: appended rows, or the last update of each batch, by ``__batch``.  A batch that is played again replaces itself, and a
    run with the same ``root`` goes on where the last one ended."""
    spark = source.sparkSession
    root = root or sinks.scratch(spark, "drained")

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/__batch={number}")

    q = source.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")
