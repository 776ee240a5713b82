"""Registered queries of sinks, the audit log and streaming jobs: each writes to the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators.keyed import ranked_dedupe
from quotemill.plans.registry import query
from quotemill.sources import sinks
from quotemill.sources.proxy import Tables
from quotemill.streaming import jobs


@query("select ticker, trading_date, close + 1 as close from price")
def sink_overwrite_single(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "single")
    p = t.price().select("ticker", "trading_date", "close")
    sinks.overwrite(p, path)
    sinks.overwrite(p.withColumn("close", F.col("close") + 1), path)
    return t.spark.read.parquet(path)


@query("select ticker, trading_date, case when trading_date >= date '1998-06-01' then close + 1 else close end as close from price")
def sink_by_date(t: Tables) -> DataFrame:
    """One partition a month; a second write replaces its own months alone."""
    path = sinks.scratch(t.spark, "dated")
    p = t.price().select("ticker", "trading_date", "close", F.date_format("trading_date", "yyyy-MM").alias("month"))
    sinks.overwrite_partitions(p, path, "month")
    sinks.overwrite_partitions(p.where("month >= '1998-06'").withColumn("close", F.col("close") + 1), path, "month")
    return t.spark.read.parquet(path).select("ticker", "trading_date", "close")


@query("select symbol, organ_name from listing union all select symbol, organ_name from listing where ord % 2 = 0")
def sink_append_master(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "master")
    sinks.append(t.listing().select("symbol", "organ_name"), path)
    sinks.append(t.listing().where("ord % 2 = 0").select("symbol", "organ_name"), path)
    return t.spark.read.parquet(path)


@query("select 'price' as dataset, count(*) as rows_out, 'success' as status from price union all select 'listing', null, 'failed'")
def audit_silver(t: Tables) -> DataFrame:
    log = sinks.scratch(t.spark, "audit")
    sinks.audited(t.price(), log, "price", "r1", lambda df: sinks.overwrite(df, sinks.scratch(t.spark, "silver")))
    try:
        sinks.audited(t.listing().withColumn("x", F.raise_error(F.lit("bad row"))), log, "listing", "r2", lambda df: sinks.overwrite(df, sinks.scratch(t.spark, "silver")))
    except Exception:  # noqa: S110  the log has it
        pass
    return t.spark.read.json(log).select("dataset", "rows_out", "status")


@query("select 'orders' as dataset, count(*) as rows_out from orders")
def audit_load(t: Tables) -> DataFrame:
    log = sinks.scratch(t.spark, "audit")
    sinks.audited(t.raw("orders"), log, "orders", "r1", lambda df: sinks.append(df, sinks.scratch(t.spark, "warehouse")))
    return t.spark.read.json(log).select("dataset", "rows_out")


@query("select l_suppkey, cast(l_shipdate as date) as trading_date, max(l_orderkey * 8 + l_linenumber) as ord from lineitem group by 1, 2")
def stream_silver_price(t: Tables) -> DataFrame:
    """A keyed upsert fed by a stream: the last trade of each key and day."""
    raw = t.raw("lineitem")
    source = jobs.stream(t.spark, f"{t.dir}/lineitem.parquet", raw.schema).select("l_suppkey", F.to_date("l_shipdate").alias("trading_date"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    table = jobs.KeyedTable(t.spark, ["l_suppkey", "trading_date"], ["ord"], part=F.date_format("trading_date", "yyyy"))
    jobs.run_into(source, table)
    return table.read()


@query("select user_id as symbol, cast(ts as date) as trading_date, max(ts) as snapshot_at, arg_max(value, ts) as close_price from events group by 1, 2")
def stream_board_latest(t: Tables) -> DataFrame:
    source = jobs.stream(t.spark, f"{t.dir}/events.parquet", t.raw("events").schema).select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("snapshot_at"), F.col("value").alias("close_price"))
    out = jobs.drained(jobs.latest_by_day(source), "update")
    return ranked_dedupe(out, ["symbol", "trading_date"], [F.desc("__batch"), F.desc("snapshot_at")]).drop("__batch")


_LATE_MARK = "(select date_trunc('millisecond', max(snapshot_at)) - interval 1 day from board b where b.event_id % 4 < k - 1)"


@query(f"select k as batch, count(*) as rows_in, count(*) filter (where snapshot_at <= {_LATE_MARK}) as dropped from (select *, event_id % 4 as k from board) group by k")
def stream_late_rows(t: Tables) -> DataFrame:
    """What the watermark of a stream drops, batch by batch: quotes that land in four files, each over all days."""
    path, notes = sinks.scratch(t.spark, "late"), sinks.scratch(t.spark, "progress")
    board = t.board().select("event_id", F.col("snapshot_at").cast("timestamp").alias("snapshot_at"))
    for k in range(4):
        board.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    source = t.spark.readStream.schema(board.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with jobs.audited(t.spark, notes):
        jobs.drained(source.withWatermark("snapshot_at", "1 day").dropDuplicatesWithinWatermark(["event_id"]))
    return t.spark.read.parquet(notes).where("rows_in > 0").select("batch", "rows_in", "dropped")


@query("select doc_id::varchar as article_id from documents group by 1")
def stream_news_dedupe(t: Tables) -> DataFrame:
    source = jobs.stream(t.spark, f"{t.dir}/documents.parquet", t.raw("documents").schema).select(F.col("doc_id").cast("string").alias("article_id"), F.timestamp_seconds(F.lit(788918400) + F.col("doc_id") % 86400).alias("fetched_at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return jobs.drained(jobs.first_articles(source)).select("article_id")
