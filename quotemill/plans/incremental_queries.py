"""Registered queries of partition selection, watermarks, upserts and incremental refreshes.

The "stored" side is the part of a proxy table up to a day; the "new" side is what follows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import incremental, keyed
from quotemill.plans import gold
from quotemill.plans.gold_queries import ALL, INDICATOR_COLUMNS, VIEWS, _COLS, _PIVOT, rounded_all
from quotemill.plans.registry import query
from quotemill.sources import datasets, sinks
from quotemill.sources.proxy import Tables

CUT = dt.date(1997, 6, 30)
D = f"date '{CUT}'"


def old(t: Tables) -> DataFrame:
    return t.price().where(F.col("trading_date") <= F.lit(CUT))


@query(f"select ticker, trading_date, close from price where trading_date > {D}")
def row_watermark_filter(t: Tables) -> DataFrame:
    return datasets.since(t.price(), "trading_date", CUT).select("ticker", "trading_date", "close")


@query(f"select ticker, trading_date, close from price where trading_date > {D}")
def incr_after_max(t: Tables) -> DataFrame:
    return keyed.after_max(t.price(), old(t), "trading_date").select("ticker", "trading_date", "close")


def _months(t: Tables, df: DataFrame | None = None) -> str:
    """Prices in a folder with a part for each month."""
    path = sinks.scratch(t.spark, "months")
    p = t.price() if df is None else df
    sinks.overwrite_partitions(p.withColumns({"year": F.year("trading_date"), "month": F.month("trading_date")}), path, "year", "month")
    return path


@query("select distinct year(trading_date) as year, month(trading_date) as month from price")
def partition_list(t: Tables) -> DataFrame:
    """Listed from the names of the folder's parts."""
    found = datasets.stored_partitions(t.spark, _months(t), "year", "month")
    return found.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@query("select ticker, count(*) as n from price where trading_date >= date '1997-06-01' group by 1")
def partition_select(t: Tables) -> DataFrame:
    """Only the parts of the months wanted are read."""
    return datasets.months_since(t.spark.read.parquet(_months(t)), CUT).groupBy("ticker").agg(F.count("*").alias("n"))


@query("select ticker, trading_date, close from price where trading_date = (select max(trading_date) from price)")
def partition_latest(t: Tables) -> DataFrame:
    return datasets.latest(t.price(), "trading_date").select("ticker", "trading_date", "close")


@query("select ticker, trading_date, close from price where trading_date in (select distinct trading_date from price order by 1 desc limit 5)")
def latest_n_partitions(t: Tables) -> DataFrame:
    return datasets.latest_n(t.price(), "trading_date", 5).select("ticker", "trading_date", "close")


_SNAP = "strftime(snapshot_at, '%Y-%m-%dT%H-%M')"


def _snapshots(t: Tables) -> DataFrame:
    return t.board().withColumn("snapshot", F.date_format("snapshot_at", "yyyy-MM-dd'T'HH-mm"))


@query(f"select symbol, event_id from board where {_SNAP} = (select max({_SNAP}) from board)")
def scan_latest_snapshot(t: Tables) -> DataFrame:
    return datasets.latest(_snapshots(t), "snapshot").select("symbol", "event_id")


@query(f"select event_id, symbol from board where {_SNAP} > (select {_SNAP} from board where event_id = 100)")
def scan_snapshots_since(t: Tables) -> DataFrame:
    s = _snapshots(t)
    mark = s.where("event_id = 100").select("snapshot").first()[0]
    return datasets.since(s, "snapshot", mark).select("event_id", "symbol")


@query("select event_id, symbol from board where cast(snapshot_at as date) >= (select cast(snapshot_at as date) from board where event_id = 100)")
def scan_snapshots_from_day(t: Tables) -> DataFrame:
    b = t.board()
    day = b.where("event_id = 100").select(F.to_date("snapshot_at")).first()[0]
    return b.where(F.to_date("snapshot_at") >= F.lit(day)).select("event_id", "symbol")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F'")
def scan_partitioned(t: Tables) -> DataFrame:
    """The scan of a folder with one more column (the file), cut to a value."""
    return datasets.scan(t.spark, f"{t.dir}/orders.parquet", o_orderstatus="F").where("source_file like '%orders%'").select("o_orderkey", "o_custkey")


@query("select r_regionkey, r_name, 'region.parquet' as file from region")
def scan_master(t: Tables) -> DataFrame:
    return datasets.scan(t.spark, f"{t.dir}/region.parquet").select("r_regionkey", "r_name", F.regexp_extract("source_file", "(region.parquet)", 1).alias("file"))


@query("select doc_id, source from filings where source = 'Brand#11' or source = (select min(source) from filings)")
def scan_doc_meta(t: Tables) -> DataFrame:
    f = t.filings()
    first = f.agg(F.min("source")).first()[0]
    return f.where(F.col("source").isin("Brand#11", first)).select("doc_id", "source")


@query("select symbol from listing where upper(exchange) in ('HOSE', 'HNX') and lower(type) = 'stock'")
def listing_universe(t: Tables) -> DataFrame:
    return incremental.listing_universe(t.listing(), ["hose", "HNX"], ["STOCK"])


@query("select symbol, ord from listing where lower(type) = 'stock'")
def listing_universe_ordered(t: Tables) -> DataFrame:
    return incremental.ordered_universe(t.listing(), None, ["stock"], "ord")


@query("select symbol from (select symbol from listing where lower(type) = 'stock' order by ord limit 40) where symbol in (select symbol from listing where upper(exchange) = 'HOSE')")
def universe_cap_intersect(t: Tables) -> DataFrame:
    every = incremental.ordered_universe(t.listing(), None, ["stock"], "ord").orderBy("ord").limit(40)
    return every.join(incremental.listing_universe(t.listing(), ["HOSE"], None), "symbol", "left_semi").select("symbol")


@query("select upper(p_brand) as code from part group by 1 order by min(p_partkey) limit 10")
def watchlist_dedupe(t: Tables) -> DataFrame:
    w = t.raw("part").select(F.concat(F.lit(" "), F.lower("p_brand")).alias("symbol"), F.col("p_partkey").alias("ord"))
    return incremental.watchlist(w, "ord", 10).select(F.col("symbol").alias("code"))


@query("select title, url_pdf, min(p_partkey) as ord from (select any_value(title) as title, url_pdf, min(p_partkey) as p_partkey from filings where p_partkey % 3 <> 0 group by url_pdf union all select any_value('json ' || title), url_pdf, min(p_partkey) + 1000000 from filings where p_partkey % 3 = 0 group by url_pdf) group by all")
def scan_doc_csv_json(t: Tables) -> DataFrame:
    """Lists with alternative headers, one a CSV and one a JSON file, merged by address, the first wins."""
    f = t.filings()
    csv, json = sinks.scratch(t.spark, "csv"), sinks.scratch(t.spark, "json")
    f.where("p_partkey % 3 <> 0").select(F.col("title").alias("Title"), F.col("url_pdf").alias("link"), F.col("p_partkey").alias("ord")).write.option("header", True).option("escape", '"').csv(csv)
    f.select(F.concat(F.lit("json "), "title").alias("name"), F.col("url_pdf").alias("url"), (F.col("p_partkey") + 1_000_000).alias("ord")).write.json(json)
    a, b = (x.withColumn("ord", F.col("ord").cast("long")) for x in datasets.read_lists(t.spark, csv, json))
    return incremental.merged_lists([a, b], {"title": ["title", "Title", "name"], "url_pdf": ["url_pdf", "link", "url"]}, "url_pdf", "ord")


# --- upserts

NEW = "select ticker, trading_date, close + 1 as close, volume from price where trading_date between date '1997-06-01' and date '1997-07-31'"


def new(t: Tables) -> DataFrame:
    return t.price().where("trading_date between date '1997-06-01' and date '1997-07-31'").select("ticker", "trading_date", (F.col("close") + 1).alias("close"), "volume")


_UPSERTED = f"select ticker, trading_date, close, volume from price where trading_date <= {D} and trading_date < date '1997-06-01' union all select * from fresh"
_KEYS = ["ticker", "trading_date"]


def _stored(t: Tables) -> DataFrame:
    return old(t).select("ticker", "trading_date", "close", "volume")


@query(_UPSERTED, fresh=NEW)
def upsert_keyed(t: Tables) -> DataFrame:
    return keyed.upsert(_stored(t), new(t), _KEYS)


@query(f"select count(*) filter (where trading_date > {D}) as inserted, count(*) filter (where trading_date <= {D}) as updated from fresh", fresh=NEW)
def upsert_counts(t: Tables) -> DataFrame:
    return keyed.upsert_counts(_stored(t), new(t), _KEYS)


@query(_UPSERTED, fresh=NEW)
def incr_delete_insert(t: Tables) -> DataFrame:
    return keyed.replace_keys(_stored(t), new(t), _KEYS)


@query(
    f"""select ticker, trading_date, close, volume, null as turnover from price where trading_date <= {D} and trading_date < date '1997-06-01'
        union all select ticker, trading_date, close + (trading_date >= date '1997-07-15')::int as close, volume, case when trading_date < date '1997-07-15' then close * volume end from fresh""",
    fresh=NEW,
)
def sink_by_month_merge(t: Tables) -> DataFrame:
    """New rows merged into a stored folder, first with one column more, then without it: only the months that they touch are
    written again, and the column's values stay."""
    path = _months(t, _stored(t))
    fresh = new(t).withColumns({"year": F.year("trading_date"), "month": F.month("trading_date")})
    sinks.merge_partitions(fresh.withColumn("turnover", F.col("close") * F.col("volume")), path, _KEYS, "year", "month")
    sinks.merge_partitions(fresh.where("trading_date >= '1997-07-15'").withColumn("close", F.col("close") + 1), path, _KEYS, "year", "month")
    return sinks.stored_table(t.spark, path).select("ticker", "trading_date", "close", "volume", "turnover")


@query("select ticker, item_code, period, case when value is null then null when period like '%Q%' then value + 1 else floor(value) end as value, case when period like '%Q%' and value is not null then 'merged' end as origin from ratio")
def sink_merge_ratio(t: Tables) -> DataFrame:
    """Whole numbers by year; quarters with fractions and a new column are merged, for which all parts become wider."""
    r = t.ratio().select("ticker", "item_code", "period", "value")
    path = sinks.scratch(t.spark, "ratios")
    parted = r.withColumn("year", F.left("period", F.lit(4)).cast("int"))
    sinks.overwrite_partitions(parted.withColumn("value", F.floor("value")), path, "year")
    quarters = parted.where("value is not null and period like '%Q%'")
    sinks.merge_partitions(quarters.withColumns({"value": F.col("value") + 1, "origin": F.lit("merged")}), path, ["ticker", "item_code", "period"], "year")
    return sinks.stored_table(t.spark, path).select("ticker", "item_code", "period", "value", "origin")


@query("select symbol, cast(snapshot_at as date) as trading_date, max(snapshot_at) as snapshot_at, max(hour(snapshot_at)) filter (hour(snapshot_at) >= 12)::bigint as hour from board group by 1, 2")
def sink_merge_board(t: Tables) -> DataFrame:
    """The morning's quotes, into which the afternoon's are merged with their hour, first as a small number, then as a large one."""
    b = t.board().withColumn("trading_date", F.to_date("snapshot_at"))
    newest = lambda df: keyed.ranked_dedupe(df, ["symbol", "trading_date"], [F.desc("snapshot_at"), F.desc("event_id")]).withColumn("month", F.date_format("trading_date", "yyyyMM").cast("int"))
    path = sinks.scratch(t.spark, "board")
    sinks.overwrite_partitions(newest(b.where("hour(snapshot_at) < 12")), path, "month")
    late = newest(b.where("hour(snapshot_at) >= 12"))
    for kind, even in (("smallint", 0), ("bigint", 1)):
        part = late.where(F.col("event_id") % 2 == even).withColumn("hour", F.hour("snapshot_at").cast(kind))
        sinks.merge_partitions(part, path, ["symbol", "trading_date"], "month")
    return sinks.stored_table(t.spark, path).select("symbol", "trading_date", "snapshot_at", "hour")


_LATE = f"price where trading_date <= {D} and fetched % 50 = 0"


@query(f"select ticker, trading_date from {_LATE}")
def late_rows_report(t: Tables) -> DataFrame:
    have = old(t).where("fetched % 50 <> 0")
    return keyed.late_rows(t.price(), have, _KEYS, "trading_date").select("ticker", "trading_date")


#: Where this application has stored the indicator state of a folder of tables.
_STATES: dict[tuple[str, str], str] = {}


def _indicator_state(t: Tables) -> str:
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _STATES:
        path = sinks.scratch(t.spark, "state")
        sinks.overwrite_partitions(incremental.indicator_state(old(t)).withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(8))), path, "part")
        _STATES[key] = path
    return _STATES[key]


@query(
    f"""select ticker, max(row_num) as rows_seen, arg_max(obv, row_num) as obv, max(trading_date) as last_day, least(max(row_num), {incremental.ROWS_BACK}) as rows_kept,
        sum(close) filter (where back <= {incremental.ROWS_BACK}) as kept_closes
        from (select *, row_number() over (partition by ticker order by trading_date desc) as back from indicators where trading_date <= {D}) group by ticker""",
    **VIEWS,
)
def indicator_state(t: Tables) -> DataFrame:
    """The stored state of each ticker after the cut day, which later runs start from."""
    state = sinks.stored_table(t.spark, _indicator_state(t))
    closes = F.aggregate("kept", F.lit(0.0), lambda s, x: s + x["close"])
    return state.select("ticker", "rows_seen", "obv", "last_day", F.size("kept").cast("long").alias("rows_kept"), closes.alias("kept_closes"))


@query(f"select ticker, trading_date, close, {_COLS}, obv from indicators where trading_date > {D}", **VIEWS)
def price_indicators_incremental(t: Tables) -> DataFrame:
    """Indicators of new days from the stored state alone: equal to the full refresh."""
    out, _ = incremental.advanced_indicators(sinks.stored_table(t.spark, _indicator_state(t)), t.price().where(f"trading_date > {D}"))
    return rounded_all(out, INDICATOR_COLUMNS).select("ticker", "trading_date", "close", *INDICATOR_COLUMNS, "obv")


@query(f"select ticker, trading_date, row_num, obv, {_COLS} from indicators where trading_date > {D}", **VIEWS)
def incr_lookback(t: Tables) -> DataFrame:
    """Two runs, the second from the state that the first merged into the stored one; what comes twice is left out."""
    new = t.price().where(f"trading_date > {D}")
    path = sinks.scratch(t.spark, "state")
    sinks.overwrite_partitions(sinks.stored_table(t.spark, _indicator_state(t)), path, "part")
    first, _ = incremental.advanced_indicators(sinks.stored_table(t.spark, path), new.where("trading_date <= '1997-12-10'"))
    done = sinks.scratch(t.spark, "indicators")
    sinks.append(first, done)
    state = incremental.state_after(sinks.stored_table(t.spark, path), t.spark.read.parquet(done))
    sinks.merge_partitions(state.withColumn("part", F.pmod(F.xxhash64("ticker"), F.lit(8))), path, ["ticker"], "part")
    second, _ = incremental.advanced_indicators(sinks.stored_table(t.spark, path), new.where("trading_date >= '1997-12-01'"))
    sinks.append(second, done)
    return rounded_all(t.spark.read.parquet(done), INDICATOR_COLUMNS).select("ticker", "trading_date", "row_num", "obv", *INDICATOR_COLUMNS)


@query(f"select p.trading_date, {_PIVOT}, b.total_volume, b.advances, b.declines from pivoted p join breadth b on p.trading_date = b.trading_date where p.trading_date > {D}", **ALL)
def incr_new_dates(t: Tables) -> DataFrame:
    out = incremental.market_overview(t.price(), t.index_price(), CUT)
    names = [f"{n}_{s}" for n in gold.INDEXES.values() for s in ("close", "return")]
    return rounded_all(out, [n for n in names if n.endswith("return")]).select("trading_date", *names, "total_volume", "advances", "declines")


# --- watermarks and plans

@query(f"select max(d) as mark from (select max(trading_date) as d from price where trading_date <= {D} union all select max(trading_date) from index_price where trading_date <= date '1996-01-01' union all select date '1997-01-01')")
def watermark_resolve(t: Tables) -> DataFrame:
    a, b = keyed.newest(old(t), "trading_date"), keyed.newest(t.index_price().where("trading_date <= date '1996-01-01'"), "trading_date")
    return t.price().limit(1).select(F.lit(keyed.watermark(a, b, dt.date(1997, 1, 1), None)).alias("mark"))


@query("select ticker, max(trading_date) as newest from price group by 1")
def watermark_per_key(t: Tables) -> DataFrame:
    return t.price().groupBy("ticker").agg(F.max("trading_date").alias("newest"))


@query("select 'price' as dataset, max(trading_date) as mark from price union all select 'index_price', max(trading_date) from index_price")
def watermark_store(t: Tables) -> DataFrame:
    """Watermarks kept in a folder, which never move back."""
    path = sinks.scratch(t.spark, "marks")
    for name, df in (("price", t.price()), ("index_price", t.index_price())):
        sinks.advance_watermark(t.spark, path, name, keyed.newest(df, "trading_date"))
        sinks.advance_watermark(t.spark, path, name, CUT)
    return sinks.watermarks(t.spark, path)


_PLAN = f"select symbol as ticker, newest, case when newest is null then date '1990-01-01' else newest + 1 end as load_from, date '1998-06-30' as load_to, case when newest is null then 'bootstrap' when date '1998-06-30' - newest <= 30 then 'window' else 'since' end as mode from (select symbol, (select max(trading_date) from price p where p.ticker = l.symbol and p.trading_date <= {D} and l.ord % 7 <> 0) as newest from listing l) where coalesce(newest + 1, date '1990-01-01') <= date '1998-06-30'"


def plan(t: Tables) -> DataFrame:
    universe = t.listing().select(F.col("symbol").alias("ticker"), "ord")
    have = old(t).join(universe.where("ord % 7 <> 0"), "ticker", "left_semi")
    return keyed.plan_loads(universe, have, "ticker", "trading_date", "1998-06-30", 30, "1990-01-01")


@query("select * from loads", loads=_PLAN)
def fetch_range_plan(t: Tables) -> DataFrame:
    return plan(t)


@query("select ticker, greatest(load_from, make_date(y, 1, 1)) as part_from, least(load_to, make_date(y, 12, 31)) as part_to from (select *, unnest(range(year(load_from), year(load_to) + 1)) as y from loads where load_to - load_from > 366) union all select ticker, load_from, load_to from loads where load_to - load_from <= 366", loads=_PLAN)
def fetch_window_split(t: Tables) -> DataFrame:
    return keyed.split_at_years(plan(t), "load_from", "load_to").select("ticker", "part_from", "part_to")


@query("select ticker, case when max(trading_date) - min(trading_date) > 37 then 'backfill' else 'incremental' end as run_type from price group by 1")
def run_type_infer(t: Tables) -> DataFrame:
    return incremental.run_type(t.price(), "ticker", "trading_date", 30)


@query("select min(trading_date) as first_day, max(trading_date) as last_day, count(*) as rows, count(distinct ticker) as tickers, case when count(distinct ticker) >= 100 then 'success' else 'partial' end as status from price")
def audit_run_stats(t: Tables) -> DataFrame:
    return incremental.run_stats(t.price(), 100)


@query("select max(trading_date) as run_partition from price")
def audit_run_partition(t: Tables) -> DataFrame:
    return t.price().select("trading_date").distinct().agg(F.max("trading_date").alias("run_partition"))


@query("select count(*) as rows from orders")
def sink_row_count(t: Tables) -> DataFrame:
    return t.raw("orders").agg(F.count("*").alias("rows"))


@query("select count(*) as rows, min(o_orderkey) as o_orderkey_min, max(o_orderkey) as o_orderkey_max, count(o_orderkey) as o_orderkey_values, min(o_totalprice) as o_totalprice_min, max(o_totalprice) as o_totalprice_max, count(o_totalprice) as o_totalprice_values from orders")
def sink_file_stats(t: Tables) -> DataFrame:
    """Counts and extremes of a stored table from the footers of its files."""
    return datasets.file_stats(t.spark, f"{t.dir}/orders.parquet", "o_orderkey", "o_totalprice")
