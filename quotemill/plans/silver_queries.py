"""Registered queries of scans, column rules and cleaning transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions import rules
from quotemill.operators import quality
from quotemill.operators.keyed import ranked_dedupe
from quotemill.plans import gold, silver
from quotemill.plans.registry import query
from quotemill.sources import datasets
from quotemill.sources.proxy import Tables

R6 = "round(cast({} as decimal(28,10)), 6)::double"
RAW = {
    "raw_price": """select case when fetched % 97 = 0 then '  ' else ' ' || lower(ticker) || ' ' end as ticker, case when fetched % 89 = 0 then 'n/a' else trading_date::varchar end as time, open::varchar as open, (case when fetched % 83 = 0 then low - 1 else high end)::varchar as high, low::varchar as low,
        (case when fetched % 79 = 0 then -close else close end)::varchar as close, volume::varchar as volume, case when fetched % 3 = 0 then close * volume else value end as value, fetched as fetched_at, case when fetched % 2 = 0 then 'VCI' else 'kbs' end as source from price""",
    "typed_price": """select upper(trim(ticker)) as ticker, try_cast(time as date) as trading_date, open::double as open, high::double as high, low::double as low, close::double as close, volume::bigint as volume, value as raw_value, lower(source) as source, fetched_at from raw_price where trim(ticker) <> '' and try_cast(time as date) is not null""",
    "clean_price": """select ticker, trading_date, open, high, low, close, volume, case when raw_value is null then close * volume * 1000.0 when abs(raw_value / nullif(close * volume, 0) - 1) <= 0.05 then raw_value * 1000.0 else raw_value end as value, raw_value is null as value_is_derived,
        least(open, high, low, close) < 0 or high < low as is_suspicious, source, fetched_at from typed_price""",
}


def raw_price(t: Tables) -> DataFrame:
    """Prices as they land: texts, blanks, aliases, bad dates."""
    p, f = t.price(), F.col("fetched")
    return p.select(
        F.when(f % 97 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("ticker"), F.lit(" "))).alias("Ticker"), F.when(f % 89 == 0, "n/a").otherwise(F.col("trading_date").cast("string")).alias("time"), F.col("open").cast("string").alias("open"),
        F.when(f % 83 == 0, F.col("low") - 1).otherwise(F.col("high")).cast("string").alias("high"), F.col("low").cast("string").alias("low"), F.when(f % 79 == 0, -F.col("close")).otherwise(F.col("close")).cast("string").alias("close"), F.col("volume").cast("string").alias("volume"),
        F.when(f % 3 == 0, F.col("close") * F.col("volume")).otherwise(F.col("value")).alias("value"), f.alias("fetched_at"), F.when(f % 2 == 0, "VCI").otherwise("kbs").alias("source"),
    )


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("value", rules.rounded("value", 2))


@query("select ticker, trading_date, open, high, low, close, volume, round(cast(value as decimal(28,10)), 2)::double as value, value_is_derived, is_suspicious, source, 'stock' as instrument_type, fetched_at from clean_price", **RAW)
def price_clean(t: Tables) -> DataFrame:
    return _money(silver.clean_price(raw_price(t)))


@query("select ticker, trading_date, round(cast(value as decimal(28,10)), 2)::double as value, value_is_derived from clean_price", **RAW)
def trading_value_normalize(t: Tables) -> DataFrame:
    return _money(silver.clean_price(raw_price(t))).select("ticker", "trading_date", "value", "value_is_derived")


@query("select is_suspicious, count(*) as n from clean_price group by 1", **RAW)
def ohlc_flags(t: Tables) -> DataFrame:
    return silver.clean_price(raw_price(t)).groupBy("is_suspicious").agg(F.count("*").alias("n"))


@query("select index_code, trading_date, close, volume, round(cast(close * volume as decimal(28,10)), 2)::double as value from index_price")
def index_clean(t: Tables) -> DataFrame:
    raw = t.index_price().withColumns({c: F.col("close") for c in ("open", "high", "low")})
    return _money(silver.clean_price(raw, "index_code", "index")).select("index_code", "trading_date", "close", "volume", "value")


GATE = {"gate": "select ticker, source, count(*) as rows, case when count(*) < 250 then 'too_few_rows' when count(close) = 0 then 'no_close' when count(*) filter (where high < low)::double / count(*) > 0.012 then 'high_below_low' else 'ok' end as reason from clean_price group by 1, 2"}


@query("select ticker, source, rows, reason, reason = 'ok' as accepted from gate", **RAW, **GATE)
def ohlcv_gate(t: Tables) -> DataFrame:
    return silver.ohlcv_gate(silver.clean_price(raw_price(t)), 250, 0.012)


@query("select ticker, case when max((source = 'kbs')::int) = 1 then 'kbs' else 'vci' end as source, coalesce(max(rows) filter (where source = 'kbs'), max(rows)) as rows from gate where reason = 'ok' group by 1", **RAW, **GATE)
def source_fallback(t: Tables) -> DataFrame:
    return silver.first_accepted(silver.ohlcv_gate(silver.clean_price(raw_price(t)), 250, 0.012), ["kbs", "vci"])


@query("select ticker, count(*) as rows, min(trading_date) as first_day, max(trading_date) as last_day, round(cast(count(*) filter (where close is null) * 100.0 / count(*) as decimal(28,10)), 4)::double as missing_close_pct, round(cast((count(*) filter (where value is null))::double * 100.0 / count(*) as decimal(28,10)), 4)::double as missing_value_pct from price group by 1")
def ohlcv_quality_report(t: Tables) -> DataFrame:
    return silver.quality_report(t.price())


@query("with f as (select ticker, case when quarter % 2 = 0 then 'vci' else 'kbs' end as source, case when year % 2 = 0 then 'quarter' else 'year' end as kind from ratio where value is not null), g as (select ticker, source, kind, count(*) as rows from f group by all) select ticker, source, kind, rows from (select *, row_number() over (partition by ticker order by source = 'kbs' desc, kind) as n from g) where n = 1")
def source_period_fallback(t: Tables) -> DataFrame:
    f = t.ratio().where("value is not null").select("ticker", F.when(F.col("quarter") % 2 == 0, "vci").otherwise("kbs").alias("source"), F.when(F.col("year") % 2 == 0, "quarter").otherwise("year").alias("kind"))
    return silver.first_nonempty(f, ["kbs", "vci"])


@query("select symbol, organ_name, upper(exchange) as exchange, 'stock' as type from listing where lower(type) = 'stock'")
def listing_clean(t: Tables) -> DataFrame:
    return silver.clean_listing(t.listing().unionByName(t.listing().withColumns({"symbol": F.lower("symbol"), "ord": F.col("ord") - 1})))


@query("select ticker, company_type, founded_date, charter_capital, number_of_employees from company")
def company_clean(t: Tables) -> DataFrame:
    c = t.company()
    old = c.withColumns({"snapshot": F.lit("2024-01-01"), "charter_capital": F.lit(1.0)})
    return silver.clean_company(c.withColumn("snapshot", F.lit("2024-06-01")).unionByName(old))


def wide_ratio(t: Tables) -> DataFrame:
    """Wide snapshots with period columns, one of them doubled with a suffix, and two snapshots."""
    r = t.ratio()
    name = F.concat_ws("-", F.col("year").cast("string"), F.concat(F.lit("Q"), F.col("quarter").cast("string")))
    periods = [f"{y}-Q{q}" for y in range(1992, 2000) for q in (1, 2, 3, 4)]
    w = r.withColumn("p", name).groupBy("ticker", "item_code").pivot("p", periods).agg(F.max("value"))
    w = w.withColumns({"1996-Q4_1": F.col("`1996-Q4`") + 1, "1996-year": F.col("`1996-Q1`")})
    return w.withColumn("snapshot", F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))))  # made once, not once for each


_LONG = {
    "cells": "select ticker, item_code, period as period_column, value from ratio",
    "grid": "select k.ticker, k.item_code, p.p as period_column from (select distinct ticker, item_code from cells) k, (select y || '-Q' || q as p from range(1992, 2000) a(y), range(1, 5) b(q)) p",
    "long0": "select g.*, c.value from grid g left join cells c using (ticker, item_code, period_column)",
    "long": "select * from long0 union all select ticker, item_code, '1996-Q4_1', value + 1 from long0 where period_column = '1996-Q4' union all select ticker, item_code, '1996-year', value from long0 where period_column = '1996-Q1'",
}


@query("select ticker, item_code, period_column, value, s as snapshot from long, (select unnest(['2024-01-01', '2024-02-01']) as s)", **_LONG)
def ratio_unpivot(t: Tables) -> DataFrame:
    return silver.unpivot_periods(wide_ratio(t), ["ticker", "item_code", "snapshot"]).select("ticker", "item_code", "period_column", "value", "snapshot")


@query("select period_column, left(period_column, 7) as period0, case when period_column like '%year%' then 'annual' else 'quarter' end as period_type, left(period_column, 4)::int as year, case when period_column not like '%year%' then substring(period_column, 7, 1)::int end as quarter, count(*) * 2 as n from long group by all", **_LONG)
def ratio_period_decode(t: Tables) -> DataFrame:
    d = silver.decode_periods(silver.unpivot_periods(wide_ratio(t), ["ticker", "item_code", "snapshot"]))
    return d.groupBy("period_column", F.left("period", F.lit(7)).alias("period0"), "period_type", "year", "quarter").agg(F.count("*").alias("n"))


_FINAL = "select ticker, item_code, replace(period_column, '_1', '') as period, value from long where period_column <> '1996-Q4'"


@query("select ticker, item_code, period, count(*) * 2 as n from finals group by all", **_LONG, finals=_FINAL)
def ratio_suffix_dedupe(t: Tables) -> DataFrame:
    d = silver.collapse_suffixes(silver.decode_periods(silver.unpivot_periods(wide_ratio(t), ["ticker", "item_code", "snapshot"])))
    return d.groupBy("ticker", "item_code", "period").agg(F.count("*").alias("n"))


@query("select ticker, item_code, period, value, '2024-02-01' as snapshot from finals", **_LONG, finals=_FINAL)
def ratio_clean(t: Tables) -> DataFrame:
    return silver.clean_ratio(wide_ratio(t)).select("ticker", "item_code", "period", "value", "snapshot")


BOARD = {
    "flagged": "select *, cast(snapshot_at as date) as trading_date, close_price <= 0 or high_price < low_price or volume < 0 as is_suspicious from board",
    "last_board": "select * from (select *, row_number() over (partition by symbol, trading_date order by snapshot_at desc, event_id desc) as n from flagged) where n = 1",
}


@query("select event_id, upper(symbol) as symbol, upper(exchange) as exchange, trading_date, close_price from flagged", **BOARD)
def board_clean(t: Tables) -> DataFrame:
    return silver.clean_board(t.board()).select("event_id", "symbol", "exchange", "trading_date", "close_price")


@query("select event_id, is_suspicious from flagged", **BOARD)
def board_flags(t: Tables) -> DataFrame:
    return silver.clean_board(t.board()).select("event_id", "is_suspicious")


@query("select symbol, trading_date, snapshot_at, event_id, close_price from last_board", **BOARD)
def board_daily_latest(t: Tables) -> DataFrame:
    return silver.board_latest(silver.clean_board(t.board())).select("symbol", "trading_date", "snapshot_at", "event_id", "close_price")


@query("select upper(symbol) as symbol, trading_date, upper(exchange) as exchange, close_price, bid_price_1, ask_price_1, foreign_buy - foreign_sell as foreign_net, case when bid_price_1 > 0 then round(cast((ask_price_1 - bid_price_1) / bid_price_1 * 100 as decimal(28,10)), 4)::double end as spread_pct from last_board where not is_suspicious", **BOARD)
def mart_price_board(t: Tables) -> DataFrame:
    return gold.price_board(silver.board_latest(silver.clean_board(t.board())))


@query("select symbol, event_id, s as snapshot from board, (select 'b1' as s) where event_id % 2 = 0 union all select symbol, event_id, 'b1' from board where event_id % 2 = 1")
def board_batch_merge(t: Tables) -> DataFrame:
    b = t.board()
    parts = [b.where(f"event_id % 2 = {k}").select("symbol", "event_id") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("snapshot", F.lit("b1"))


DOUBLED = "select * from news union all select article_id, doc_id, ticker, title, summary, left(body_text, 50), source || '_rss', published_at, fetched_at, published_date, ticker_mentions, url, sentiment_score, sentiment_label from news where doc_id % 2 = 0"


def doubled(t: Tables) -> DataFrame:
    n = t.news()
    return n.unionByName(n.where("doc_id % 2 = 0").withColumns({"body_text": F.left("body_text", F.lit(50)), "source": F.concat("source", F.lit("_rss"))}))


@query("select article_id, source, length(body_text) as n from (select *, row_number() over (partition by article_id order by length(coalesce(body_text, '')) desc, published_at is not null desc, source like '%\\_rss' escape '\\', source, doc_id) as k from doubled) where k = 1", doubled=DOUBLED)
def news_dedupe_rich(t: Tables) -> DataFrame:
    return silver.richest_article(doubled(t)).select("article_id", "source", F.length("body_text").cast("long").alias("n"))


@query("select source, count(*) as n from (select distinct source, article_id from doubled) group by 1", doubled=DOUBLED)
def news_dedupe_source(t: Tables) -> DataFrame:
    return silver.first_per_source(doubled(t), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("select article_id from news where published_at is null or published_at >= timestamp '1995-01-31' - interval 7 day")
def news_days_back(t: Tables) -> DataFrame:
    return silver.days_back(t.news(), "1995-01-31", 7).select("article_id")


@query("select doc_id, p_partkey from (select *, row_number() over (partition by doc_id order by published_at desc nulls last, p_partkey desc) as n from filings) where n = 1")
def load_dedupe(t: Tables) -> DataFrame:
    return silver.load_dedupe(t.filings(), ["doc_id"], ["published_at", "p_partkey"]).select("doc_id", "p_partkey")


FILINGS = {
    "filed": r"""select *, case when status = 'downloaded' and qc_pass and file_size > 0 then 'available' when status like 'skipped%' then 'skipped' when status like '%failed%' or not qc_pass then 'failed' else 'unknown' end as display_status,
        case when regexp_matches(lt, '(^|[^\p{L}\p{N}_])(quý\s*i|q1)($|[^\p{L}\p{N}_])') then 'Q1' when regexp_matches(lt, '(^|[^\p{L}\p{N}_])(quý\s*ii|q2)($|[^\p{L}\p{N}_])') then 'Q2' when lt like '%bán niên%' or lt like '%6 tháng%' then 'H1' when lt like '%9 tháng%' then '9M'
        when lt like '%năm%' or lt like '%annual%' or lt like '%thường niên%' then 'ANNUAL' else 'GENERAL' end as period_key from (select *, lower(title || ' ' || url_pdf) as lt from filings)""",
    "kept_filings": "select * from (select *, row_number() over (partition by doc_id order by coalesce(status = 'downloaded', false) desc, qc_pass desc, file_size desc, p_partkey) as n from filed) where n = 1",
}


@query("select doc_id, p_partkey, period_key, display_status, display_status = 'available' as is_available_for_web from kept_filings", **FILINGS)
def doc_meta_clean(t: Tables) -> DataFrame:
    return silver.clean_filings(t.filings()).select("doc_id", "p_partkey", "period_key", "display_status", "is_available_for_web")


@query("select period_key, count(*) as n from filed group by 1", **FILINGS)
def doc_period_infer(t: Tables) -> DataFrame:
    f = t.filings()
    return f.select(silver.filing_period(f).alias("period_key")).groupBy("period_key").agg(F.count("*").alias("n"))


@query("select p_partkey, display_status from filed", **FILINGS)
def doc_display_status(t: Tables) -> DataFrame:
    return t.filings().select("p_partkey", silver.display_status().alias("display_status"))


@query("select doc_id, ticker, title from kept_filings where display_status = 'available'", **FILINGS)
def stg_doc_meta(t: Tables) -> DataFrame:
    return silver.web_filings(silver.clean_filings(t.filings())).select("doc_id", "ticker", "title")


@query("select doc_id, ticker, title, period_key, url_pdf, published_at from kept_filings where display_status = 'available'", **FILINGS)
def mart_doc_documents(t: Tables) -> DataFrame:
    return silver.web_filings(silver.clean_filings(t.filings())).select("doc_id", "ticker", "title", "period_key", "url_pdf", "published_at")


# --- plain projections

for _name, _view, _columns in (
    ("stg_price", "price", ["ticker", "trading_date", "open", "high", "low", "close", "volume"]), ("stg_index_price", "index_price", ["index_code", "trading_date", "open", "high", "low", "close", "volume"]), ("stg_price_board", "board", ["symbol", "snapshot_at", "close_price", "bid_price_1", "ask_price_1", "volume"]),
    ("stg_financial_ratio", "ratio", ["ticker", "item_code", "period", "period_type", "year", "quarter", "value"]), ("stg_listing", "listing", ["symbol", "organ_name", "exchange", "type"]), ("dim_security", "listing", ["symbol", "organ_name", "exchange"]),
    ("fact_index_daily", "index_price", ["index_code", "trading_date", "open", "high", "low", "close", "volume"]),
):

    def _project(t: Tables, view: str = _view, columns: list[str] = _columns) -> DataFrame:
        return datasets.conform(getattr(t, view)().select(*columns), datasets.SPECS.get(view))

    _project.__name__ = _name
    query(f"select {', '.join(_columns)} from {_view}")(_project)


@query("select ticker, company_type as industry, company_type as sector, founded_date, year(founded_date) as established_year, null::varchar as company_name from company")
def stg_company(t: Tables) -> DataFrame:
    return t.company().select("ticker", F.col("company_type").alias("industry"), F.col("company_type").alias("sector"), "founded_date", F.year("founded_date").alias("established_year"), F.lit(None).cast("string").alias("company_name"))


# --- scalar rules over texts of the tables

_NULLISH = "('', 'nan', 'none', 'null', '<na>')"


@query(rf"with c as (select p_partkey, trim(regexp_replace(case p_partkey % 5 when 0 then ' NaN ' when 1 then '' else '  ' || p_name || '   ' || p_brand end, '\s+', ' ', 'g')) as x from part) select p_partkey, case when lower(x) not in {_NULLISH} then x end as x from c")
def compact_text(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    return t.raw("part").select("p_partkey", rules.compact(F.when(k == 0, " NaN ").when(k == 1, "").otherwise(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand"))).alias("x"))


@query("select p_partkey, case when p_partkey % 5 > 0 then upper(p_name) else 'UNKNOWN' end as up, case when p_partkey % 5 > 0 then lower(p_brand) end as low from part")
def upper_nullable(t: Tables) -> DataFrame:
    x = lambda c: F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit(" "), c)).otherwise("none")
    return t.raw("part").select("p_partkey", rules.upper_or(x("p_name"), "UNKNOWN").alias("up"), rules.lower_or(x("p_brand")).alias("low"))


_WORDS = ["1", "Yes", " t ", "0", "FALSE", "n", "maybe", "", "null"]


@query(f"select p_partkey, [true, true, true, false, false, false, true, null, null][(p_partkey % 9 + 1)::int] as b, coalesce([true, true, true, false, false, false, true, null, null][(p_partkey % 9 + 1)::int], false) as d from part")
def bool_coerce(t: Tables) -> DataFrame:
    x = F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return t.raw("part").select("p_partkey", rules.to_bool(x).alias("b"), rules.to_bool(x, False).alias("d"))


@query("select p_partkey, case when p_partkey % 3 > 0 then p_size::double + 0.5 end as x, case when p_partkey % 3 > 0 then p_size::bigint end as n from part")
def num_coerce(t: Tables) -> DataFrame:
    ok = F.col("p_partkey") % 3 > 0
    return t.raw("part").select("p_partkey", rules.to_number(F.when(ok, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5"))).otherwise("n/a")).alias("x"), rules.to_number(F.when(ok, F.col("p_size").cast("string")).otherwise("--"), "long").alias("n"))


@query("select o_orderkey, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as d, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end as df from orders")
def date_coerce(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    x = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise("31/31/2020")
    y = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    return t.raw("orders").select("o_orderkey", rules.to_day(x).alias("d"), rules.to_day_first(y).alias("df"))


@query("select o_orderkey, case when o_orderkey % 4 < 3 then date_trunc('second', o_orderdate) end as at from orders")
def run_token_parse(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    x = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HHmmss")).when(k == 1, F.date_format(d, "yyyyMMdd'T'HHmmss")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("latest")
    return t.raw("orders").select("o_orderkey", rules.run_token(x).alias("at"))


@query("select event_id, case when event_id % 3 < 2 then date_trunc('second', ts) end as at from events")
def snapshot_parse(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    x = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")).when(k == 1, F.concat(F.date_format(F.col("ts") + F.expr("interval 7 hours"), "yyyy-MM-dd'T'HH-mm-ss"), F.lit("+07:00"))).otherwise("bad")
    return t.raw("events").select("event_id", rules.run_token(x).alias("at"))


@query("select event_id, case when event_id % 3 < 2 then date_trunc('second', ts) end as at from events")
def epoch_parse(t: Tables) -> DataFrame:
    k, s = F.col("event_id") % 3, F.unix_timestamp("ts")
    return t.raw("events").select("event_id", rules.epoch_or_text(F.when(k == 0, s.cast("string")).when(k == 1, (s * 1000).cast("string")).otherwise("?")).alias("at"))


@query("select p_partkey, array_to_string(case p_partkey % 3 when 0 then [p_brand, p_type] when 1 then [p_brand] else [] end, '|') as x from part")
def array_coerce(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, F.to_json(F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.lit("  ")))).when(k == 1, F.col("p_brand")).otherwise("null")
    return t.raw("part").select("p_partkey", F.concat_ws("|", rules.to_texts(x)).alias("x"))


@query("select event_id, case event_id % 3 when 0 then props when 1 then '{\"raw\":\"' || event_type || '\"}' end as x from events")
def json_coerce(t: Tables) -> DataFrame:
    k = F.col("event_id") % 3
    return t.raw("events").select("event_id", rules.to_json_text(F.when(k == 0, F.col("props")).when(k == 1, F.col("event_type")).otherwise("none")).alias("x"))


@query("select ticker, trading_date, close, volume, null::double as value, null::varchar as source from price")
def conform_dataset(t: Tables) -> DataFrame:
    spec = datasets.DatasetSpec("small", ["ticker", "trading_date"], {"ticker": "string", "trading_date": "date", "close": "double", "volume": "long", "value": "double", "source": "string"})
    raw = t.price().select("ticker", F.col("trading_date").cast("string").alias("trading_date"), F.col("close").cast("string").alias("close"), "volume", F.lit("x").alias("other"))
    return datasets.conform(raw, spec)


@query("select event_id, symbol, close_price as close from board")
def pick_first_column(t: Tables) -> DataFrame:
    b = t.board().withColumnRenamed("symbol", "listing_symbol")
    return b.select("event_id", rules.first_column(b, ["symbol", "listing_symbol"]).alias("symbol"), rules.first_column(b, ["close_price", "match_match_price"]).alias("close"))


@query("select ticker, trading_date, close from price")
def canon_columns(t: Tables) -> DataFrame:
    p = t.price().select(F.col("ticker").alias("Ticker "), F.col("trading_date").alias("Trading Date"), F.lit("x").alias("time"), F.col("close").alias("CLOSE"))
    return rules.canonical_columns(p, silver.DATE_ALIASES).select("ticker", "trading_date", "close")


@query("select p_partkey, p_brand as a_brand, p_type as a_type from part")
def flatten_columns(t: Tables) -> DataFrame:
    return rules.flattened(t.raw("part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("a")))


@query()
def nfc_normalize(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", rules.nfc("text").alias("text"))


@query("select ticker, 'vci' as source, 'stock' as instrument_type, count(*) as n from price group by 1")
def bronze_stamp(t: Tables) -> DataFrame:
    return silver.stamped(t.price(), "VCI", "stock", "2024-01-01").groupBy("ticker", "source", "instrument_type").agg(F.count("*").alias("n"))


# --- quality

@query("select \"check\", failures from (select 'charter_capital' as \"check\", count(*) filter (where charter_capital is null) as failures from company union all select 'ticker', count(*) filter (where ticker is null) from company)")
def check_not_null(t: Tables) -> DataFrame:
    return quality.null_counts(t.company(), ["charter_capital", "ticker"])


@query("select doc_id, count(*) as n from filings group by 1 having count(*) > 1")
def check_unique(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.filings(), ["doc_id"])


@query("select symbol, trading_date, count(*) as n from flagged group by 1, 2 having count(*) > 1", **BOARD)
def check_unique_combo(t: Tables) -> DataFrame:
    return quality.duplicate_keys(silver.clean_board(t.board()), ["symbol", "trading_date"])


@query("select distinct ticker from news where ticker not in (select ticker from company)")
def check_relationship(t: Tables) -> DataFrame:
    return quality.orphans(t.news(), "ticker", t.company(), "ticker")


@query("select ticker, count(*) as n from price group by 1")
def check_required_columns(t: Tables) -> DataFrame:
    return quality.require_columns(t.price(), ["ticker", "trading_date", "close"]).groupBy("ticker").agg(F.count("*").alias("n"))


@query("select sum(n)::bigint as rows, 0::bigint as null_keys, coalesce(sum(n) filter (where n > 1), 0)::bigint as duplicate_rows from (select doc_id, count(*) as n from filings group by 1)")
def check_key_quality(t: Tables) -> DataFrame:
    return quality.key_quality(t.filings(), ["doc_id"])


@query("select status, count(*) as n from filings where status is not null group by 1 having count(*) > 1")
def check_unique_non_null(t: Tables) -> DataFrame:
    return quality.duplicates_of_known(t.filings(), "status")


_RULES = [
    ("not_null: title", "count(*)", "count(*) filter (where title is null)", "null"), ("not_null: status", "count(*)", "count(*) filter (where status is null)", "null"),
    ("not_null: ticker, source", "count(*)", "count(*) filter (where ticker is null or source is null)", "null"), ("size", "count(*)", "count(*) filter (where not file_size > 20000)", "null"), ("address", "count(*)", "count(*) filter (where not url_pdf like '%.pdf')", "null"),
    ("downloads pass", "count(*)", "count(*) filter (where not (status <> 'downloaded' or qc_pass))", "null"),
]
_KEYED = [("unique: doc_id", "doc_id"), ("unique: ticker, source", "ticker || source"), ("unique: status", "status")]
_CHECKS = " union all ".join(
    [f"select '{n}' as rule, {a} as rows, {b} as failures, {c}::bigint as keys from filings" for n, a, b, c in _RULES]
    + [f"select '{n}', coalesce(sum(n), 0)::bigint, coalesce(sum(n) filter (where n > 1), 0)::bigint, count(*) filter (where n > 1) from (select {k} as k, count(*) as n from filings where {k} is not null group by 1)" for n, k in _KEYED]
    + ["select 'refers: ticker to listing', count(*), count(*) filter (where ticker not in (select symbol from listing)), count(distinct ticker) filter (where ticker not in (select symbol from listing)) from filings"]
)


@query(_CHECKS)
def check_table(t: Tables) -> DataFrame:
    """Ten rules of one table in one scan."""
    rules = [
        quality.not_null("title"), quality.not_null("status"), quality.not_null("ticker", "source"), quality.holds("size", F.col("file_size") > 20000), quality.holds("address", F.col("url_pdf").endswith(".pdf")),
        quality.holds("downloads pass", (F.col("status") != "downloaded") | F.col("qc_pass")), quality.unique("doc_id"), quality.unique("ticker", "source"), quality.unique("status"),
        quality.refers(("ticker",), t.listing(), ("symbol",), "listing"),
    ]
    return quality.checked(t.filings(), rules)
