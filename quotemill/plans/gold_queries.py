"""Registered queries of the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.rules import rounded
from quotemill.plans import gold
from quotemill.plans.registry import query
from quotemill.sources.proxy import Tables

INDICATOR_COLUMNS = ["daily_return", "ma7", "ma20", "ma50", "rsi14", "macd_line", "macd_signal", "macd_hist", "bb_middle", "bb_upper", "bb_lower", "volume_ma20"]


def r(sql: str, places: int = 6) -> str:
    return f"round(cast({sql} as decimal(28,10)), {places})::double"


def rounded_all(df: DataFrame, names: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, places) for n in names})


BASE = """select *, lag(close) over w as prev, count(*) over (w rows between unbounded preceding and current row) as row_num from price window w as (partition by ticker order by trading_date)"""
MOVES = """select *, case when prev <> 0 then (close - prev) / prev end as daily_return, greatest(close - prev, 0.0) as gain, greatest(prev - close, 0.0) as loss, case when close > prev then volume when close < prev then -volume else 0 end as signed from base"""
MEANS = """select *, avg(gain) over (w rows 13 preceding) as up, avg(loss) over (w rows 13 preceding) as down, avg(close) over (w rows 6 preceding) as m7, avg(close) over (w rows 19 preceding) as m20, avg(close) over (w rows 49 preceding) as m50,
    avg(close) over (w rows 11 preceding) as m12, avg(close) over (w rows 25 preceding) as m26, stddev_pop(close) over (w rows 19 preceding) as sd, avg(volume) over (w rows 19 preceding) as volume_ma20, sum(signed) over (w rows unbounded preceding) as obv
    from moves window w as (partition by ticker order by trading_date)"""
LINES = """select *, case when row_num >= 26 then m12 - m26 end as macd_line, case when row_num >= 14 and up + down > 1e-9 then 100 - 100 / (1 + up / case when down > 1e-9 then down end) end as rsi14 from means"""
INDICATORS = """select ticker, trading_date, close, volume, row_num, daily_return, case when row_num >= 7 then m7 end as ma7, case when row_num >= 20 then m20 end as ma20, case when row_num >= 50 then m50 end as ma50, rsi14, macd_line,
    avg(macd_line) over (partition by ticker order by trading_date rows 8 preceding) as macd_signal, macd_line - avg(macd_line) over (partition by ticker order by trading_date rows 8 preceding) as macd_hist, case when row_num >= 20 then m20 end as bb_middle,
    case when row_num >= 20 then m20 + 2 * sd end as bb_upper, case when row_num >= 20 then m20 - 2 * sd end as bb_lower, volume_ma20, obv::bigint as obv from lines"""
VIEWS = {"base": BASE, "moves": MOVES, "means": MEANS, "lines": LINES, "indicators": INDICATORS, "returns": "select *, case when lag(close) over w <> 0 then (close - lag(close) over w) / lag(close) over w end as daily_return from price window w as (partition by ticker order by trading_date)"}
INDEX_VIEWS = {
    "index_returns": "select *, case when lag(close) over w <> 0 then (close - lag(close) over w) / lag(close) over w end as index_return from index_price window w as (partition by index_code order by trading_date)",
    "pivoted": "select trading_date, " + ", ".join(f"max(case when index_code = '{c}' then {v} end) as {n}_{s}" for c, n in gold.INDEXES.items() for v, s in (("close", "close"), ("index_return", "return"))) + " from index_returns group by trading_date",
    "breadth": "select trading_date, sum(volume)::bigint as total_volume, sum(value) as total_market_value, count(*) filter (where daily_return > 0) as advances, count(*) filter (where daily_return < 0) as declines, count(*) filter (where daily_return = 0) as unchanged from returns group by trading_date",
    "ranked": "select trading_date, ticker, close, daily_return, row_number() over (partition by trading_date order by daily_return desc, ticker) as g, row_number() over (partition by trading_date order by daily_return, ticker) as l from returns where daily_return is not null",
}
ALL = VIEWS | INDEX_VIEWS
_COLS = ", ".join(f"{r(c)} as {c}" for c in INDICATOR_COLUMNS)


@query(f"select ticker, trading_date, close, volume, row_num, obv, {_COLS} from indicators", **VIEWS)
def price_indicators(t: Tables) -> DataFrame:
    return rounded_all(gold.price_indicators(t.price()), INDICATOR_COLUMNS)


@query(f"select ticker, trading_date, {r('daily_return')} as daily_return from returns", **VIEWS)
def win_lag_return(t: Tables) -> DataFrame:
    return gold.daily_returns(t.price()).select("ticker", "trading_date", rounded("daily_return", 6).alias("daily_return"))


def _indicator(name: str, columns: list[str], plain: tuple[str, ...] = ()):
    cols = ", ".join(f"{r(c)} as {c}" for c in columns) + "".join(f", {c}" for c in plain)

    def run(t: Tables) -> DataFrame:
        return gold.price_indicators(t.price()).select("ticker", "trading_date", *(rounded(c, 6).alias(c) for c in columns), *plain)

    run.__name__ = name
    query(f"select ticker, trading_date, {cols} from indicators", **VIEWS)(run)


for _name, _columns, _plain in (
    ("win_moving_avg", ["ma7", "ma20", "ma50", "volume_ma20"], ()), ("win_warmup_gate", ["ma50", "bb_middle"], ("row_num",)), ("win_gain_loss_rsi", ["rsi14"], ()), ("win_macd", ["macd_line", "macd_signal", "macd_hist"], ()),
    ("win_bollinger", ["bb_middle", "bb_upper", "bb_lower"], ()), ("win_obv", ["daily_return"], ("obv",)), ("win_running_count", ["close"], ("row_num",)),
):
    _indicator(_name, _columns, _plain)


@query(f"select ticker, trading_date, {r('stddev_pop(daily_return) over (partition by ticker order by trading_date rows 19 preceding)')} as volatility20 from returns", **VIEWS)
def win_volatility20(t: Tables) -> DataFrame:
    return gold.with_volatility(gold.daily_returns(t.price())).select("ticker", "trading_date", rounded("volatility20", 6).alias("volatility20"))


@query(f"select trading_date, ticker, close, {r('daily_return')} as daily_return, side, rank from (select *, 'gain' as side, g as rank from ranked where g <= 5 union all select *, 'loss', l from ranked where l <= 5)", **ALL)
def win_rank_movers(t: Tables) -> DataFrame:
    return gold.movers(gold.daily_returns(t.price())).withColumn("daily_return", rounded("daily_return", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(f"select trading_date, ticker, g as rank, {r('daily_return')} as daily_return from ranked where g <= 5", **ALL)
def topk_per_group(t: Tables) -> DataFrame:
    m = gold.movers(gold.daily_returns(t.price())).where("side = 'gain'")
    return m.select("trading_date", "ticker", F.col("rank").cast("long").alias("rank"), rounded("daily_return", 6).alias("daily_return"))


@query(f"select p.ticker, p.trading_date, p.open, p.high, p.low, p.close, p.volume, p.value, i.obv, {_COLS.replace('cast(', 'cast(i.')} from price p left join indicators i on p.ticker = i.ticker and p.trading_date = i.trading_date", **VIEWS)
def join_left_composite(t: Tables) -> DataFrame:
    return rounded_all(gold.price_facts(t.price()), INDICATOR_COLUMNS)


_PIVOT = ", ".join(f"{n}_close, {r(f'{n}_return')} as {n}_return" for n in gold.INDEXES.values())


@query(f"select trading_date, {_PIVOT} from pivoted", **ALL)
def pivot_case_index(t: Tables) -> DataFrame:
    return rounded_all(gold.index_pivot(gold.index_returns(t.index_price())), [f"{n}_return" for n in gold.INDEXES.values()])


@query(f"select trading_date, total_volume, {r('total_market_value', 2)} as total_market_value, advances, declines, unchanged from breadth", **ALL)
def agg_market_breadth(t: Tables) -> DataFrame:
    return gold.market_breadth(gold.daily_returns(t.price())).withColumn("total_market_value", rounded("total_market_value", 2))


@query("select trading_date, advances + declines + unchanged as universe_size, advances from breadth", **ALL)
def agg_count_filter(t: Tables) -> DataFrame:
    return gold.market_breadth(gold.daily_returns(t.price())).select("trading_date", (F.col("advances") + F.col("declines") + F.col("unchanged")).alias("universe_size"), "advances")


def _tops(t: Tables) -> DataFrame:
    m = gold.movers(gold.daily_returns(t.price())).withColumn("percent_change", rounded(F.col("daily_return") * 100, 2))
    line = F.concat_ws(":", "ticker", F.format_string("%.2f", "close"), F.format_string("%.2f", "percent_change"))
    pick = lambda s: F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("rank", line.alias("line"))))), lambda x: x["line"]))
    return m.groupBy("trading_date").agg(pick("gain").alias("gainers"), pick("loss").alias("losers"))


_LINE = "ticker || ':' || printf('%.2f', close) || ':' || printf('%.2f', round(cast(daily_return * 100 as decimal(28,10)), 2)::double)"
_TOPS = f"select trading_date, coalesce(string_agg({_LINE}, ';' order by g) filter (where g <= 5), '') as gainers, coalesce(string_agg({_LINE}, ';' order by l) filter (where l <= 5), '') as losers from ranked where g <= 5 or l <= 5 group by trading_date"


@query(_TOPS, **ALL)
def agg_json_topn(t: Tables) -> DataFrame:
    """The lists of :func:`gold.movers_json`, printed alike on both sides."""
    m = gold.movers_json(gold.daily_returns(t.price()))
    item = "array<struct<ticker string, close double, percent_change double>>"
    show = lambda c: F.concat_ws(";", F.transform(F.from_json(c, item), lambda x: F.concat_ws(":", x["ticker"], F.format_string("%.2f", x["close"]), F.format_string("%.2f", x["percent_change"]))))
    return m.select("trading_date", show("top_gainers").alias("gainers"), show("top_losers").alias("losers"))


@query(f"select p.trading_date, {_PIVOT}, b.total_volume, {r('b.total_market_value', 2)} as total_market_value, b.advances, b.declines, b.unchanged, b.advances + b.declines + b.unchanged as universe_size, coalesce(gainers, '') as gainers, coalesce(losers, '') as losers from pivoted p join breadth b on p.trading_date = b.trading_date left join tops m on p.trading_date = m.trading_date", **ALL, tops=_TOPS)
def market_overview(t: Tables) -> DataFrame:
    o = rounded_all(gold.market_overview(t.price(), t.index_price()), [f"{n}_return" for n in gold.INDEXES.values()]).withColumn("total_market_value", rounded("total_market_value", 2))
    item = "array<struct<ticker string, close double, percent_change double>>"
    show = lambda c: F.concat_ws(";", F.transform(F.from_json(c, item), lambda x: F.concat_ws(":", x["ticker"], F.format_string("%.2f", x["close"]), F.format_string("%.2f", x["percent_change"]))))
    return o.withColumns({"gainers": show("top_gainers"), "losers": show("top_losers")}).drop("top_gainers", "top_losers")


@query("select p.trading_date, vnindex_close, advances, declines from pivoted p join breadth b on p.trading_date = b.trading_date", **ALL)
def join_inner_left_mix(t: Tables) -> DataFrame:
    return gold.market_overview(t.price(), t.index_price()).select("trading_date", "vnindex_close", "advances", "declines")


DIM = "select c.ticker, l.exchange, coalesce(l.organ_name, c.ticker) as organ_name, c.company_type as industry, c.company_type as sector, c.founded_date, year(c.founded_date) as established_year, c.charter_capital, c.number_of_employees, c.ticker as symbol, " + ", ".join(f"null::{k.replace('string', 'varchar')} as {x}" for x, k in gold.COMPANY_COLUMNS.items()) + " from company c left join listing l on c.ticker = l.symbol"
PROFILE = {
    "dim": DIM, "latest": "select ticker, arg_max(close, trading_date) as latest_close, max(trading_date) as latest_trading_date from price group by ticker",
    "year_range": "select ticker, max(close) as high_52w, min(close) as low_52w from price where trading_date >= (select max(trading_date) from price) - interval 365 day group by ticker",
    "volumes": f"select ticker, {r('avg(volume)', 4)} as avg_volume_20d from (select ticker, volume, row_number() over (partition by ticker order by trading_date desc) as n from price) where n <= 20 group by ticker",
    "last_period": "select ticker, max(period) as period from ratio where item_code in ('pe_ratio', 'pb_ratio', 'trailing_eps', 'roe', 'roa') and value is not null group by ticker",
    "ratios": "select r.ticker, " + ", ".join(f"max(case when item_code = '{i}' then value end) as {c}" for c, i in gold.PROFILE_ITEMS.items()) + " from ratio r join last_period p on r.ticker = p.ticker and r.period = p.period group by r.ticker",
    "profile": "select d.*, latest_close, latest_trading_date, high_52w, low_52w, avg_volume_20d, pe_ratio, pb_ratio, eps, roe, roa from dim d left join latest using (ticker) left join year_range using (ticker) left join volumes using (ticker) left join ratios using (ticker)",
}


@query("select * from dim", **PROFILE)
def join_left_equi(t: Tables) -> DataFrame:
    return gold.dim_company(t.company(), t.listing())


@query("select * from latest", **PROFILE)
def distinct_on(t: Tables) -> DataFrame:
    return gold.latest_close(t.price())


@query("select * from year_range", **PROFILE)
def agg_52w(t: Tables) -> DataFrame:
    return gold.range_52w(t.price())


@query("select ticker, count(*) as n, max(close) as top from price where trading_date >= (select max(trading_date) from price) - interval 365 day group by ticker", **PROFILE)
def join_cross_scalar(t: Tables) -> DataFrame:
    p = t.price()
    newest = p.agg(F.max("trading_date").alias("newest"))
    return p.crossJoin(F.broadcast(newest)).where(F.col("trading_date") >= F.date_sub("newest", 365)).groupBy("ticker").agg(F.count("*").alias("n"), F.max("close").alias("top"))


@query("select * from volumes", **PROFILE)
def agg_lastN_avg(t: Tables) -> DataFrame:
    return gold.mean_volume(t.price()).withColumn("avg_volume_20d", rounded("avg_volume_20d", 4))


@query("select * from ratios", **PROFILE)
def agg_latest_period_ratios(t: Tables) -> DataFrame:
    return gold.latest_ratios(t.ratio())


@query("select ticker, period, item_code, value from (select *, max(case when item_code in ('pe_ratio', 'pb_ratio', 'trailing_eps', 'roe', 'roa') and value is not null then period end) over (partition by ticker) as newest from ratio) where period = newest")
def join_inner_composite(t: Tables) -> DataFrame:
    r_ = t.ratio()
    last = r_.where(F.col("item_code").isin(*gold.PROFILE_ITEMS.values()) & F.col("value").isNotNull()).groupBy("ticker").agg(F.max("period").alias("period"))
    return r_.join(last, ["ticker", "period"]).select("ticker", "period", "item_code", "value")


@query("select * from profile", **PROFILE)
def company_profile(t: Tables) -> DataFrame:
    return gold.company_profile(t.company(), t.listing(), t.price(), t.ratio()).withColumn("avg_volume_20d", rounded("avg_volume_20d", 4))


@query("select ticker, latest_close, high_52w, low_52w, avg_volume_20d, pe_ratio from profile", **PROFILE)
def join_multi_left(t: Tables) -> DataFrame:
    return company_profile(t).select("ticker", "latest_close", "high_52w", "low_52w", "avg_volume_20d", "pe_ratio")


WIDE = {
    "wide": "select ticker, period, period_type, year, quarter, " + ", ".join(f"max(case when item_code = '{i}' then value end)::double as {c}" for c, i in gold.SUMMARY_ITEMS.items()) + " from ratio group by all",
    "annual": f"select ticker, year::varchar as period, 'annual' as period_type, year, null::bigint as quarter, {', '.join(gold.SUMMARY_ITEMS)} from (select *, row_number() over (partition by ticker, year order by quarter desc nulls last, period desc) as n from wide) where n = 1",
}


@query("select * from wide", **WIDE)
def pivot_case_ratios(t: Tables) -> DataFrame:
    return gold.ratio_pivot(t.ratio())


@query("select * from annual", **WIDE)
def latest_quarter_as_annual(t: Tables) -> DataFrame:
    return gold.latest_quarter_as_annual(gold.ratio_pivot(t.ratio()))


@query("select * from wide union all select * from annual", **WIDE)
def financial_summary(t: Tables) -> DataFrame:
    return gold.financial_summary(t.ratio())


@query("select period_type, count(*) as n, count(eps) as n_eps from (select * from wide union all select * from annual) group by 1", **WIDE)
def union_all(t: Tables) -> DataFrame:
    return gold.financial_summary(t.ratio()).groupBy("period_type").agg(F.count("*").alias("n"), F.count("eps").alias("n_eps"))


EVERYONE = "select upper(symbol) as ticker from listing union select upper(ticker) from company union select upper(ticker) from price union select upper(ticker) from news union select upper(ticker) from filings"
DIRECTORY = {
    "everyone": EVERYONE,
    "directory": """select u.ticker, coalesce(d.exchange, l.exchange) as exchange, coalesce(d.organ_name, l.organ_name) as organ_name, l.type as security_type, d.ticker is not null as has_full_profile, coalesce(p.n, 0) > 0 as has_price, coalesce(w.n, 0) > 0 as has_news, coalesce(f.n, 0) > 0 as has_docs,
        coalesce(w.n, 0) as news_count, coalesce(f.n, 0) as doc_count, p.newest as latest_trading_date, w.newest as latest_news_at, f.newest as latest_doc_at
        from everyone u left join listing l on u.ticker = upper(l.symbol) left join dim d on u.ticker = upper(d.ticker)
        left join (select upper(ticker) as ticker, count(*) as n, max(trading_date) as newest from price group by 1) p on u.ticker = p.ticker
        left join (select upper(ticker) as ticker, count(*) as n, max(published_at) as newest from news group by 1) w on u.ticker = w.ticker
        left join (select upper(ticker) as ticker, count(*) as n, max(published_at) as newest from filings group by 1) f on u.ticker = f.ticker""",
}


def directory(t: Tables) -> DataFrame:
    return gold.ticker_directory(t.listing(), gold.dim_company(t.company(), t.listing()), t.price(), t.news(), t.filings())


@query("select * from directory", **PROFILE, **DIRECTORY)
def ticker_directory(t: Tables) -> DataFrame:
    return directory(t)


@query("select ticker from everyone", **DIRECTORY)
def union_distinct_5way(t: Tables) -> DataFrame:
    return gold.ticker_universe((t.listing(), "symbol"), (t.company(), "ticker"), (t.price(), "ticker"), (t.news(), "ticker"), (t.filings(), "ticker"))


@query("select ticker, has_price, has_news, has_docs, has_full_profile from directory", **PROFILE, **DIRECTORY)
def agg_presence_flags(t: Tables) -> DataFrame:
    return directory(t).select("ticker", "has_price", "has_news", "has_docs", "has_full_profile")


@query("select ticker, l.exchange from everyone u join listing l on u.ticker = upper(l.symbol)", **DIRECTORY)
def join_upper_key(t: Tables) -> DataFrame:
    return directory(t).where("security_type is not null").select("ticker", F.col("exchange"))


@query("select count(*) filter (where has_news) as with_news, count(*) filter (where has_docs) as with_docs, sum(doc_count)::bigint as docs from directory", **PROFILE, **DIRECTORY)
def agg_directory_summary(t: Tables) -> DataFrame:
    return directory(t).agg(F.count_if("has_news").alias("with_news"), F.count_if("has_docs").alias("with_docs"), F.sum("doc_count").alias("docs"))


@query("select trading_date, count(*) as n from price where trading_date in (select trading_date from index_price where index_code = 'VN30') group by 1")
def join_semi_in(t: Tables) -> DataFrame:
    days = t.index_price().where("index_code = 'VN30'").select("trading_date").distinct()
    return t.price().join(days, "trading_date", "left_semi").groupBy("trading_date").agg(F.count("*").alias("n"))


@query("select ticker, count(*) as n from price where ticker in (select ticker from company) group by 1")
def join_semi_using_distinct(t: Tables) -> DataFrame:
    return t.price().join(t.company().select("ticker").distinct(), "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))


@query("select min(trading_date) as first_day, max(trading_date) as last_day, count(*) filter (where trading_date = (select max(trading_date) from price)) as on_last from price")
def subquery_scalar(t: Tables) -> DataFrame:
    p = t.price()
    return p.crossJoin(F.broadcast(p.agg(F.max("trading_date").alias("top")))).agg(F.min("trading_date").alias("first_day"), F.max("trading_date").alias("last_day"), F.count_if(F.col("trading_date") == F.col("top")).alias("on_last"))
