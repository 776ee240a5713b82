"""Incremental refreshes that equal full ones, ticker universes, and small state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.operators.keyed import newest, ranked_dedupe
from quotemill.plans import gold

#: Rows before the first new one that the longest frames reach back to: 50 closes; the signal line adds 9 to 26.
ROWS_BACK = 60


def _state(rows: DataFrame) -> DataFrame:
    """ticker, rows_seen, obv, last_day and the last ``ROWS_BACK`` rows, from rows with ticker, trading_date, close, volume, row_num
    and obv that hold at least these for each ticker."""
    of_ticker = W.partitionBy("ticker")
    last = rows.withColumn("rows_seen", F.max("row_num").over(of_ticker)).where("row_num > rows_seen - " + str(ROWS_BACK))
    kept = F.sort_array(F.collect_list(F.struct("trading_date", "close", "volume")))
    return last.groupBy("ticker").agg(F.max("rows_seen").alias("rows_seen"), F.max_by("obv", "row_num").alias("obv"), F.max("trading_date").alias("last_day"), kept.alias("kept"))


def indicator_state(price: DataFrame) -> DataFrame:
    """What later runs need of a ticker's history: ticker, rows_seen, obv, last_day, kept (its last ``ROWS_BACK`` rows)."""
    before = F.lag("close").over(gold.series())
    signed = F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0)
    rows = price.select("ticker", "trading_date", "close", "volume", signed.alias("signed"))
    rows = rows.withColumns({"row_num": F.count("*").over(gold.running()), "obv": F.sum("signed").over(gold.running())})
    return _state(rows)


def advanced_indicators(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Indicators of the new rows, the state after them); no row before them is read but those that the state keeps.

    ``new`` has ticker, trading_date, close, volume, one row for each key; rows on or before a ticker's last day are left out
    (see :func:`quotemill.operators.keyed.late_rows`).  The second result holds the tickers with new rows, to be merged into a stored state."""
    seen_of = {"rows_seen": "bigint", "obv_seen": "bigint", "last_day": "date"}
    known = state.select("ticker", F.inline("kept"), "rows_seen", F.col("obv").alias("obv_seen"), "last_day", F.lit(False).alias("is_new"))
    new = new.select("ticker", "trading_date", "close", "volume", *(F.lit(None).cast(kind).alias(c) for c, kind in seen_of.items()), F.lit(True).alias("is_new"))
    # one exchange and one sort by (ticker, day) serve these windows and those of the indicators
    whole = gold.series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    both = known.unionByName(new).withColumns({c: F.max(c).over(whole) for c in seen_of})
    both = both.where("not is_new or last_day is null or trading_date > last_day").withColumn("any_new", F.max("is_new").over(whole)).where("any_new")
    local = gold.price_indicators(both, keep=tuple(seen_of))
    # numbers and balances go on from those of the last row that was seen
    seen = F.when(F.col("trading_date") == F.col("last_day"), F.struct("row_num", "obv"))
    at_last = F.max(seen).over(whole)
    local = local.withColumn("at_last", at_last)
    moved = local.withColumns({
        "row_num": F.col("row_num") + F.coalesce(F.col("rows_seen") - F.col("at_last.row_num"), F.lit(0)),
        "obv": F.col("obv") + F.coalesce(F.col("obv_seen") - F.col("at_last.obv"), F.lit(0)),
    })
    out = moved.where("last_day is null or trading_date > last_day").drop("rows_seen", "obv_seen", "last_day", "at_last")
    return out, _state(moved.select("ticker", "trading_date", "close", "volume", "row_num", "obv"))


def state_after(state: DataFrame, done: DataFrame) -> DataFrame:
    """The second result of :func:`advanced_indicators`, from its first one as stored: nothing is computed again."""
    known = state.select("ticker", "rows_seen", "obv", F.size("kept").alias("n"), F.posexplode("kept").alias("at", "row"))
    known = known.select("ticker", "row.trading_date", "row.close", "row.volume", (F.col("rows_seen") - F.col("n") + F.col("at") + 1).alias("row_num"), "obv", F.lit(False).alias("is_new"))
    both = known.unionByName(done.select("ticker", "trading_date", "close", "volume", "row_num", "obv", F.lit(True).alias("is_new")))
    return _state(both.withColumn("any_new", F.max("is_new").over(W.partitionBy("ticker"))).where("any_new"))


def market_overview(price: DataFrame, index: DataFrame, done) -> DataFrame:
    """The overview of the days after ``done``; returns of the first new day reach back to each key's last session before."""
    if done is None:
        return gold.market_overview(price, index)

    def tail(df: DataFrame, key: str) -> DataFrame:
        fresh = F.col("trading_date") > F.lit(done)
        before = df.where(~fresh).groupBy(key).agg(F.max("trading_date").alias("trading_date"))
        return df.where(fresh).unionByName(df.join(before, [key, "trading_date"], "left_semi"))

    return gold.market_overview(tail(price, "ticker"), tail(index, "index_code")).where(F.col("trading_date") > F.lit(done))


def _universe(listing: DataFrame, exchanges: list[str] | None, kinds: list[str] | None) -> DataFrame:
    d = listing.where(F.trim(F.coalesce("symbol", F.lit(""))) != "")
    if exchanges:
        d = d.where(F.upper(F.trim("exchange")).isin(*(e.upper() for e in exchanges)))
    if kinds:
        kind = next((c for c in ("type", "security_type", "instrument_type") if c in d.columns), None)
        if kind:
            d = d.where(F.lower(F.trim(kind)).isin(*(k.lower() for k in kinds)))
    return d.withColumn("symbol", F.upper(F.trim("symbol")))


def listing_universe(listing: DataFrame, exchanges: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    return _universe(listing, exchanges, kinds).select("symbol").distinct().orderBy("symbol")


def demand_rows(universe: DataFrame) -> DataFrame:
    if universe.isEmpty():
        raise ValueError("the universe is empty")
    return universe


def ordered_universe(listing: DataFrame, exchanges: list[str] | None, kinds: list[str] | None, order: str) -> DataFrame:
    """symbol and its first place in the file."""
    return _universe(listing, exchanges, kinds).groupBy("symbol").agg(F.min(order).alias(order)).orderBy(order)


def watchlist(symbols: DataFrame, order: str, most: int) -> DataFrame:
    s = symbols.select(F.upper(F.trim("symbol")).alias("symbol"), order).where("symbol <> ''")
    return s.groupBy("symbol").agg(F.min(order).alias(order)).orderBy(order).limit(most)


def merged_lists(parts: list[DataFrame], headers: dict[str, list[str]], key: str, order: str) -> DataFrame:
    """Lists with alternative headers as one, the first row of a key wins."""
    out = None
    for p in parts:
        one = p.select(*(F.coalesce(*(p[c] for c in names if c in p.columns)).alias(target) for target, names in headers.items()), order)
        out = one if out is None else out.unionByName(one)
    return ranked_dedupe(out, [key], [F.asc(order)])


def run_type(df: DataFrame, key: str, day: str, window: int) -> DataFrame:
    return df.groupBy(key).agg(F.when(F.datediff(F.max(day), F.min(day)) > window + 7, "backfill").otherwise("incremental").alias("run_type"))


def run_stats(df: DataFrame, expected: int) -> DataFrame:
    n = F.count_distinct("ticker")
    return df.agg(F.min("trading_date").alias("first_day"), F.max("trading_date").alias("last_day"), F.count("*").alias("rows"), n.alias("tickers"), F.when(n >= expected, "success").otherwise("partial").alias("status"))


def advanced(state: DataFrame, now: DataFrame) -> DataFrame:
    """A table of watermarks (dataset, mark) that only move on."""
    return state.unionByName(now).groupBy("dataset").agg(F.max("mark").alias("mark"))
