"""Cleaning transforms: raw tables of drifting shape to typed, deduplicated tables with flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quotemill.functions import rules
from quotemill.operators.keyed import ranked_dedupe
from quotemill.operators.quality import require_columns

#: Prices of shares are quoted in thousands.
FACTORS = {"stock": 1000.0, "index": 1.0}
DATE_ALIASES = {"trading_date": ["trading_date", "tradingdate", "time", "date"]}


def trading_value(close: Column, volume: Column, value: Column, kind: str) -> tuple[Column, Column]:
    """The full value, and whether it is derived: missing values are close * volume * factor; values within 5 % of
    close * volume lack the factor."""
    factor, plain = FACTORS[kind], close * volume
    ratio = value / F.when(plain != 0, plain)
    fixed = F.when(F.abs(ratio - 1) <= 0.05, value * factor).otherwise(value) if factor != 1 else value
    return F.when(value.isNull(), plain * factor).otherwise(fixed), value.isNull()


def clean_price(raw: DataFrame, key: str = "ticker", kind: str = "stock", observe: Observation | None = None) -> DataFrame:
    """Typed prices, one row a key and day, the one fetched last; prices below zero or high < low are suspicious."""
    d = require_columns(rules.canonical_columns(raw, DATE_ALIASES | {key: [key]}), [key, "trading_date", "open", "high", "low", "close", "volume"])
    d = d.select(
        rules.upper_or(key).alias(key), rules.to_day("trading_date").alias("trading_date"), *(rules.to_number(c).alias(c) for c in ("open", "high", "low", "close")), rules.to_number("volume").cast("long").alias("volume"),
        rules.to_number(rules.first_column(d, ["value"], "double")).alias("raw_value"), rules.to_bool(rules.first_column(d, ["is_suspicious"]), False).alias("was_suspicious"), rules.lower_or(rules.first_column(d, ["source"])).alias("source"),
        rules.lower_or(rules.first_column(d, ["instrument_type"]), kind).alias("instrument_type"), rules.first_column(d, ["fetched_at"], "long").alias("fetched_at"), rules.first_column(d, ["source_file"]).alias("source_file"),
    )
    value, derived = trading_value(F.col("close"), F.col("volume"), F.col("raw_value"), kind)
    negative = F.least("open", "high", "low", "close") < 0
    upside = F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    valid = F.col(key).isNotNull() & F.col("trading_date").isNotNull()
    if observe is not None:
        d = d.observe(observe, F.count("*").alias("rows_in"), F.count_if(~valid).alias("invalid_key"), F.count_if(F.col("close").isNull()).alias("null_close"), F.count_if(negative).alias("negative"), F.count_if(upside).alias("high_below_low"), F.count_if(F.col("instrument_type") != kind).alias("other_instrument"))
    d = d.where(valid).withColumns({"value": value, "value_is_derived": derived, "is_suspicious": F.col("was_suspicious") | F.coalesce(negative, F.lit(False)) | upside})
    d = ranked_dedupe(d, [key, "trading_date"], [F.desc_nulls_last("fetched_at"), F.desc_nulls_last("source_file"), F.desc_nulls_last("close")])
    return d.select(key, "trading_date", "open", "high", "low", "close", "volume", "value", "value_is_derived", "is_suspicious", "source", "instrument_type", "fetched_at")


def ohlcv_gate(price: DataFrame, least: int = 5, most_bad: float = 0.05) -> DataFrame:
    """ticker, source, rows, accepted, reason: enough rows, valid days, some close, few rows with high < low."""
    g = price.groupBy("ticker", "source").agg(F.count("*").alias("rows"), F.count("close").alias("closes"), F.count("trading_date").alias("days"), F.count_if(F.col("high") < F.col("low")).alias("bad"))
    reason = F.when(F.col("rows") < least, "too_few_rows").when(F.col("days") < F.col("rows"), "invalid_date").when(F.col("closes") == 0, "no_close").when(F.col("bad") / F.col("rows") > most_bad, "high_below_low")
    return g.select("ticker", "source", "rows", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def first_accepted(gate: DataFrame, priority: list[str]) -> DataFrame:
    """Per ticker the first accepted source in order of priority."""
    at = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("source"))
    ok = gate.where("accepted").withColumn("priority", F.when(at > 0, at).otherwise(len(priority) + 1))
    return ranked_dedupe(ok, ["ticker"], [F.asc("priority"), F.asc("source")]).select("ticker", "source", "rows")


def quality_report(price: DataFrame) -> DataFrame:
    miss = lambda c: rules.rounded(F.count_if(F.col(c).isNull()) * 100.0 / F.count("*"), 4)
    return price.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("trading_date").alias("first_day"), F.max("trading_date").alias("last_day"), miss("close").alias("missing_close_pct"), miss("value").alias("missing_value_pct"))


def first_nonempty(frames: DataFrame, sources: list[str], kinds: tuple[str, ...] = ("quarter", "year")) -> DataFrame:
    """Per ticker the first (source, kind) with rows: all sources by quarter before any by year of the next source."""
    rank = lambda c, names: F.array_position(F.array(*(F.lit(n) for n in names)), F.col(c))
    have = frames.groupBy("ticker", "source", "kind").agg(F.count("*").alias("rows")).withColumns({"s": rank("source", sources), "k": rank("kind", kinds)}).where("s > 0 and k > 0")
    return ranked_dedupe(have, ["ticker"], [F.asc("s"), F.asc("k")]).select("ticker", "source", "kind", "rows")


def stamped(df: DataFrame, source: str, kind: str, fetched_at) -> DataFrame:
    return df.withColumns({"source": F.lit(source.lower()), "instrument_type": F.lit(kind), "fetched_at": F.lit(fetched_at)})


def clean_listing(raw: DataFrame) -> DataFrame:
    """Shares only (by type where any row has one), latest row per symbol."""
    d = raw.select(rules.upper_or("symbol").alias("symbol"), rules.compact("organ_name").alias("organ_name"), rules.upper_or("exchange", "UNKNOWN").alias("exchange"), rules.lower_or("type").alias("type"), F.col("ord"))
    typed = d.agg(F.max(F.col("type").isNotNull()).alias("any_type"))
    d = d.crossJoin(F.broadcast(typed)).where("symbol is not null and (not coalesce(any_type, false) or type = 'stock')").drop("any_type")  # one row
    return ranked_dedupe(d, ["symbol"], [F.desc("ord")]).drop("ord")


def clean_company(raw: DataFrame) -> DataFrame:
    d = raw.select(
        rules.upper_or("ticker").alias("ticker"), rules.compact("company_type").alias("company_type"), F.col("founded_date").cast("string").alias("f"), rules.to_number("charter_capital").alias("charter_capital"), rules.to_number("number_of_employees", "long").alias("number_of_employees"), F.col("snapshot"))
    d = d.where("ticker is not null").withColumn("founded_date", rules.to_day("f")).drop("f")
    return ranked_dedupe(d, ["ticker"], [F.desc_nulls_last("snapshot")]).drop("snapshot")


PERIOD = r"^(\d{4})-(Q[1-4]|year)(\w*)$"


def unpivot_periods(wide: DataFrame, ids: list[str]) -> DataFrame:
    """ids, period_column, column_at, value for every column that looks like a period; nulls are kept."""
    import re

    periods = [c for c in wide.columns if re.match(PERIOD, c)]
    long = wide.unpivot(ids, periods, "period_column", "value")
    return long.withColumn("column_at", F.array_position(F.array(*(F.lit(p) for p in periods)), F.col("period_column")))


def decode_periods(long: DataFrame) -> DataFrame:
    """period, period_type, year, quarter from period_column; names that are no period go."""
    c = F.col("period_column")
    year, part = F.regexp_extract(c, PERIOD, 1), F.regexp_extract(c, PERIOD, 2)
    annual = part == "year"
    return long.where(c.rlike(PERIOD)).withColumns({"period": F.concat_ws("-", year, part), "period_type": F.when(annual, "annual").otherwise("quarter"), "year": year.cast("int"), "quarter": F.when(~annual, F.substring(part, 2, 1).cast("int"))})


def collapse_suffixes(decoded: DataFrame) -> DataFrame:
    """Of columns of one period the rightmost wins."""
    return ranked_dedupe(decoded, ["ticker", "item_code", "period", "snapshot"], [F.desc("column_at")])


def rightmost_periods(wide: DataFrame) -> DataFrame:
    """Of columns of one period the rightmost alone: :func:`collapse_suffixes` before anything is unpivoted."""
    import re

    last = {"-".join(m.groups()[:2]): c for c in wide.columns if (m := re.match(PERIOD, c))}
    return wide.select(*(F.col(f"`{c}`") for c in wide.columns if not re.match(PERIOD, c) or c in last.values()))


def clean_ratio(wide: DataFrame) -> DataFrame:
    """Long ratios, the latest snapshot per (ticker, item, period)."""
    d = rightmost_periods(wide).withColumns({"ticker": rules.upper_or("ticker"), "item_code": rules.lower_or("item_code")}).where("ticker is not null and item_code is not null")
    d = ranked_dedupe(d, ["ticker", "item_code"], [F.desc("snapshot")])  # all rows have the same periods, so the latest row is the latest of each
    d = decode_periods(unpivot_periods(d, ["ticker", "item_code", "snapshot"])).withColumn("value", rules.to_number("value"))
    return d.select("ticker", "item_code", "period", "period_type", "year", "quarter", "value", "snapshot")


def board_flags(d: DataFrame) -> DataFrame:
    """Suspicious: no positive close, high < low, ceiling < floor, negative volume; unknown counts as fine."""
    bad = lambda c: F.coalesce(c, F.lit(False))
    have = lambda a, b: bad(F.col(a) < F.col(b)) if a in d.columns and b in d.columns else F.lit(False)
    return d.withColumn("is_suspicious", bad(F.col("close_price") <= 0) | have("high_price", "low_price") | have("ceiling_price", "floor_price") | bad(F.col("volume") < 0))


def clean_board(raw: DataFrame, zone: str = "UTC") -> DataFrame:
    """Symbols upper, exchange known, the day of the snapshot, flags."""
    d = raw.withColumns({"symbol": rules.upper_or(rules.first_column(raw, ["symbol", "listing_symbol"])), "exchange": rules.upper_or(rules.first_column(raw, ["exchange", "listing_exchange"]), "UNKNOWN")})
    d = d.where("symbol is not null").withColumn("trading_date", F.to_date(F.from_utc_timestamp("snapshot_at", zone)))
    return board_flags(d)


def board_latest(board: DataFrame) -> DataFrame:
    return ranked_dedupe(board, ["symbol", "trading_date"], [F.desc_nulls_last("snapshot_at"), F.desc("event_id")])


def richest_article(news: DataFrame) -> DataFrame:
    """Per article the longest body, then one with a time, then the page before the feed."""
    feed = F.col("source").endswith("_rss").cast("int")
    return ranked_dedupe(news, ["article_id"], [F.desc(F.length(F.coalesce("body_text", F.lit("")))), F.desc(F.col("published_at").isNotNull()), feed.asc(), F.asc("source"), F.asc("doc_id")])


def first_per_source(news: DataFrame, order: str) -> DataFrame:
    return ranked_dedupe(news, ["source", "article_id"], [F.asc(order)])


def days_back(news: DataFrame, as_of, days: int, strict: bool = False) -> DataFrame:
    """Articles of the last days; those without a time stay unless strict."""
    recent = F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return news.where(recent if strict else recent | F.col("published_at").isNull())


def load_dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in the configured order, nulls first."""
    return ranked_dedupe(df, keys, [F.desc_nulls_last(c) for c in order])


def filing_period(df: DataFrame) -> Column:
    """A given key in upper case, else a period from title and address."""
    given = rules.upper_or(rules.first_column(df, ["period_key"]))
    text = F.lower(F.concat_ws(" ", *(df[c] for c in ("title", "normalized_title", "url_pdf") if c in df.columns)))
    found = F.when(text.rlike(r"(?U)\bquý\s*i\b|\bq1\b"), "Q1").when(text.rlike(r"(?U)\bquý\s*ii\b|\bq2\b"), "Q2").when(text.rlike(r"(?U)\bquý\s*iii\b|\bq3\b"), "Q3").when(text.rlike(r"(?U)\bquý\s*iv\b|\bq4\b"), "Q4")
    found = found.when(text.contains("bán niên") | text.contains("6 tháng"), "H1").when(text.contains("9 tháng"), "9M").when(text.contains("năm") | text.contains("annual") | text.contains("thường niên"), "ANNUAL").otherwise("GENERAL")
    return F.coalesce(given, found)


def display_status() -> Column:
    status, qc = F.lower(F.trim(F.coalesce("status", F.lit("")))), F.coalesce("qc_pass", F.lit(False))
    there = F.coalesce(F.col("file_size") > 0, F.lit(False)) & (F.trim(F.coalesce("url_pdf", F.lit(""))) != "")
    return F.when((status == "downloaded") & qc & there, "available").when(status.startswith("skipped"), "skipped").when(status.contains("failed") | ~qc, "failed").otherwise("unknown")


def clean_filings(raw: DataFrame) -> DataFrame:
    """Typed document metadata, one row a doc_id: downloaded before others, checked before others, larger before smaller."""
    d = raw.withColumns({"period_key": filing_period(raw), "display_status": display_status()}).withColumn("is_available_for_web", F.col("display_status") == "available")
    order = [F.desc(F.coalesce(F.col("status") == "downloaded", F.lit(False))), F.desc(F.coalesce("qc_pass", F.lit(False))), F.desc_nulls_last("file_size"), F.asc("p_partkey")]
    return ranked_dedupe(d, ["doc_id"], order)


def web_filings(clean: DataFrame) -> DataFrame:
    return clean.where("display_status <> 'error' and is_available_for_web and doc_id is not null")
