"""Parameterised reads over marts: filters that may be absent, order with explicit nulls, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import substring
from quotemill.plans import gold, text


def filtered(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """Conditions that are None do not filter."""
    for c in conditions.values():
        if c is not None:
            df = df.where(c)
    return df


def between(column: str, first=None, last=None) -> dict[str, Column | None]:
    return {"first": None if first is None else F.col(column) >= F.lit(first), "last": None if last is None else F.col(column) <= F.lit(last)}


def equals(column: str, value) -> Column | None:
    return None if value is None else F.upper(column) == str(value).upper()


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def after(values: list, order: list[tuple[str, bool]]) -> Column:
    """Rows behind the one with these values in the order of (column, descending) pairs; nulls come last either way."""
    out, same = F.lit(False), F.lit(True)
    for value, (name, down) in zip(values, order, strict=True):
        c = F.col(name)
        if value is None:
            behind, equal = F.lit(False), c.isNull()
        else:
            behind, equal = ((c < F.lit(value)) if down else (c > F.lit(value))) | c.isNull(), c == F.lit(value)
        out = out | (same & F.coalesce(behind, F.lit(False)))
        same = same & F.coalesce(equal, F.lit(False))
    return out


def _sorted(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: list | None = None, size: int = 20) -> DataFrame:
    """The page behind the last row of the page before (its values in the order's columns; None: the first page).

    ``order`` must be total.  The filter reaches the scan, and each task keeps ``size`` rows."""
    return (df if last is None else df.where(after(last, order))).orderBy(*_sorted(order)).limit(size)


def numbered_page(df: DataFrame, order: list[tuple[str, bool]], number: int, size: int = 20, ranges: int = 1000) -> DataFrame:
    """Page ``number`` (from 1) without a sort of the pages before it.

    The first column's values are cut into ranges of about equal rows, one aggregation counts them, and only the ranges that the page lies in are
    sorted.  A value that fills ranges alone is one range."""
    name, down = order[0]
    cuts = df.agg(F.percentile_approx(name, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted({x for x in cuts if x is not None})
    c = F.col(name)
    # the number of bounds below a value; nulls behind all
    at = F.when(c.isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < c)) if bounds else F.lit(0))
    place = F.when(c.isNull() | F.lit(not down), at).otherwise(F.lit(len(bounds)) - at)
    counts = sorted((r["place"], r["n"]) for r in df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())  # ``ranges`` + 1 rows at most
    first, skip, left, wanted = (number - 1) * size, 0, size, []
    for k, n in counts:
        if first >= n and not wanted:
            first -= n
            continue
        if not wanted:
            skip, left = first, size + first
        wanted.append(k)
        left -= n
        if left <= 0:
            break
    if not wanted:
        return df.limit(0)
    return df.where(place.isin(*wanted)).orderBy(*_sorted(order)).offset(skip).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total, page, page_size, has_more."""
    return df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), (F.col("total") > number * size).alias("has_more"))


def prices(price: DataFrame, symbol: str, first=None, last=None, number: int = 1, size: int = 20) -> DataFrame:
    """Returns are taken before the range is cut."""
    own = gold.daily_returns(price.where(equals("ticker", symbol)))
    return page(filtered(own, **between("trading_date", first, last)), [F.desc("trading_date")], number, size)


def indicators(price: DataFrame, symbol: str, first=None, last=None, number: int = 1, size: int = 20) -> DataFrame:
    own = gold.with_volatility(gold.price_indicators(price.where(equals("ticker", symbol))))
    return page(filtered(own, **between("trading_date", first, last)), [F.desc("trading_date")], number, size)


def overview(table: DataFrame, day=None) -> DataFrame:
    return table.orderBy(F.desc("trading_date")).limit(1) if day is None else table.where(F.col("trading_date") == F.lit(day))


def board(table: DataFrame, symbol: str, first=None, last=None, n: int = 30) -> DataFrame:
    return filtered(table, s=equals("symbol", symbol), **between("trading_date", first, last)).orderBy(F.desc("trading_date")).limit(n)


def company(profile: DataFrame, directory: DataFrame, symbol: str) -> DataFrame:
    """The profile, or what the directory knows with nulls for the rest."""
    own = profile.where(equals("ticker", symbol))
    known = directory.where(equals("ticker", symbol)).select("ticker", "exchange", "organ_name").join(own, "ticker", "left_anti")
    return own.unionByName(known, allowMissingColumns=True)


def profile_with_flags(profile: DataFrame, directory: DataFrame) -> DataFrame:
    flags = directory.select("ticker", *(F.col(c) for c in ("has_price", "has_news", "has_docs")))
    return profile.join(flags, "ticker", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_price", "has_news", "has_docs")})


def financials(summary: DataFrame, symbol: str, period_type: str | None = None) -> DataFrame:
    return filtered(summary, s=equals("ticker", symbol), p=None if period_type is None else F.col("period_type") == period_type).orderBy(F.desc("period"))


def visible_financials(summary: DataFrame, items: list[str], symbol: str, n: int = 40) -> DataFrame:
    return financials(summary, symbol).where(F.coalesce(*(F.col(i) for i in items)).isNotNull()).orderBy(F.desc("period"), F.asc("period_type")).limit(n)


def search_tickers(directory: DataFrame, words: str, n: int = 12) -> DataFrame:
    w = words.lower()
    return directory.where(F.lower("ticker").contains(w) | F.lower(F.coalesce("organ_name", F.lit(""))).contains(w)).orderBy("ticker").limit(n)


#: Columns of articles and of documents that are searched.
ARTICLE_TEXTS = ("title", "summary", "body_text")
DOCUMENT_TEXTS = ("title",)


def articles(facts: DataFrame, symbol: str | None = None, search: str | None = None, sentiment: str | None = None, source: str | None = None, first=None, last=None, number: int = 1, size: int = 20) -> DataFrame:
    like = None
    for c in () if search is None else ARTICLE_TEXTS:
        like = F.col(c).ilike(f"%{search}%") if like is None else like | F.col(c).ilike(f"%{search}%")
    day = text.local_day()
    own = filtered(facts, s=equals("ticker", symbol), q=like, m=equals("sentiment_label", sentiment), r=equals("source", source), first=None if first is None else day >= F.lit(first).cast("date"), last=None if last is None else day <= F.lit(last).cast("date"))
    return page(own, [F.desc_nulls_last("published_at"), F.asc("article_id"), F.asc("ticker")], number, size)


def index_articles(facts: DataFrame, path: str) -> None:
    """Stores articles for :func:`articles_by_index`."""
    substring.write_index(facts, ARTICLE_TEXTS, path)


def _placed(rows: DataFrame) -> DataFrame:
    """Stored rows with their place in the index."""
    return rows.select(F.col("slot").alias("__slot"), F.col("row").alias("__row"), "own.*")


def index_news(news: DataFrame, path: str) -> None:
    """Stores news for :func:`news_by_index`: each text once, whatever its tickers.  Only keys are shuffled to say which row counts
    where several have one article and ticker; those that have a single row are not noted."""
    substring.write_index(news.where("published_date is not null and article_id is not null and trim(coalesce(title, '')) <> ''"), ARTICLE_TEXTS, path)
    codes = text.article_codes(_placed(substring.stored(news.sparkSession, path)))
    first = codes.groupBy("article_id", "ticker").agg(F.count("*").alias("n"), F.min(F.struct(*text.article_order(), "__slot", "__row")).alias("first"))
    first.where("n > 1").select("article_id", "ticker", F.col("first.__slot").alias("__first_slot"), F.col("first.__row").alias("__first_row")).write.parquet(f"{path}/repeated")


def news_by_index(spark: SparkSession, path: str, search: str, **conditions) -> DataFrame:
    """As :func:`articles` of a row for each article and ticker, from what :func:`index_news` stored: matching texts get their tickers when they are found."""
    codes = text.article_codes(_placed(substring.matches(spark, path, ARTICLE_TEXTS, search)))
    counts = F.col("__first_slot").isNull() | ((F.col("__slot") == F.col("__first_slot")) & (F.col("__row") == F.col("__first_row")))
    facts = codes.join(spark.read.parquet(f"{path}/repeated"), ["article_id", "ticker"], "left").where(counts)
    return articles(facts.select(*(c for c in codes.columns if c not in ("__slot", "__row"))), **conditions)


def articles_by_index(spark: SparkSession, path: str, search: str, **conditions) -> DataFrame:
    """As :func:`articles`, but the texts are looked up in a stored index of grams and only rows that it proposes are read."""
    return articles(substring.search(spark, path, ARTICLE_TEXTS, search), **conditions)


def documents(table: DataFrame, symbol: str | None = None, period: str | None = None, search: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    like = None if search is None else F.col("title").ilike(f"%{search}%")
    own = filtered(table, s=equals("ticker", symbol), p=equals("period_key", period), q=like)
    return page(own, [F.desc_nulls_last("published_at"), F.asc("doc_id")], number, size)


def index_documents(table: DataFrame, path: str) -> None:
    """Stores documents for :func:`documents_by_index`."""
    substring.write_index(table, DOCUMENT_TEXTS, path)


def documents_by_index(spark: SparkSession, path: str, search: str, **conditions) -> DataFrame:
    """As :func:`documents`, with titles looked up in a stored index of grams."""
    return documents(substring.search(spark, path, DOCUMENT_TEXTS, search), **conditions)


def sentiment_share(signal: DataFrame) -> DataFrame:
    share = lambda c: F.round((F.col(c) / F.when(F.col("news_count") > 0, F.col("news_count"))).cast("decimal(28,10)"), 6).cast("double")
    return signal.select("ticker", "trading_date", share("positive_count").alias("positive_share"), share("negative_count").alias("negative_share"), share("neutral_count").alias("neutral_share"))


def recent_days(price: DataFrame, symbol: str, days: int) -> DataFrame:
    """The last days counted from the symbol's newest row."""
    own = price.where(equals("ticker", symbol))
    return own.crossJoin(F.broadcast(own.agg(F.max("trading_date").alias("__newest")))).where(F.col("trading_date") >= F.date_sub("__newest", days)).drop("__newest")  # one row
