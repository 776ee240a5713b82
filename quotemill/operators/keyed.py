"""Keyed tables: ranked deduplication, upsert, incremental slices, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed once a row.  A plain column is planned again wherever it is named, and filters on it
    move down to the scan; an explosion of one value stays where it is."""
    return df.withColumn(name, F.explode(F.array(value)))


def ranked_dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same key; columns that one side lacks are null there.  A key with a null equals no other, and rows of
    ``new`` that share a key all stay: rank them first."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """inserted, updated."""
    known = existing.select(*keys, F.lit(True).alias("__had")).distinct()
    return new.join(known, keys, "left").agg(F.count_if(F.col("__had").isNull()).alias("inserted"), F.count_if(F.col("__had").isNotNull()).alias("updated"))


def replace_keys(target: DataFrame, slice_: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the slice's keys from the target, then insert the slice."""
    return target.join(slice_.select(*keys).distinct(), keys, "left_anti").unionByName(slice_, allowMissingColumns=True)


def newest(df: DataFrame, column: str):
    """The greatest value, fetched once so that it is a literal in plans (and prunes partitions)."""
    return df.agg(F.max(column)).first()[0]


def after_max(source: DataFrame, target: DataFrame, column: str, start: str = "1900-01-01") -> DataFrame:
    """Rows beyond the newest of the target."""
    top = newest(target, column)
    return source.where(F.col(column) > (F.lit(start).cast("date") if top is None else F.lit(top)))


def late_rows(source: DataFrame, target: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows at or below the target's newest value that the target lacks: :func:`after_max` would lose them."""
    top = newest(target, column)
    return source.where(F.lit(False) if top is None else F.col(column) <= F.lit(top)).join(target.select(*keys), keys, "left_anti")


def lookback(source: DataFrame, done: DataFrame, key: str, day: str, days: int) -> tuple[DataFrame, object]:
    """The slice that windows over new rows need: keys with rows beyond the newest day, from ``days`` before it on; and that day."""
    top = newest(done, day)
    if top is None:
        return source, None
    fresh = source.where(F.col(day) > F.lit(top)).select(key).distinct()
    return source.where(F.col(day) >= F.date_sub(F.lit(top), days)).join(fresh, key, "left_semi"), top


def watermark(*maxima):
    """The greatest of several watermarks, null where all are."""
    have = [m for m in maxima if m is not None]
    return max(have) if have else None


def plan_loads(universe: DataFrame, loaded: DataFrame, key: str, day: str, as_of, days: int = 30, start: str = "2000-01-01", mark=None) -> DataFrame:
    """Per key the next span to load: all of it where nothing is there, else from the day after the newest (not before the
    watermark); spans that would be empty are left out."""
    have = loaded.groupBy(key).agg(F.max(day).alias("newest"))
    plan = universe.join(have, key, "left")
    begin = F.when(F.col("newest").isNull(), F.lit(start).cast("date")).otherwise(F.date_add("newest", 1))
    if mark is not None:
        begin = F.when(F.col("newest").isNull(), F.lit(start).cast("date")).otherwise(F.greatest(begin, F.lit(mark).cast("date")))
    mode = F.when(F.col("newest").isNull(), "bootstrap").when(F.datediff(F.lit(as_of).cast("date"), "newest") <= days, "window").otherwise("since")
    return plan.select(key, "newest", begin.alias("load_from"), F.lit(as_of).cast("date").alias("load_to"), mode.alias("mode")).where("load_from <= load_to")


def split_at_years(plan: DataFrame, start: str, end: str, longest: int = 366) -> DataFrame:
    """Spans of over ``longest`` days cut at the ends of calendar years."""
    years = F.sequence(F.year(start), F.year(end))
    parts = F.when(F.datediff(end, start) > longest, years).otherwise(F.array(F.year(start)))
    out = plan.withColumn("__year", F.explode(parts))
    long_ = F.datediff(F.col(end), F.col(start)) > longest
    a = F.when(long_, F.greatest(F.col(start), F.make_date("__year", F.lit(1), F.lit(1)))).otherwise(F.col(start))
    b = F.when(long_, F.least(F.col(end), F.make_date("__year", F.lit(12), F.lit(31)))).otherwise(F.col(end))
    return out.withColumns({"part_from": a, "part_to": b}).drop("__year")
