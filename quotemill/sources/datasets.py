"""Dataset specifications, and scans of partitioned folders."""

from __future__ import annotations

import re
import urllib.parse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    """Key, columns with types, and the order in which the last row of a key wins."""

    name: str
    key: list[str]
    columns: dict[str, str]
    order: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)


SPECS = {
    "price": DatasetSpec("price", ["ticker", "trading_date"], {"ticker": "string", "trading_date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "long"}, ["fetched_at"]),
    "index_price": DatasetSpec("index_price", ["index_code", "trading_date"], {"index_code": "string", "trading_date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "long"}, ["fetched_at"]),
    "listing": DatasetSpec("listing", ["symbol"], {}),
}


def conform(df: DataFrame, spec: DatasetSpec | None) -> DataFrame:
    """Exactly the declared columns, cast without failing; those missing are null."""
    if spec is None or not spec.columns:
        return df
    return df.select(*((df[c].try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in spec.columns.items()))


def scan(spark: SparkSession, root: str, **partition) -> DataFrame:
    """A partitioned folder with drifting columns; ``source_file`` names each row's file.  Keyword arguments are
    partition values."""
    df = spark.read.option("mergeSchema", True).parquet(root).select("*", F.col("_metadata.file_path").alias("source_file"))
    for name, value in partition.items():
        df = df.where(F.col(name) == value)
    return df


def partitions(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def stored_partitions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The partitions of a folder as text columns, from the names of its files; no file is opened."""
    files = spark.read.parquet(path).inputFiles()
    found = sorted({tuple(urllib.parse.unquote(re.search(rf"/{c}=([^/]*)/", f)[1]) for c in columns) for f in files})
    return spark.createDataFrame(found, ", ".join(f"{c} string" for c in columns))


def read_lists(spark: SparkSession, csv: str | None = None, json: str | None = None) -> list[DataFrame]:
    """Document lists: CSV with a header line, JSON with a row a line, all columns as text."""
    parts = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv)] if csv else []
    return parts + ([spark.read.option("primitivesAsString", True).json(json)] if json else [])


def since(df: DataFrame, column: str, mark) -> DataFrame:
    """Partitions beyond a watermark; all of them without one."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def months_since(df: DataFrame, mark, year: str = "year", month: str = "month") -> DataFrame:
    """Partitions of the watermark's month and later."""
    return df if mark is None else df.where(F.col(year) * 100 + F.col(month) >= mark.year * 100 + mark.month)


def latest(df: DataFrame, column: str) -> DataFrame:
    top = df.agg(F.max(column)).first()[0]
    return df.where(F.lit(False) if top is None else F.col(column) == F.lit(top))


def latest_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the n newest values of a partition column; the values are few and bounded by n."""
    tops = [r[0] for r in df.select(column).distinct().orderBy(F.desc(column)).limit(n).collect()]
    return df.where(F.col(column).isin(tops) if tops else F.lit(False))


def files(spark: SparkSession, path: str, glob: str = "*", least: int | None = None, since=None, until=None) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder whose names fit ``glob``; the source passes over empty files.

    The least length is a filter that the source applies before it reads a file's content; ``since`` and ``until`` (text, in the session's time
    zone) are bounds of the listing itself."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    for name, value in (("modifiedAfter", since), ("modifiedBefore", until)):
        reader = reader if value is None else reader.option(name, value)
    found = reader.load(path)
    return found if least is None else found.where(F.col("length") >= least)


#: Settings of a session in which counts and extremes of stored columns are taken from the files' footers.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A stored table whose ``count``, ``min`` and ``max`` without filters are answered from footers; it belongs to a session of its own, in which it
    must be collected.  Extremes of texts and times are not kept in footers in a form that Spark trusts: those are read."""
    own = spark.newSession()
    for k, v in FOOTERS.items():
        own.conf.set(k, v)
    return own.read.parquet(path)


def file_stats(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """rows, and for each column its least and greatest value and the number of values, of a stored table; no data page is read."""
    numbers = [f for c in columns for f in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count(c).alias(f"{c}_values"))]
    told = footers(spark, path).agg(F.count("*").alias("rows"), *numbers)
    return spark.createDataFrame(told.collect(), told.schema)  # one row
