"""Data-quality checks; each is one aggregation, or an anti-join, over its table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def null_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """check (column), failures."""
    one = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names))
    return one.unpivot([], names, "check", "failures")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicates_of_known(df: DataFrame, column: str) -> DataFrame:
    return duplicate_keys(df.where(F.col(column).isNotNull()), [column])


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct values without a parent."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def key_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, null_keys, duplicate_rows of a key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(nulls, F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"), F.coalesce(F.sum(F.when(~nulls & (F.col("n") > 1), F.col("n")).otherwise(0)), F.lit(0)).alias("duplicate_rows"))


def demand_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if its key is complete and unique; else an error."""
    r = key_quality(df, keys).first()
    if r["null_keys"] or r["duplicate_rows"]:
        raise ValueError(f"key {keys}: {r['null_keys']} null, {r['duplicate_rows']} duplicate rows")
    return df


# --- all checks of a table in one scan


@dataclass(frozen=True)
class Rule:
    """A check of a table: ``columns`` are never null, are ``unique`` together, or have a ``parent``; or ``holds`` is true of every row.

    Unique keys and references that hold a null are left alone unless ``nulls`` says that they count."""

    name: str
    columns: tuple[str, ...] = ()
    kind: str = "not_null"
    holds: Column | None = None
    parent: DataFrame | None = None
    parent_columns: tuple[str, ...] = ()
    nulls: bool = False


def not_null(*columns: str) -> Rule:
    return Rule(f"not_null: {', '.join(columns)}", columns)


def unique(*columns: str, nulls: bool = False) -> Rule:
    return Rule(f"unique: {', '.join(columns)}", columns, "unique", nulls=nulls)


def refers(columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...] | None = None, name: str = "parent") -> Rule:
    return Rule(f"refers: {', '.join(columns)} to {name}", columns, "refers", parent=parent, parent_columns=parent_columns or columns)


def holds(name: str, condition: Column) -> Rule:
    """Rows where the condition is false fail; where it is null they do not."""
    return Rule(name, (), "holds", holds=condition)


def _key(columns: tuple[str, ...]) -> Column:
    """The values as one text; nulls are left out of it, so different nulls make different keys."""
    return F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))))


def _any_null(columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def checked(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, rows (that it looked at), failures (rows), keys (different failing keys; null for rules on single rows).

    The table is scanned once.  A row gives an entry for each rule, with the rule's number and, for rules on keys, the key; one aggregation by
    number and key serves them all, in which rules on single rows shrink to one entry a task.  Parents join it as entries of their own."""
    entries = []
    for i, r in enumerate(rules):
        if r.kind in ("not_null", "holds"):
            bad = _any_null(r.columns) if r.kind == "not_null" else F.coalesce(~r.holds, F.lit(False))
            entries.append(F.struct(F.lit(i).alias("rule"), F.lit(None).cast("string").alias("key"), bad.cast("long").alias("bad"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("parent")))
        else:
            one = F.struct(F.lit(i).alias("rule"), _key(r.columns).alias("key"), F.lit(0).cast("long").alias("bad"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("parent"))
            entries.append(one if r.nulls else F.when(~_any_null(r.columns), one))
    each = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
    for i, r in enumerate(rules):
        if r.kind == "refers":
            of = r.parent.where(~_any_null(r.parent_columns)).select(F.lit(i).alias("rule"), _key(r.parent_columns).alias("key"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("parent"))
            each = each.unionByName(of)
    by_key = each.groupBy("rule", "key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.max("parent").alias("parent"))
    of_kind = lambda *kinds: F.col("rule").isin(*[i for i, r in enumerate(rules) if r.kind in kinds])
    bad_key = (of_kind("unique") & (F.col("n") > 1)) | (of_kind("refers") & (F.col("parent") == 0))
    failures = F.when(of_kind("not_null", "holds"), F.col("bad")).when(bad_key, F.col("n")).otherwise(0)
    out = by_key.groupBy("rule").agg(F.sum("n").alias("rows"), F.sum(failures).alias("failures"), F.sum(F.when(of_kind("unique", "refers"), bad_key.cast("long"))).alias("keys"))
    names = df.sparkSession.createDataFrame([(i, r.name, r.kind in ("unique", "refers")) for i, r in enumerate(rules)], "i int, name string, keyed boolean")
    full = names.join(out, names["i"] == out["rule"], "left")
    return full.select(F.col("name").alias("rule"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "failures")), F.when(F.col("keyed"), F.coalesce("keys", F.lit(0))).alias("keys"))
