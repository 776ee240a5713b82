"""Writers of partitioned folders, keyed tables in two versions, and the append-only audit log."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.keyed import upsert


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the session's checkpoint folder.  Where none is set, a session in one process
    gets a temporary one and any other is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Files of a folder of :func:`write_files`: folders are listed in parallel.
FOLDER_FILES = 2000


def write_files(rows: DataFrame, name: str, content: str, path: str, folder_files: int = FOLDER_FILES) -> int:
    """One file with the column ``content`` (null: empty) for each row, in numbered folders under ``path``; how many were written.

    Tasks write the files through Arrow, to any shared folder that it knows (``file:``, ``hdfs:``, ``s3:``), and give them their name (that of the column
    ``name``, behind the row's number, so that rows of one name do not meet) when they are whole; a task that is run again writes the same files."""
    number = F.monotonically_increasing_id().alias("number")
    cut = F.shiftright("number", 33).alias("part"), F.expr(f"(number & {(1 << 33) - 1}) div {folder_files}").alias("run")
    dealt = rows.select(number, F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.col(content).cast("binary").alias("content")).select("number", *cut, "name", "content")

    def save(batches):
        at, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in {f"{root}/{p}-{r}" for p, r in zip(batch["part"].to_pylist(), batch["run"].to_pylist(), strict=True)}:
                at.create_dir(folder)
            for row in batch.to_pylist():
                folder, own = f"{root}/{row['part']}-{row['run']}", f"{row['number']}-{row['name']}"
                held = f"{folder}/.{own}.{uuid.uuid4().hex}"  # hidden from readers
                with at.open_output_stream(held) as out:
                    out.write(row["content"] or b"")
                at.move(held, f"{folder}/{own}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    at, root = fs.FileSystem.from_uri(path)
    at.create_dir(root)  # there without any row, too
    tasks = rows.sparkSession.sparkContext.defaultParallelism  # the rows of many small files are few bytes, which would be one task
    return dealt.repartition(tasks, "part", "run").mapInArrow(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system and path objects, so that every store that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


# --- schemas that change: notes of every write lie in ``_schema`` below a table, which readers of the data pass over

_WHOLE = ["tinyint", "smallint", "int", "bigint"]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is none but text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return reconciled(a, b)
    x, y = a.simpleString(), b.simpleString()
    if x in _WHOLE and y in _WHOLE:
        return max(a, b, key=lambda t: _WHOLE.index(t.simpleString()))
    if all(t in (*_WHOLE, "float", "double") for t in (x, y)):
        return T.DoubleType()
    if all(t in _WHOLE or t.startswith("decimal") for t in (x, y)):
        a, b = (t if isinstance(t, T.DecimalType) else T.DecimalType(20, 0) for t in (a, b))
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(min(38, digits + scale), scale) if digits + scale <= 38 else T.DoubleType()
    if {x, y} == {"date", "timestamp"}:
        return T.TimestampType()
    return T.StringType()


def reconciled(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both, by name, each of the wider type; the old order, then new ones."""
    both = {f.name: f.dataType for f in new}
    fields = [T.StructField(f.name, wider(f.dataType, both[f.name]) if f.name in both else f.dataType) for f in old]
    return T.StructType([*fields, *(T.StructField(f.name, f.dataType) for f in new if f.name not in old.names)])


def reads_as(old: T.DataType, new: T.DataType) -> bool:
    """Whether stored values of the old type can be read as the new one, so that no file has to be written again."""
    if old == new:
        return True
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return all(f.name in new.names and reads_as(f.dataType, new[f.name].dataType) for f in old)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return reads_as(old.elementType, new.elementType)
    x, y = old.simpleString(), new.simpleString()
    return (x in _WHOLE and y in _WHOLE and _WHOLE.index(x) < _WHOLE.index(y)) or (y == "double" and x in ("float", "tinyint", "smallint", "int"))


def _loose(kind: T.StructType) -> T.StructType:
    """The same columns, all of which may be null, without metadata."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in kind])


def stored_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of all parts of a table: its notes reconciled, or where it has none, the files' schemas merged."""
    if not exists(spark, f"{path}/_schema"):
        return _loose(spark.read.option("mergeSchema", True).parquet(path).schema)
    notes = spark.read.schema("at timestamp, kind string").json(f"{path}/_schema").orderBy("at", "kind").collect()  # one row for each write that changed it
    return functools.reduce(reconciled, (T.StructType.fromJson(json.loads(n["kind"])) for n in notes))


def _note(spark: SparkSession, path: str, kind: T.StructType) -> None:
    kind = _loose(kind)
    if not exists(spark, f"{path}/_schema") or stored_schema(spark, path) != kind:
        spark.range(1).select(F.current_timestamp().alias("at"), F.lit(kind.json()).alias("kind")).write.mode("append").json(f"{path}/_schema")


def stored_table(spark: SparkSession, path: str) -> DataFrame:
    """All parts of a table with all columns that any part has; those of older parts are null or widened."""
    return spark.read.schema(stored_schema(spark, path)).parquet(path)


def _as(column: Column, old: T.DataType | None, new: T.DataType) -> Column:
    if old is None:
        return F.lit(None).cast(new)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        parts = (_as(column.getField(f.name), old[f.name].dataType if f.name in old.names else None, f.dataType).alias(f.name) for f in new)
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return F.transform(column, lambda x: _as(x, old.elementType, new.elementType))
    return column.cast(new)


def conformed(df: DataFrame, kind: T.StructType) -> DataFrame:
    """``df`` with exactly these columns."""
    old = {f.name: f.dataType for f in df.schema}
    return df.select(*(_as(F.col(f"`{f.name}`"), old.get(f.name), f.dataType).alias(f.name) for f in kind))


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Only the partitions that ``df`` holds are replaced; a value's rows are written together."""
    old = stored_schema(df.sparkSession, path) if exists(df.sparkSession, path) else None
    kind = _loose(df.schema) if old is None else reconciled(old, _loose(df.schema))
    if old is not None and not reads_as(old, kind):
        raise ValueError(f"parts of {path} cannot be read as {kind.simpleString()}; merge_partitions writes them again")
    conformed(df, kind).repartition(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    _note(df.sparkSession, path, kind)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a merge that a crash broke off: what was staged whole and noted is put in place, again if need be."""
    if exists(spark, f"{path}/_pending"):
        for note in spark.read.schema("stage string, columns array<string>").json(f"{path}/_pending").collect():  # one row, or two after a crash
            if exists(spark, note["stage"]):
                _put(spark, note["stage"], path, note["columns"])
        remove(spark, f"{path}/_pending")


def _put(spark: SparkSession, stage: str, path: str, columns: list[str]) -> None:
    staged = spark.read.parquet(stage)
    staged.repartition(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    _note(spark, path, staged.schema)
    remove(spark, stage)


def merge_partitions(df: DataFrame, path: str, keys: list[str], *columns: str) -> None:
    """Upsert into the partitions that ``df`` touches.

    Columns that either side lacks are null there, never lost, and types widen to hold both.  Only the touched partitions are written
    again, unless a type changes so that older files cannot be read as the new one: then all are.  The merged rows are staged and noted
    before they replace anything, so a merge that breaks off is finished by the next one (:func:`recover`)."""
    spark = df.sparkSession
    recover(spark, path)
    old = stored_schema(spark, path)
    kind = reconciled(old, _loose(df.schema))
    stored = spark.read.schema(old).parquet(path)
    if reads_as(old, kind):
        stored = stored.join(df.select(*columns).distinct(), list(columns), "left_semi")
    merged = upsert(conformed(stored, kind), conformed(df, kind), keys)
    stage = scratch(spark, "stage")
    merged.write.parquet(stage)
    spark.range(1).select(F.lit(stage).alias("stage"), F.array(*map(F.lit, columns)).alias("columns")).write.mode("append").json(f"{path}/_pending")
    recover(spark, path)


def advance_watermark(spark: SparkSession, path: str, dataset: str, mark) -> None:
    """Note a watermark; lines are only added, so that it never moves back and a crash loses nothing."""
    append(spark.range(1).select(F.lit(dataset).alias("dataset"), F.lit(mark).alias("mark")), path)


def watermarks(spark: SparkSession, path: str) -> DataFrame:
    """dataset and its greatest mark."""
    return spark.read.parquet(path).groupBy("dataset").agg(F.max("mark").alias("mark"))


def audited(df: DataFrame, log: str, dataset: str, run: str, write: Callable[[DataFrame], None]) -> None:
    """Write and append one audit row: counts from the write itself, status and error; errors are raised after that."""
    spark, seen, error = df.sparkSession, Observation(), None
    try:
        write(df.observe(seen, F.count("*").alias("rows_out")))
    except Exception as e:
        error = e
    rows = None if error else seen.get["rows_out"]
    line = spark.range(1).select(F.lit(run).alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(rows).cast("long").alias("rows_out"), F.lit("failed" if error else "success").alias("status"), F.lit(str(error)[:500] if error else None).cast("string").alias("error"), F.current_timestamp().alias("finished_at"))
    line.write.mode("append").json(log)
    if error:
        raise error
