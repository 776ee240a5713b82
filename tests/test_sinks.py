"""Tables whose schema changes, and merges that break off."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.sources import sinks


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def content(spark, path, *columns):
    return {r["k"]: tuple(r[c] for c in columns) for r in sinks.stored_table(spark, path).collect()}


def test_a_new_column_keeps_its_values(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(frame(spark, [(i, i % 4, "old") for i in range(8)], "k int, part int, v string"), path, "part")
    sinks.merge_partitions(frame(spark, [(0, 0, "new", 7), (1, 1, "new", 8)], "k int, part int, v string, w int"), path, ["k"], "part")
    sinks.merge_partitions(frame(spark, [(4, 0, "newest")], "k int, part int, v string"), path, ["k"], "part")
    got = content(spark, path, "v", "w")
    assert got == {0: ("new", 7), 1: ("new", 8), 4: ("newest", None)} | {i: ("old", None) for i in (2, 3, 5, 6, 7)}
    # a whole partition in the old form keeps the column too
    sinks.overwrite_partitions(frame(spark, [(2, 2, "again")], "k int, part int, v string"), path, "part")
    assert content(spark, path, "w")[1] == (8,) and 6 not in content(spark, path, "w")


def test_types_widen(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(frame(spark, [(i, i % 3, i, 1.5, i) for i in range(6)], "k int, part int, a int, b float, c long"), path, "part")
    files = lambda part: {f for f in sinks.stored_table(spark, path).inputFiles() if f"part={part}" in f}
    was = files(2)
    sinks.merge_partitions(frame(spark, [(0, 0, 2**40, 0.1, 5)], "k int, part int, a long, b double, c long"), path, ["k"], "part")
    assert content(spark, path, "a", "b", "c") == {0: (2**40, 0.1, 5)} | {i: (i, 1.5, i) for i in range(1, 6)} and files(2) == was
    # whole numbers of eight bytes cannot be read as fractions: all parts are written again
    sinks.merge_partitions(frame(spark, [(1, 1, 1, 1.0, 2.5)], "k int, part int, a long, b double, c double"), path, ["k"], "part")
    assert content(spark, path, "c") == {0: (5.0,), 1: (2.5,), 2: (2.0,), 3: (3.0,), 4: (4.0,), 5: (5.0,)} and not files(2) & was
    sinks.merge_partitions(frame(spark, [(9, 1, "x")], "k int, part int, c string"), path, ["k"], "part")
    assert content(spark, path, "c")[1] == ("2.5",) and content(spark, path, "a", "c")[9] == (None, "x")
    with pytest.raises(ValueError):
        sinks.overwrite_partitions(frame(spark, [(1, 1, "text")], "k int, part int, b string"), path, "part")


def test_nested_columns_and_tables_without_notes(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, [(1, 0, (1,)), (2, 1, (2,))], "k int, part int, s struct<x: int>").write.partitionBy("part").parquet(path)
    sinks.merge_partitions(frame(spark, [(2, 1, (3, "y"))], "k int, part int, s struct<x: int, y: string>"), path, ["k"], "part")
    assert content(spark, path, "s") == {1: ((1, None),), 2: ((3, "y"),)}


@pytest.mark.parametrize("a, b, c", [("int", "double", "double"), ("bigint", "float", "double"), ("decimal(10,2)", "int", "decimal(22,2)"), ("decimal(38,0)", "decimal(10,9)", "double"), ("date", "timestamp", "timestamp"), ("boolean", "int", "string"), ("void", "int", "int"), ("array<int>", "array<bigint>", "array<bigint>")])
def test_wider(a, b, c):
    a, b = (T.NullType() if x == "void" else T._parse_datatype_string(x) for x in (a, b))
    assert sinks.wider(a, b).simpleString() == c == sinks.wider(b, a).simpleString()


def test_a_merge_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(frame(spark, [(i, i % 2, "old") for i in range(6)], "k int, part int, v string"), path, "part")
    put = sinks._put

    def dies(*args):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(sinks, "_put", dies)
    with pytest.raises(RuntimeError):
        sinks.merge_partitions(frame(spark, [(0, 0, "new"), (1, 1, "new")], "k int, part int, v string"), path, ["k"], "part")
    assert set(content(spark, path, "v").values()) == {("old",)}
    stages = []
    monkeypatch.setattr(sinks, "_put", lambda spark, stage, *a: (stages.append(stage), put(spark, stage, *a)))
    sinks.merge_partitions(frame(spark, [(2, 0, "newer")], "k int, part int, v string"), path, ["k"], "part")
    assert content(spark, path, "v") == {0: ("new",), 1: ("new",), 2: ("newer",), 3: ("old",), 4: ("old",), 5: ("old",)}
    assert len(stages) == 2 and not any(sinks.exists(spark, s) for s in stages) and not sinks.exists(spark, f"{path}/_pending")
    sinks.recover(spark, path)
    assert spark.read.parquet(path).where(F.col("v") == "newer").count() == 1
