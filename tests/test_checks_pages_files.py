"""Checks of a table in one scan, pages by key and by number, binary files."""

import datetime as dt
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotemill.operators import quality
from quotemill.plans import serve, text
from quotemill.sources import datasets, sinks
from quotemill.sources.proxy import Tables


def test_ten_rules_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", 5, "x"), (1, "a", None, "x"), (2, None, 7, "y"), (None, "a", 7, "z"), (3, "b", -1, None), (None, "a", 7, "z"), (4, "b", -1, "w")]
    spark.createDataFrame(rows, "id int, g string, n int, p string").write.parquet(path)
    df, parent = spark.read.parquet(path), spark.createDataFrame([("x",), ("z",), (None,), ("x",)], "code string")
    rules = [
        quality.not_null("id"), quality.not_null("id", "g"), quality.not_null("n"), quality.holds("positive", F.col("n") > 0), quality.holds("always", F.lit(True)), quality.unique("id"), quality.unique("id", "g"),
        quality.unique("id", "g", nulls=True), quality.unique("n"), quality.refers(("p",), parent, ("code",), "codes"),
    ]
    out = quality.checked(df, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) == 1 and "Join" in plan
    got = [tuple(r) for r in out.orderBy(F.col("rule")).collect()]
    assert sorted(got, key=repr) == sorted([
        ("not_null: id", 7, 2, None), ("not_null: id, g", 7, 3, None), ("not_null: n", 7, 1, None), ("positive", 7, 2, None), ("always", 7, 0, None), ("unique: id", 5, 2, 1), ("unique: id, g", 4, 2, 1),
        ("unique: id, g", 7, 4, 2), ("unique: n", 6, 5, 2), ("refers: p to codes", 6, 2, 2),
    ], key=repr)
    assert {tuple(r)[1:3] for r in quality.checked(df.limit(0), rules).collect()} == {(0, 0)}


def ordered(rows, order):
    for k, down in reversed(order):
        rows = sorted([r for r in rows if r[k] is not None], key=lambda r: r[k], reverse=down) + [r for r in rows if r[k] is None]
    return rows


@pytest.mark.parametrize("down", [True, False])
def test_pages_follow_each_other(spark, down):
    rows = [(None if i % 6 == 0 else i % 5, None if i % 7 == 0 else f"v{i % 3}", i) for i in range(73)]
    df = spark.createDataFrame(rows, "a int, b string, id int")
    names = [("a", down), ("b", not down), ("id", down)]
    wanted = ordered(rows, [(0, down), (1, not down), (2, down)])
    got, last = [], None
    while page := serve.page_after(df, names, last, 10).collect():
        got += map(tuple, page)
        last = list(page[-1])
    assert got == wanted
    for number in (1, 2, 5, 8, 9):
        for ranges in (2, 7, 1000):
            assert [tuple(r) for r in serve.numbered_page(df, names, number, 10, ranges).collect()] == wanted[(number - 1) * 10 : number * 10]
    assert serve.numbered_page(df.limit(0), names, 1, 10).count() == 0
    plan = serve.page_after(df, names, [3, "v1", 8], 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_a_deep_page_sorts_its_ranges_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).withColumn("at", F.col("id") * 3).write.parquet(path)
    page = serve.numbered_page(spark.read.parquet(path), [("at", True)], 900, 20, 100)
    assert [r["id"] for r in page.collect()] == [20_000 - 899 * 20 - 1 - i for i in range(20)]
    sorted_rows = page._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in sorted_rows


def test_files_are_read_and_judged(spark, tmp_path):
    body = b"%PDF-1.4\n" + b"\x00\xff" * 100
    made = {"a.pdf": body + b"%%EOF", "b.pdf": body, "c.pdf": b"<html>" + body + b"%%EOF", "d.pdf": b"%PDF-%%EOF", "sub/e.pdf": body * 50 + b"%%EOF" + b" " * 900, "f.pdf": body + b"%%EOF" + b" " * 2000, "g.txt": b"x", "h.pdf": b""}
    (tmp_path / "sub").mkdir()
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    os.utime(tmp_path / "a.pdf", (1, 1))
    ok = lambda df: {os.path.basename(r["path"]): r["ok"] for r in text.checked_files(df).collect()}
    assert ok(datasets.files(spark, str(tmp_path), "*.pdf")) == {"a.pdf": True, "b.pdf": False, "c.pdf": False, "d.pdf": False, "e.pdf": True, "f.pdf": False}
    large = datasets.files(spark, str(tmp_path), "*.pdf", least=100)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert set(ok(large)) == {"a.pdf", "b.pdf", "c.pdf", "e.pdf", "f.pdf"} and "GreaterThanOrEqual(length,100)" in plan
    day = dt.datetime(2020, 1, 1).isoformat()
    assert set(ok(datasets.files(spark, str(tmp_path), "*.pdf", since=day))) == set(made) - {"a.pdf", "g.txt", "h.pdf"} - {"sub/e.pdf"} | {"e.pdf"}
    assert set(ok(datasets.files(spark, str(tmp_path), "*.pdf", until=day))) == {"a.pdf"}


def test_counts_and_extremes_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), (F.col("id") / 7).alias("x")).repartition(5).write.parquet(path)
    plan = datasets.footers(spark, path).agg(F.count("*"), F.min("k"), F.max("x"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(k), MAX(x)]" in plan
    assert tuple(datasets.file_stats(spark, path, "k", "x").first()) == (1000, 1, 999, 900, 0.0, 999 / 7, 1000)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_many_keywords_in_one_pass(spark):
    weights = {"ab": 1, "abc": 10, "b": 100, "c+": 1000, "đ ă": 10_000}
    texts = ["", None, "abcab", "c+c+ c", "đ ăb", "aabbcc", "xyz" * 10, "abc+"]
    count = lambda t, w: sum(t.startswith(w, i) for i in range(len(t)))
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["s"] for r in d.select("i", text.keyword_score(F.col("t"), weights).alias("s")).orderBy("i").collect()]
    assert got == [None if t is None else sum(v * count(t, w) for w, v in weights.items()) for t in texts]
    low = "giá tăng, lợi nhuận sụt giảm, thua lỗ; lãi tăng vượt kỷ lục"
    assert spark.range(1).select(text.sentiment(F.lit(low.upper()))).first()[0] == sum(low.count(w) for w in text.POSITIVE) - sum(low.count(w) for w in text.NEGATIVE)


def test_written_files(spark, tmp_path):
    """A file for each row, of the same name or none, empty ones too, in folders of a bound; none hidden is left."""
    rows = [(f"n{i % 3}.txt", None if i == 5 else f"row {i}") for i in range(20)] + [(None, "no name")]
    df = spark.createDataFrame(rows, "name string, content string").coalesce(1)
    assert sinks.write_files(df, "name", "content", f"file:{tmp_path}/a", folder_files=4) == 21
    found = [(d, f) for d, _, fs in os.walk(tmp_path / "a") for f in fs]
    assert len(found) == 21 and not any(f.startswith(".") for _, f in found) and max(Counter(d for d, _ in found).values()) == 4
    assert sorted(bytes(r["content"]).decode() for r in datasets.files(spark, f"file:{tmp_path}/a").collect()) == sorted(c for _, c in rows if c)
    assert sinks.write_files(df.limit(0), "name", "content", f"file:{tmp_path}/b") == 0 and datasets.files(spark, f"file:{tmp_path}/b").count() == 0


def test_file_scan_of_repeated_keys(spark, tmp_path):
    """Two suppliers of one key are two files, as they are two rows of the SQL."""
    from quotemill.plans.text_queries import pdf_file_scan

    name = "Supplier of a name that is long enough to be read as a file of its own"
    spark.createDataFrame([(4, name, 1), (4, name + "s", 2), (8, name, 3)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert [r["s_suppkey"] for r in pdf_file_scan(Tables(spark, str(tmp_path))).orderBy("s_suppkey").collect()] == [4, 4, 8]
