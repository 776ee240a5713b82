"""Stored folders, watermarks, streams that stop and go on, and mentions in their contexts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.plans import gold, text
from quotemill.sources import datasets, sinks
from quotemill.streaming import jobs


def test_partitions_are_pruned_and_listed(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(48).select("id", (F.lit(2020) + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    sinks.overwrite_partitions(df, path, "year", "month")
    picked = datasets.months_since(spark.read.parquet(path), dt.date(2021, 6, 3))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") + 19 :].split("]")[0]
    assert "year" in filters and "month" in filters
    assert {(r["year"], r["month"]) for r in picked.select("year", "month").distinct().collect()} == {(2021, 6), (2021, 8), (2021, 10), (2021, 12)}
    listed = {(int(r["year"]), int(r["month"])) for r in datasets.stored_partitions(spark, path, "year", "month").collect()}
    assert listed == {(2020 + i % 2, i % 12 + 1) for i in range(48)}


def test_merge_touches_its_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(i, i % 4, "old") for i in range(40)], "k int, part int, v string")
    sinks.overwrite_partitions(rows, path, "part")
    before = {f for f in spark.read.parquet(path).inputFiles() if "part=3" in f}
    sinks.merge_partitions(spark.createDataFrame([(0, 0, "new"), (100, 1, "new")], "k int, part int, v string"), path, ["k"], "part")
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 41 and got[0] == got[100] == "new" and got[4] == "old"
    assert before <= set(spark.read.parquet(path).inputFiles())


def test_watermarks_do_not_move_back(spark, tmp_path):
    path = str(tmp_path / "w")
    for day in (5, 9, 2):
        sinks.advance_watermark(spark, path, "a", dt.date(2024, 1, day))
    assert sinks.watermarks(spark, path).first()["mark"] == dt.date(2024, 1, 9)


def test_streams_go_on_after_a_stop(spark, tmp_path):
    source, root = str(tmp_path / "s"), str(tmp_path / "t")
    add = lambda rows: spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema("k int, at int, v string").parquet(source)
    add([(1, 1, "a"), (2, 1, "a")])
    jobs.run_into(read(), jobs.KeyedTable(spark, ["k"], ["at"], root))
    add([(1, 2, "b"), (3, 1, "b")])
    table = jobs.KeyedTable(spark, ["k"], ["at"], root)  # a new session knows the folder alone
    jobs.run_into(read(), table)
    wanted = {(1, "b"), (2, "a"), (3, "b")}
    assert {(r["k"], r["v"]) for r in table.read().collect()} == wanted
    table.take(spark.createDataFrame([(1, 2, "b"), (3, 1, "b")], "k int, at int, v string"), 1)  # a batch played again
    table.take(spark.createDataFrame([(1, 1, "late")], "k int, at int, v string"), 2)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == wanted
    out = str(tmp_path / "d")
    assert jobs.drained(read(), root=out).count() == 4
    add([(9, 9, "z")])
    assert jobs.drained(read(), root=out).count() == 5


@pytest.mark.parametrize("title,wanted", [
    ("5 ty VND hom nay", None), ("USD DO LA", None), ("Gia VND / USD", None), ("trieu USD", None), ("(HOSE: VND) tang", ["VND"]), ("TPHCM dong dao", None), ("ma CK: TOP", ["TOP"]), ("Cổ phiếu FPT tăng", ["FPT"]), ("Co\u0302\u0309 phie\u0302\u0301u FPT", ["FPT"]),
    ("line\nFPTX end", ["FPTX"]), ("nan", None), ("straße FPTX", ["FPTX"]),
])
def test_mentions_in_context(spark, title, wanted):
    news = spark.createDataFrame([(1, title, "", None)], "article_id long, title string, summary string, body_text string")
    codes = spark.createDataFrame([(c,) for c in ("VND", "USD", "HCM", "TOP", "FPT", "FPTX", None)], "code string")
    for most in (100, 2):
        r = text.ranked_mentions(text.mention_scores(text.mention_candidates(news, codes, most=most))).first()
        assert (r and r["mentions"]) == wanted


def test_annual_rows_of_both_kinds(spark):
    ratio = spark.createDataFrame([("A", "trailing_eps", "2023-Q3", "quarter", 2023, 3, 1.0), ("A", "trailing_eps", "2023-Q4", "quarter", 2023, 4, 2.0), ("A", "trailing_eps", "2023", "annual", 2023, None, 7.0)], "ticker string, item_code string, period string, period_type string, year int, quarter int, value double")
    got = gold.financial_summary(ratio)
    assert sorted((r["period"], r["period_type"], r["eps"]) for r in got.collect()) == [("2023", "annual", 2.0), ("2023", "annual", 7.0), ("2023-Q3", "quarter", 1.0), ("2023-Q4", "quarter", 2.0)]
    assert len(got.columns) == 5 + len(gold.SUMMARY_ITEMS) and got.where("dividend_per_share is not null").count() == 0


def test_a_stream_replaces_the_partitions_it_touches(spark, tmp_path):
    table = jobs.KeyedTable(spark, ["k"], ["at"], str(tmp_path / "t"), part=F.col("k") % 4)
    rows = lambda *r: spark.createDataFrame(r, "k int, at int")
    table.take(rows(*((i, 1) for i in range(16))), 0)
    files = lambda: {f for f in table.read().inputFiles()}
    was = files()
    table.take(rows((2, 5), (2, 4), (18, 1)).withColumn("more", F.lit("x")), 1)
    assert {r["k"]: (r["at"], r["more"]) for r in table.read().collect()} == {i: (1, None) for i in range(16)} | {2: (5, "x"), 18: (1, "x")}
    kept = {f for f in was if "part=2" not in f}
    assert kept <= files() and not {f for f in was if "part=2" in f} & files()


def test_rows_dropped_by_a_watermark_are_counted(spark, tmp_path):
    source, notes = str(tmp_path / "s"), str(tmp_path / "p")
    schema = "id int, at timestamp, file int"
    files = [[(1, 10), (2, 20)], [(3, 5), (4, 11)], [(5, 1), (6, 17), (7, 18), (8, 19)], [(9, 2), (9, 30)], [(10, 25)]]
    rows = [(i, dt.datetime(2024, 1, day), k) for k, f in enumerate(files) for i, day in f]
    for k in range(len(files)):
        spark.createDataFrame([r for r in rows if r[2] == k], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with jobs.audited(spark, notes):
        out = jobs.drained(stream.withWatermark("at", "2 days").dropDuplicatesWithinWatermark(["id"]))
    got = {r["batch"]: (r["rows_in"], r["dropped"]) for r in spark.read.parquet(notes).where("rows_in > 0").collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (4, 3), 3: (2, 1), 4: (1, 0)}
    assert got == {r["batch"]: (r["rows_in"], r["dropped"]) for r in jobs.late_by_batch(spark.createDataFrame(rows, schema), "file", "at", "2 days").collect()}
    assert out.count() == sum(a - b for a, b in got.values())
