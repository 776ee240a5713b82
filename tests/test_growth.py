"""Results beyond the small tables: values that grow with the keys, and steps whose memory must not grow with the table."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.rules import nfc, rounded
from quotemill.operators.batches import MOST_BYTES, small
from quotemill.plans import text
from quotemill.plans.pages import with_elements


def _facts(spark):
    """Two articles of the day, one of years later (weight about 4e18) and one of a century later (no double holds it)."""
    rows = [("a", "1995-02-28 12:00:00"), ("b", "1995-02-27 12:00:00"), ("c", "1995-05-27 00:00:00"), ("d", "2095-02-28 12:00:00")]
    d = spark.createDataFrame(rows, "article_id string, at string")
    return d.select("article_id", F.lit("S1").alias("ticker"), F.to_timestamp("at").alias("published_at"), F.lit("1995-03-01").cast("date").alias("published_date"), F.lit("t").alias("title"), F.lit("u").alias("url"),
                    F.lit("title").alias("ticker_relevance"), F.lit(3).alias("source_tier"), F.lit(1).alias("sentiment_score"), F.lit("positive").alias("sentiment_label"))


def test_weights_beyond_the_decimal(spark):
    w = text.weighted_articles(_facts(spark), "1995-03-01 00:00:00").select("article_id", "article_weight", rounded("article_weight", 6).alias("r"))
    got = {r["article_id"]: (r["article_weight"], r["r"]) for r in w.collect()}
    assert got["a"][1] == round(got["a"][0], 6) and got["b"][1] == round(got["b"][0], 6)
    assert got["c"][1] == got["c"][0] > 1e18 and got["d"][1] == float("inf")
    assert spark.sql("select double('nan') as x").select(rounded("x", 4).alias("x")).first()["x"] is None


def test_articles_of_a_signal_beyond_the_decimal(spark):
    lists = text.news_signal(text.weighted_articles(_facts(spark).where("article_id <> 'd'"), "1995-03-01 00:00:00").withColumn("trading_date", F.col("published_date")))
    got = lists.select(F.from_json("top_articles", "array<struct<article_id: string, weight: double>>").alias("a")).first()["a"]
    assert [x["article_id"] for x in got] == ["c", "a", "b"]
    assert got[0]["weight"] > 1e18 > 3 > got[1]["weight"] > got[2]["weight"]


class _Batches:
    """Stands in for a DataFrame: keeps the function of a task."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema, self.columns = spark, schema, schema.fieldNames()

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_elements_leave_a_task_in_small_batches(spark):
    pages = _Batches(spark, T.StructType.fromDDL("page_id bigint, html string"))
    with_elements(pages)
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(300)), "html": [f"<p>{i}" + " word" * 2000 for i in range(299)] + [None]})
    out = list(pages.run(iter([batch])))
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(300)) and len(out) >= 3
    assert all(pc.sum(pc.binary_length(b.column("html"))).as_py() <= MOST_BYTES for b in out)


def test_mentions_leave_a_task_in_small_batches(spark):
    news = _Batches(spark, T.StructType.fromDDL("article_id string, title string, summary string, body_text string"))
    text.mention_candidates(news, spark.createDataFrame([("ABC",)], "code string"))
    many = lambda x: [x] * 300
    batch = pa.RecordBatch.from_pydict({"article_id": [str(i) for i in range(300)], "title": many("ABC"), "summary": many(None), "body_text": many("ABC" + " word" * 2000)}, pa.schema([(c, pa.string()) for c in news.columns]))
    out = list(news.run(iter([batch])))
    found = [(a, p) for b in out for a, p in zip(b.column("article_id").to_pylist(), b.column("part").to_pylist(), strict=True)]
    assert len(out) >= 3 and sorted(found) == sorted((str(i), p) for i in range(300) for p in (0, 2))


def test_one_long_row_is_a_batch_of_its_own():
    batch = pa.RecordBatch.from_pydict({"x": ["a", "b" * 50, None, "c", "d"]})
    assert [b.column("x").to_pylist() for b in small(iter([batch, batch.slice(0, 0)]), ("x",), 10)] == [["a"], ["b" * 50], [None, "c", "d"]]


def test_plain_text_never_reaches_the_normalisation(spark):
    d = spark.createDataFrame([("plain",), ("e\u0301",), (None,), ("",)], "x string").select("x", nfc("x").alias("y"))
    assert [r["y"] for r in d.collect()] == ["plain", "\u00e9", None, ""]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan[plan.index("ArrowEvalPython") :]


def test_year_of_an_attachment_in_any_century(spark):
    listing = spark.createDataFrame([(1, "2120-05-01"), (2, "2015-05-01")], "k int, d string").select("k", F.lit("S1").alias("ticker"), F.lit("BCTC").alias("title"), F.to_timestamp("d").alias("published_at"))
    pages = listing.select("k", F.lit("<a href='/a.pdf'>BCTC</a>").alias("html"))
    year = lambda rows: {r["k"]: r["year"] for r in text.attachments(pages, rows, "k", "https://x.example").collect()}
    assert year(listing) == {1: "2120", 2: "2015"}
    assert year(listing.withColumn("published_at", F.date_format("published_at", "dd/MM/yyyy"))) == {1: None, 2: "2015"}


def test_first_links_of_a_list_of_many_pages(spark):
    item = lambda i: f"<li><a href='/p{i}'>page {i}</a></li>"
    parts = [(1, 0, item(1) + item(2)), (1, 1, item(3) + "<li><a href=''>none</a></li>" + item(4)), (2, 0, item(2) + item(5))]
    lists = spark.createDataFrame(parts, "list_id int, part int, html string").withColumn("url", F.lit("https://x.example/"))
    pages = spark.createDataFrame([(i, f"https://x.example/p{i}", f"<p>{'word ' * 20}</p>") for i in range(1, 6)], "page_id int, url string, html string")
    found = text.listed_articles(lists, pages, "li > a", {}, 4, part="part")
    assert sorted((r["list_id"], r["page_id"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 5)]


def test_document_rules_run_once_a_row_in_all_tasks(spark, tables):
    from quotemill.plans.text_queries import doc_canonical_select, doc_classify, doc_list_filter

    for query, most in ((doc_classify, 2), (doc_canonical_select, 2), (doc_list_filter, 2)):  # two texts a row; one in each of two modes
        plan = query(tables)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("translate(") <= most
    for branch in doc_list_filter(tables)._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1:]:
        assert "RepartitionByExpression" in branch  # the filter on texts stays above


def test_document_rules_of_odd_rows(spark):
    rows = [(None, None), ("", ""), ("BCTC Quý 1 2020", "https://x.example/a/b_EN.pdf"), ("BCTC nam", "plain_vi_.pdf"), ("Annual report", "https://x.example/2019/")]
    d = spark.createDataFrame([(i, "S1", *r) for i, r in enumerate(rows)], "i int, ticker string, title string, url_pdf string")
    got = {r["i"]: (r["doc_class"], r["language"], r["period_key"]) for r in text.classify_documents(d).collect()}
    assert got == {0: ("unknown", "UNKNOWN", "UNKNOWN-GENERAL"), 1: ("unknown", "UNKNOWN", "UNKNOWN-GENERAL"), 2: ("unknown", "VI", "2020-Q1"), 3: ("unknown", "VI", "UNKNOWN-ANNUAL"), 4: ("unknown", "EN", "2019-ANNUAL")}
    assert sorted((r["i"], r["year"]) for r in text.filter_document_list(d).collect()) == [(2, "2020"), (3, None)]
    assert [r["i"] for r in text.filter_document_list(d, ["s1"], strict_annual=True).collect()] == [3]
    assert text.filter_document_list(d, ["S2"]).count() == 0


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange" in line]


def test_series_of_prices_cost_one_exchange(spark, tables):
    from quotemill.plans.gold_queries import join_left_composite
    from quotemill.plans.silver_queries import ratio_clean

    composite = join_left_composite(tables)
    assert len(_exchanges(composite)) == 1 and "Join" not in composite._jdf.queryExecution().executedPlan().toString()
    ratios = ratio_clean(tables)
    plan = ratios._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and len(_exchanges(ratios)) == 3


def test_price_facts_equal_the_join(spark, tables):
    from quotemill.plans import gold

    p = tables.price().where("ticker < 'S00004'")
    p = p.unionByName(p.limit(3).withColumn("ticker", F.lit(None).cast("string"))).localCheckpoint()
    joined = gold.fact_price(p, gold.price_indicators(p))
    rows = lambda df: sorted(map(repr, df.select(*joined.columns).collect()))
    assert rows(gold.price_facts(p)) == rows(joined)


def test_an_incremental_run_reads_new_rows_once(spark, tables, tmp_path):
    from quotemill.operators import incremental

    p = tables.price().where("ticker < 'S00006'")
    p.unionByName(p.where("ticker = 'S00002'").withColumn("ticker", F.lit(None).cast("string"))).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    late = F.col("trading_date") > F.lit("1997-06-30").cast("date")
    incremental.indicator_state(p.where(~late)).write.parquet(str(tmp_path / "s"))
    state = spark.read.parquet(str(tmp_path / "s"))
    out, after = incremental.advanced_indicators(state, p.where(late & (F.coalesce("ticker", F.lit("")) != "S00003")))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2 and len(_exchanges(out)) == 1
    out.write.parquet(str(tmp_path / "o"))
    assert sorted(map(repr, incremental.state_after(state, spark.read.parquet(str(tmp_path / "o"))).collect())) == sorted(map(repr, after.collect()))
    numbers = lambda df: sorted((r["ticker"] or "", r["trading_date"], r["row_num"], r["obv"]) for r in df.collect())
    from quotemill.plans import gold

    full = gold.price_indicators(p).where(late & (F.coalesce("ticker", F.lit("")) != "S00003"))
    assert numbers(out) == numbers(full)


def test_the_latest_row_of_a_ratio_wins_before_it_is_unpivoted(spark):
    from quotemill.plans import silver

    wide = spark.createDataFrame([("a", "X", "1", 1.0, 2.0, None), ("A", "x", "2", None, 5.0, 7.0), ("b", "x", "1", 3.0, None, None), (None, "x", "1", 3.0, None, None)], "ticker string, item_code string, snapshot string, `2020-Q1` double, `2020-Q1_1` double, `2020-year` double")
    got = {(r["ticker"], r["item_code"], r["period"]): (r["value"], r["snapshot"]) for r in silver.clean_ratio(wide).collect()}
    assert got == {("A", "x", "2020-Q1"): (5.0, "2"), ("A", "x", "2020-year"): (7.0, "2"), ("B", "x", "2020-Q1"): (None, "1"), ("B", "x", "2020-year"): (None, "1")}
    assert silver.clean_ratio(wide)._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
