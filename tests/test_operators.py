"""Operators and rules on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.functions import rules
from quotemill.operators import incremental, keyed, quality
from quotemill.plans import gold, serve, silver, text
from quotemill.sources import datasets, sinks


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize("raw,wanted", [(" a  b ", "a b"), ("NaN", None), ("", None), (None, None), ("<NA>", None), ("none of it", "none of it")])
def test_compact(spark, raw, wanted):
    assert one(spark, raw).select(rules.compact("x")).first()[0] == wanted


@pytest.mark.parametrize("raw,wanted", [("yes", True), ("0", False), ("F", False), ("other", True), (None, None), ("null", None)])
def test_bool(spark, raw, wanted):
    assert one(spark, raw).select(rules.to_bool("x")).first()[0] is wanted


@pytest.mark.parametrize("raw,wanted", [("2026-05-18T09-00-00", dt.datetime(2026, 5, 18, 9)), ("20260518T090000", dt.datetime(2026, 5, 18, 9)), ("2026-05-18T16-00-00+07:00", dt.datetime(2026, 5, 18, 9)), ("latest", None), (None, None)])
def test_run_token(spark, raw, wanted):
    assert one(spark, raw).select(rules.run_token("x").cast("timestamp_ntz")).first()[0] == wanted


def test_nfc(spark):
    assert one(spark, "é").select(rules.nfc("x")).first()[0] == "é"


def test_json_and_arrays(spark):
    assert one(spark, "no json").select(rules.to_json_text("x")).first()[0] == '{"raw":"no json"}'
    assert one(spark, '["a", " b ", ""]').select(rules.to_texts("x")).first()[0] == ["a", "b"]
    assert one(spark, None).select(rules.to_texts("x")).first()[0] == []


PRICE = "ticker string, trading_date string, open double, high double, low double, close double, volume long, value double, fetched_at long"


def price(spark, *rows):
    return spark.createDataFrame([("aaa", "2026-01-02", 10.0, 11.0, 9.0, 10.0, 100, None, 1) if r is None else r for r in rows], PRICE)


def test_missing_value_is_derived(spark):
    r = silver.clean_price(price(spark, None)).first()
    assert (r["ticker"], r["value"], r["value_is_derived"]) == ("AAA", 1_000_000.0, True)


def test_value_without_factor_is_scaled_and_full_value_stays(spark):
    r = silver.clean_price(price(spark, ("A", "2026-01-02", 10.0, 11.0, 9.0, 10.0, 100, 1000.0, 1), ("B", "2026-01-02", 10.0, 11.0, 9.0, 10.0, 100, 1_000_000.0, 1))).orderBy("ticker").collect()
    assert [x["value"] for x in r] == [1_000_000.0, 1_000_000.0] and not any(x["value_is_derived"] for x in r)


def test_index_has_no_factor(spark):
    assert silver.clean_price(price(spark, None).withColumnRenamed("ticker", "index_code"), "index_code", "index").first()["value"] == 1000.0


def test_latest_row_wins_and_bad_keys_go(spark):
    d = price(spark, ("A", "2026-01-02", 1.0, 1.0, 1.0, 1.0, 1, None, 1), ("a ", "2026-01-02", 2.0, 1.0, 3.0, 2.0, 1, None, 2), (None, "2026-01-02", 1.0, 1.0, 1.0, 1.0, 1, None, 1), ("A", "x", 1.0, 1.0, 1.0, 1.0, 1, None, 1))
    rows = silver.clean_price(d).collect()
    assert len(rows) == 1 and rows[0]["close"] == 2.0 and rows[0]["is_suspicious"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="close"):
        silver.clean_price(price(spark, None).drop("close"))


def test_suffix_collapse_and_periods(spark):
    w = spark.createDataFrame([("a", "roe", "s1", 1.0, 2.0, 3.0), ("a", "roe", "s2", 4.0, None, 6.0)], "ticker string, item_code string, snapshot string, `2025-Q4` double, `2025-Q4_1` double, `2025-year` double")
    rows = {r["period"]: r for r in silver.clean_ratio(w).collect()}
    assert rows["2025-Q4"]["value"] is None and rows["2025-Q4"]["snapshot"] == "s2" and rows["2025-Q4"]["quarter"] == 4
    assert rows["2025-year"]["period_type"] == "annual" and rows["2025-year"]["value"] == 6.0


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = keyed.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, keyed.upsert(once, b, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert tuple(keyed.upsert_counts(a, b, ["k"]).first()) == (1, 1)


def test_dedupe_does_not_depend_on_partitions(spark, tables):
    b = silver.clean_board(tables.board())
    assert sorted(map(repr, silver.board_latest(b.repartition(1)).collect())) == sorted(map(repr, silver.board_latest(b.repartition(7)).collect()))


def test_incremental_equals_full(spark, tables):
    p = tables.price()
    full = gold.price_indicators(p)
    cut = dt.date(1996, 3, 31)
    is_old = F.col("trading_date") <= F.lit(cut)
    late = p.where(is_old & (F.col("volume") % 3 == 0))  # seen before: left out
    part, state = incremental.advanced_indicators(incremental.indicator_state(p.where(is_old)), p.where(~is_old).unionByName(late))
    names = ["ticker", "trading_date", "row_num", "obv"]
    shown = lambda d: sorted((tuple(r[n] for n in names), *(None if r[c] is None else round(r[c], 6) for c in ("ma50", "rsi14", "macd_hist", "bb_upper"))) for r in d.collect())
    assert shown(part) == shown(full.where(F.col("trading_date") > F.lit(cut)))
    # tickers with new rows alone, and the same state as from the whole history
    whole = {r["ticker"]: r for r in incremental.indicator_state(p).collect()}
    assert {r["ticker"]: r for r in state.collect()} == {k: r for k, r in whole.items() if r["last_day"] > cut}
    none, empty = incremental.advanced_indicators(incremental.indicator_state(p), p.where(is_old))
    assert none.count() == 0 and empty.count() == 0
    first, _ = incremental.advanced_indicators(incremental.indicator_state(p.limit(0)), p)
    assert shown(first) == shown(full)


def test_rsi_without_losses(spark):
    rows = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), float(i), 1) for i in range(20)]
    d = spark.createDataFrame(rows, "ticker string, trading_date date, close double, volume long")
    assert gold.price_indicators(d).where("row_num = 20").first()["rsi14"] is None
    assert gold.price_indicators(d, 100.0).where("row_num = 20").first()["rsi14"] == 100.0


def test_quality(spark):
    d = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert tuple(quality.key_quality(d, ["k"]).first()) == (3, 1, 2)
    with pytest.raises(ValueError):
        quality.demand_key(d, ["k"])


@pytest.mark.parametrize("title,summary,wanted", [("Cổ phiếu HPG tăng", "", ["HPG"]), ("mã CK: FPT", "", ["FPT"]), ("HOSE: HCM", "", ["HCM"]), ("Đi TP.HCM hôm nay", "", None), ("top 10 doanh nghiệp", "", None), ("tin FPT", "cổ phiếu HPG", ["FPT", "HPG"])])
def test_mentions(spark, title, summary, wanted):
    news = spark.createDataFrame([("1", title, summary, "")], "article_id string, title string, summary string, body_text string")
    codes = spark.createDataFrame([("HPG",), ("FPT",), ("HCM",), ("TOP",)], "code string")
    r = text.ranked_mentions(text.mention_scores(text.mention_candidates(news, codes))).first()
    assert (r and r["mentions"]) == wanted


def test_page_article(spark):
    html = '<html><head><meta property="og:title" content="T1"><meta name="description" content="S1"><script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "2026-01-02T10:00:00+07:00"}</script></head><body><h1>H</h1><p>one</p><p>two</p></body></html>'
    r = text.page_article(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).first()
    assert (r["title"], r["summary"], r["body_text"], r["published_at"]) == ("T1", "S1", "one\ntwo", dt.datetime(2026, 1, 2, 3))


def test_url(spark):
    assert one(spark, "HTTPS://A.Com:443/p/?utm_x=1&b=2&a=1#f").select(text.normal_url("x")).first()[0] == "https://a.com/p?a=1&b=2"
    assert one(spark, "http://a.com:8080/").select(text.normal_url("x")).first()[0] == "http://a.com:8080"


def test_partition_filter_is_pushed(spark, tmp_path):
    spark.range(100).withColumn("year", (F.col("id") % 5 + 2020).cast("int")).write.partitionBy("year").parquet(str(tmp_path / "t"))
    d = datasets.since(datasets.scan(spark, str(tmp_path / "t")), "year", 2023)
    assert d.count() == 20 and "PartitionFilters: [isnotnull(year" in d._jdf.queryExecution().toString()


def test_merge_partitions(spark, tmp_path):
    path = str(tmp_path / "m")
    a = spark.createDataFrame([(1, "x", 2020), (2, "y", 2021)], "k int, v string, year int")
    sinks.overwrite_partitions(a, path, "year")
    sinks.merge_partitions(spark.createDataFrame([(2, "z", 2021), (3, "w", 2021)], "k int, v string, year int"), path, ["k"], "year")
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "year").collect())) == [(1, "x", 2020), (2, "z", 2021), (3, "w", 2021)]


def test_indicator_plan_has_one_exchange_of_prices(spark, tables):
    p = spark.createDataFrame([("A", dt.date(2026, 1, 1), 1.0, 1)], "ticker string, trading_date date, close double, volume long")
    plan = gold.price_indicators(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_pages(spark):
    d = spark.range(45)
    assert [r["id"] for r in serve.page(d, [F.asc("id")], 3, 20).collect()] == list(range(40, 45))
    assert tuple(serve.page_info(d, 2, 20).first()) == (45, 2, 20, True)


def test_empty_universe(spark):
    with pytest.raises(ValueError):
        incremental.demand_rows(incremental.listing_universe(spark.createDataFrame([("a", "HOSE", "stock")], "symbol string, exchange string, type string"), ["HNX"]))
