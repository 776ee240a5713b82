"""The index of three-letter grams against ``ilike`` over all texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotemill.operators import substring
from quotemill.operators.batches import small
from quotemill.plans import serve, text
from quotemill.plans.serve_queries import q_news_indexed
from quotemill.sources import sinks

COLUMNS = ("title", "body")
ROWS = [
    ("1", "Cổ phiếu HPG TĂNG mạnh", "body", 1), ("2", None, "100% of the_rest", 2), (None, "hpg again", None, 3), ("4", "", "", 4), ("5", None, None, 5), ("6", "ab", "c", 6),
    ("7", "the thé", "x" * 5000 + "needle", 7), ("7", "the thé", "x" * 5000 + "needle", 7), ("8", "line\nend\\here", "😀 emoji😀x", 8), ("9", "İstanbul ẞ", "tail th", 9),
]
PATTERNS = ["the", "HPG", "tăng", "needle", "a%t", "t_e", "th", "t", "%", "_", "", "of%rest", "100\\%", "the\\_r", "\\\\here", "😀x", "emoji😀", "istanbul", "İst", "bc", "abc", "line\nend", "zzz", "e_r_s", "again", "x" * 200 + "n"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id string, title string, body string, slot long")  # ``slot`` is a name of the index, too


@pytest.fixture(scope="module")
def path(spark, table):
    out = sinks.scratch(spark, "grams")
    substring.write_index(table, COLUMNS, out, slot_rows=3)
    return out


@pytest.mark.parametrize("pattern", PATTERNS)
def test_equals_scan(spark, table, path, pattern):
    wanted = table.where(F.col("title").ilike(f"%{pattern}%") | F.col("body").ilike(f"%{pattern}%"))
    for most in (1000, 1):
        got = substring.search(spark, path, COLUMNS, pattern, most_slots=most)
        assert got.columns == table.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_pieces():
    assert substring.pieces("a%bc_d\\%e\\") == ["a", "bc", "d%e\\"]
    assert substring.wanted_grams("abcd%xy") == ["abc", "bcd"]
    assert len(substring.wanted_grams("abcdefghijklmnopqrstuvwxyz")) <= substring.MOST_GRAMS


def test_plan_reads_grams_by_filter(spark, path):
    plan = substring.proposed(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan.split("PushedFilters")[1].split("]")[0] and "own" not in plan
    texts = substring.search(spark, path, COLUMNS, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "slot" in texts.split("PushedFilters")[1].split("]")[0]


def test_empty_table(spark, table):
    out = sinks.scratch(spark, "grams")
    substring.write_index(table.limit(0), COLUMNS, out)
    assert substring.search(spark, out, COLUMNS, "the").count() == substring.search(spark, out, COLUMNS, "%").count() == 0


def test_articles_by_index(spark, tables):
    from quotemill.plans.text_queries import facts

    out = sinks.scratch(spark, "articles")
    serve.index_articles(facts(tables), out)
    for words in ("the", "zzqq", "an%e", "e"):
        for number in (1, 2):
            scan = serve.articles(facts(tables), search=words, sentiment="positive", number=number)
            by_index = serve.articles_by_index(spark, out, words, sentiment="positive", number=number)
            assert scan.columns == by_index.columns and scan.collect() == by_index.collect()


def test_rows_are_made_once(spark, table):
    """No count, no sample of ranges: what makes the rows runs once for each."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(title):
        made.add(1)
        return title

    out = sinks.scratch(spark, "grams")
    substring.write_index(table.withColumn("title", seen.asNondeterministic()("title")), COLUMNS, out)
    assert made.value == len(ROWS)


def test_lists_of_small_pieces():
    """Every text's grams, in pieces of one or many texts, and with more letters than fit a number beside the row."""
    many = "".join(chr(0x20000 + i) for i in range(40000)) + "".join(chr(0x1000 + i) for i in range(40000))
    texts = ["abc\0\0", "abcabd\0\0", "\0\0", "😀x😀\0\0", many + "\0\0", "abc\0\0"]
    batch = pa.record_batch({"slot": pa.array([0, 0, 0, 1, 1, 1]), "row": pa.array([0, 1, 2, 0, 1, 2], pa.int16()), "text": texts})
    wanted = {(substring.gram_number(t[i : i + 3]), s, r) for t, s, r in zip(texts, batch["slot"].to_pylist(), batch["row"].to_pylist(), strict=True) for i in range(len(t) - 2)}
    for most in (1, 20, 1 << 20):
        lists = [x for b in small([batch], ("text",), most) for part in substring._lists(b) for x in part.to_pylist()]
        got = [(x["gram"], x["slot"], r) for x in lists for r in x["rows"]]
        assert len(got) == len(wanted) and set(got) == wanted


@pytest.mark.parametrize("pattern", ["t_e", "needle"])
def test_texts_meet_few_words_without_a_shuffle(spark, path, pattern):
    """What is proposed is stored, a word for 64 rows, so its size is known before the texts are read."""
    words = substring.proposed(spark, path, pattern).collect()
    assert words and len({(w["slot"], w["word"]) for w in words}) == len(words)
    plan = substring.search(spark, path, COLUMNS, pattern)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan


#: article_id, doc_id, ticker, mentions, title, summary, body, source, day.  "a" and "b" have several rows for one ticker, of which one counts before anything is searched.
NEWS = [
    ("a", 2, "S1", ["S2", " S1 "], "plain", "no code", "old Needle", "src2", 1), ("a", 1, "S1", None, "plain", "no code", "new text", "src2", 2), ("a", 3, "S2", [], "about s2", "needle", "third", "src9", 3),
    ("b", 5, "S1", ["S3"], "x", None, "needle one", None, 1), ("b", 4, None, ["S1", None, ""], "x", None, "needle two", "src1", 1), ("b", 5, "S1", ["S3"], " ", None, "no title: needle", None, 1),
    ("c", 6, "", ["S4"], "needle", "s4", None, "src1", None), ("d", 7, "", None, "needle", "no ticker", None, "src1", 2), (None, 8, "S1", None, "needle", None, None, "src1", 2), ("e", 9, "S1", ["S5"], "nee%dle", "s5 NEEDLE", "b", "src3", 2),
]


def test_news_by_index_equals_scan(spark):
    """Texts that are stored once, with their tickers given when they are found, against rows of articles and tickers."""
    d = spark.createDataFrame(NEWS, "article_id string, doc_id long, ticker string, ticker_mentions array<string>, title string, summary string, body_text string, source string, day int")
    news = d.withColumn("published_date", F.when(F.col("day").isNotNull(), F.date_add(F.lit("1995-01-01").cast("date"), "day"))).withColumn("published_at", F.when(F.col("day") != 2, F.timestamp_seconds(F.col("day") * 86400)))
    for table in (news, news.where("doc_id > 8"), news.limit(0)):
        out, every = sinks.scratch(spark, "news"), text.article_tickers(table)
        serve.index_news(table, out)
        for words in ("needle", "e", "ne_dl", "nee\\%", "new", "%", "zzqq"):
            for more in ({}, {"symbol": "s1"}, {"source": "src2"}, {"number": 2, "size": 2}):
                scan, by_index = serve.articles(every, search=words, **more), serve.news_by_index(spark, out, words, **more)
                assert scan.columns == by_index.columns and scan.collect() == by_index.collect(), (words, more)


def test_query_stores_each_text_once(spark, tables, monkeypatch):
    """Not once for each of its tickers, and no text is shuffled on its way to the index."""
    paths, plans, write = [], [], substring.write_index

    def seen(table, columns, path, *args):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        paths.append(path)
        write(table, columns, path, *args)

    monkeypatch.setattr(substring, "write_index", seen)
    assert q_news_indexed(tables).collect()
    texts = spark.read.parquet(f"{paths[0]}/texts")
    assert texts.count() == tables.news().where("trim(title) <> ''").count() and "hashpartitioning" not in plans[0]


def test_few_words_are_sent_whatever_the_planner_takes_for_small(spark, path):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = substring.search(spark, path, COLUMNS, "needle")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
