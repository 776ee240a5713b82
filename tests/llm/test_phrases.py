"""Collocations against plain counting, and the index against its definition."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import phrases
from quotemill.llm.common import stored


def brute(rows, least, most, reported):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        covered = any(lg == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), b in f.items())
        if not covered:
            s, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), " ".join(p), a, left, right, n[lang], s))
    return sorted((lang, i + 1, *x[3:]) for lang, all_ in out.items() for i, x in enumerate(sorted(all_)[:reported]))


def found(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "B", "ç", "é,", "d.", "the", "x;y", "\x0b", "\t", "zz\x00", "is is is", "a b", ""]
    return [(["en", None, "und", "de"][rng.integers(4)], " ".join(rng.choice(words, rng.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed, shard, known", [(1, 1 << 20, 10**6), (2, 300, 0), (3, 40, 10**6), (4, 500, 12)])
def test_small_tables(spark, monkeypatch, seed, shard, known):
    """``known``: frequent words and phrases go to all tasks, are joined to shards, or both by their number."""
    monkeypatch.setattr(phrases, "KNOWN_TO_ALL", known)
    rows = texts(seed, 120) + [("en", None), ("de", ""), (None, "only nulls")] + [("en", "very long " * 3000 + ". " + "is " * 500)] + [("fr", "same text here")] * 9
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    clash = [F.lit(1).alias(c) for c in ("shard", "id", "phrase", "count", "ids", "a", "n", "words", "of", "rank", "doc_id")]
    for least, most in ((3, 5), (9, 4), (2, 2)):
        want = brute(rows, least, most, 30)
        assert want and found(df.select("*", *clash), least=least, most=most, reported=30, shard_bytes=shard) == want


def test_nothing_frequent(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert found(df) == [] and found(df.limit(0)) == [] and found(df, least=1)[0][1:3] == (1, "a b c")


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 10**13 + 7, 10**17 - 3, 10**13 + 9, 2 * 10**13 + 1
    df = spark.range(1).select(phrases.score(*[F.lit(x).cast("long") for x in (a, n, left, right)]).alias("s"), phrases.score(*[F.lit(x) for x in (100, 10**12, 100, 100)]).alias("t"))
    assert tuple(df.first()) == (1000 * a * n // (left * right), 1000 * 10**12 // 100)


def test_both_ends_follow():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 4, 400).astype(np.uint32)
    index = phrases.BidirectionalIndex(ids)
    want = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all()) for k in range(1, 6)}
    for sides in ((False, False, True, False), (True, True, True, True), (True, False, True, False)):
        now = index.single_words()
        for k, left in enumerate(sides, 2):
            now = index.extended(now, left)
            assert Counter(dict(zip(map(tuple, now.words.tolist()), now.count.tolist()))) == want[k]
            for p, lo, back, count in zip(now.words, now.lo, now.back, now.count):
                for side, at, word in ((index.forward, lo, p), (index.backward, back, p[::-1])):
                    text = np.concatenate([[0], ids, [0]])[:: 1 if side is index.forward else -1]
                    smaller = sum(tuple(x) < tuple(word) for x in np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(k - 1, dtype=int)]), k).tolist())
                    assert at == smaller and count > 0


def test_a_reader_has_few_shards_in_memory(spark, monkeypatch):
    """Spark reads thousands of rows of a file at once: stored files of one task with many shards hold one, or the rows of a few."""
    files = {}
    monkeypatch.setattr(phrases, "stored", lambda df, **how: files.setdefault(how["like"], stored(df, **how)))
    df = spark.createDataFrame(texts(5, 400), "lang string, text string").coalesce(1)
    phrases.mined(df, least=3, shard_bytes=500)
    rows = {like: [n for (n,) in found.groupBy(F.input_file_name()).agg(F.count("*")).select("count(1)").collect()] for like, found in files.items()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(rows["shards"]))
    assert len(rows["shards"]) > 20 and max(rows["shards"]) == 1
    assert all(max(rows[f"phrases{k}"]) <= phrases.SHARDS_IN_FILE * (buckets + 1) for k in (2, 3, 4)) and len(rows["phrases2"]) > 5


def test_memory_of_a_shard():
    rng = np.random.default_rng(6)
    data = np.frombuffer(" ".join(rng.choice(["the", "collocation", "of.", "words", "x,"], 300_000)).encode(), dtype=np.uint8)
    tracemalloc.start()
    words, _, count, ids = phrases._shard(data, np.array([0, len(data)]), np.array([0]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 5 and count.sum() == 300_000 == (ids > 0).sum() and most < 20 * len(data)


def test_shards_meet_packed_phrases(spark, monkeypatch):
    """More frequent phrases than all tasks may know: their rows are not joined one by one, behind a second Python worker for each task."""
    plans, met = [], phrases._met
    monkeypatch.setattr(phrases, "KNOWN_TO_ALL", 0)
    monkeypatch.setattr(phrases, "_met", lambda left, held, size, *how: (plans.append((size, held._jdf.queryExecution().toString())), met(left, held, size, *how))[1])
    phrases.mined(spark.createDataFrame(texts(7, 60), "lang string, text string"), least=3, most=3, shard_bytes=2000)
    assert [size for size, _ in plans] == [2, 3] and "Join" in plans[0][1] and "Join" not in plans[1][1] and "ArrowEvalPython" not in plans[1][1]
