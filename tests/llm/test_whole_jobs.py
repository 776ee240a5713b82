"""Operators do the whole job: cases that a cut or an estimate would get wrong."""

import numpy as np
from pyspark.sql import functions as F

from quotemill.llm import common, decontaminate, simhash, toxicity
from tests.llm.test_llm import docs


# --- 4: toxicity

def test_toxicity_share_does_not_depend_on_the_sample(spark):
    d = docs(spark, *["the same words"] * 1500)
    lab = d.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    for positives, unlabelled, negatives in ((3000, 6000, 6000), (3000, 200, 100), (40, 80, 30)):
        model = toxicity.fit(d, lab, positives, unlabelled, negatives)
        score = toxicity.score(d.limit(1), model).first()["score"]
        assert abs(score - 0.1) < 0.03, (positives, unlabelled, negatives, score)


def test_toxicity_learns_from_unlabelled_texts(spark):
    """Half of the rows have no label; a word that only they hold outside toxic texts is no sign of toxicity."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 40)) + (" slur insult" if i % 8 == 0 else " common" if i % 2 else "") for i in range(1200)]
    texts += [" ".join(rng.choice(words, 40)) + " common" for _ in range(1200)] + ["", None, " . "]
    d = docs(spark, *texts)
    lab = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(1200)], "doc_id long, toxic int")
    rows = toxicity.training_rows(d, toxicity.known_labels(lab), unlabelled=10000)
    assert rows.where("kind = 0 and doc_id >= 1200").count() > 900 and rows.where("doc_id >= 1200 and kind <> 0").count() == 0
    said = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_digest(d, lab).collect()}
    assert all(said[i] == (i % 8 == 0 and i < 1200) for i in range(2400))
    always = spark.createDataFrame([(i, 1) for i in range(1200)], "doc_id long, toxic int")
    assert {r["doc_id"] for r in toxicity.drop_toxic(d, always).collect()} == {2400, 2401, 2402}


# --- 8: near duplicates of the pipeline

def shingles(t, size=5):
    w = t.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def test_near_duplicates_are_exact(spark):
    rng = np.random.default_rng(11)
    pairs = []
    # short texts and one word more; long ones with their last words changed, just above and below 0.8
    for n in range(5, 21):
        t = [f"a{n}x{i}" for i in range(n)]
        pairs += [(t, [*t, "more"]), ([f"b{w}" for w in t], [*(f"b{w}" for w in t), "and", "more"])]
    for k in range(12, 60, 2):
        t = [f"l{k}x{rng.integers(1 << 30)}" for _ in range(204)]
        pairs.append((t, [*t[:-k], *(f"n{k}x{i}" for i in range(k))]))
    texts = [" ".join(x) for p in pairs for x in p]
    sets = [shingles(t) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.75 < s < 0.8 for s in similar) > 3 and sum(0.8 <= s < 0.85 for s in similar) > 3
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, *texts)).collect()}
    assert kept == {i for i in range(len(texts)) if i % 2 == 0 or similar[i // 2] < 0.8}
    by_bucket = simhash.near_components(docs(spark, *texts), split_above=1).where("component_id <> doc_id").select("doc_id")
    assert {r[0] for r in by_bucket.collect()} == set(range(len(texts))) - kept


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """One text with very many near copies, some of which link only through others; copies of one content over the bound."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(simhash, "COPIES_AT_ONCE", 8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):
        t = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            t[at] = f"e{i}x{at}"
        texts.append(" ".join(t))
    texts += [" ".join(base)] * 40 + [" ".join(f"z{rng.integers(1 << 30)}" for _ in range(100)) for _ in range(20)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for most in (4, 4096):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs(spark, *texts), split_above=most).collect()}
        assert got == {i: find(i) for i in range(len(texts))}
    fps = simhash.simhash_components(docs(spark, *texts), split_above=4).collect()
    same = simhash.simhash_components(docs(spark, *texts)).collect()
    assert sorted(map(str, fps)) == sorted(map(str, same))


def test_near_duplicate_recall_on_edited_texts(spark):
    """Fresh pairs at similarity 0.8 and up: texts of the test table with words replaced."""
    rng = np.random.default_rng(13)
    long = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) between 60 and 400").select("doc_id", "text").orderBy("doc_id").limit(250).collect()]
    edited = []
    for r in long:
        w = r["text"].split()
        while True:
            at = int(rng.integers(0, len(w)))
            new = [*w[:at], f"new{rng.integers(1 << 30)}", *w[at + 1 :]]
            a, b = shingles(" ".join(new)), shingles(r["text"])
            if len(a & b) / len(a | b) < 0.8:
                break
            w = new
        edited.append(" ".join(w))
    d = docs(spark, *(r["text"] for r in long), *edited)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(d).collect()}
    assert not kept & set(range(len(long), 2 * len(long)))


# --- 9: longest matches

def test_longest_matches_of_shared_passages(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(24)]
    texts = [" ".join([f"a{i}", *passage[: 12 + n], *rng.choice(["x", "y", "p3", "p15"], 5)]) for i, n in enumerate([1, 8, 0, 5, 8, 3, 2, 7, 8])]
    texts += [" ".join(passage[k:18]) for k in (2, 5)] + ["p0 p1 zz p0 p1", "", None]
    ids = [50 - i for i in range(len(texts))]
    items = [" ".join(passage), " ".join([*passage[:6], "unknown", *passage[6:]]), "p0 p1", "x"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    wanted = {}
    for k, item in enumerate(items):
        w = item.split()
        for at in range(len(w)):
            best = None
            for i, t in zip(ids, texts):
                v = (t or "").split()
                for p in range(len(v)):
                    n = 0
                    while at + n < len(w) and p + n < len(v) and w[at + n] == v[p + n]:
                        n += 1
                    if n and (best is None or (-n, i, p) < best):
                        best = (-n, i, p)
            if best:
                wanted[str(k), at] = (-best[0], *best[1:])
    got = decontaminate.longest_matches(docs(spark, *texts, ids=ids).coalesce(1), b).collect()
    assert {(r["item_id"], r["item_word"]): (r["n_words"], r["doc_id"], r["doc_word"]) for r in got} == wanted


def test_longest_match_of_each_document(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [" ".join(rng.choice([f"v{i}" for i in range(12)], n)) for n in (60, 40, 40, 25, 4, 12)] + ["solo"]
    items[2] = " ".join([*items[0].split()[10:35], *items[1].split()[:15]])
    texts = []
    for i in range(60):
        t = [f"x{i}"]
        for _ in range(rng.integers(1, 4)):
            w = items[rng.integers(0, len(items))].split()
            a = rng.integers(0, len(w))
            t += [*w[a : a + rng.integers(1, 40)], f"y{rng.integers(1 << 30)}"]
        texts.append(" ".join(t))
    b = spark.createDataFrame([(f"i{9 - k}", t) for k, t in enumerate(items)], "item_id string, text string")
    wanted = []
    for t in texts:
        v, best = t.split(), None
        for k, item in enumerate(items):
            w = item.split()
            for at in range(len(w)):
                for p in range(len(v)):
                    n = 0
                    while at + n < len(w) and p + n < len(v) and w[at + n] == v[p + n]:
                        n += 1
                    if n >= min(10, len(w)) and (best is None or (-n, p, f"i{9 - k}", at) < best):
                        best = (-n, p, f"i{9 - k}", at)
        wanted.append((-best[0], best[2], best[3], best[1]) if best else (0, None, None, None))
    get = lambda: [tuple(r)[6:] for r in decontaminate.contamination_digest(docs(spark, *texts).coalesce(2), b).orderBy("doc_id").collect()]
    assert get() == wanted and sum(x[0] > 12 for x in wanted) > 10
    # more distinct words than ranks can tell apart change nothing
    before = [(r["item_id"], r["item_word"], r["n_words"], r["doc_id"], r["doc_word"]) for r in decontaminate.longest_matches(docs(spark, *texts).coalesce(1), b).orderBy("item_id", "item_word").collect()]
    import pyarrow as pa

    data, offsets = decontaminate.text_bytes(pa.array(texts))
    test = decontaminate.TestBlock([(f"i{9 - k}", t) for k, t in enumerate(items)])
    want = [x.tolist() for x in decontaminate.Shard(data, offsets).longest(test)]
    monkeypatch.setattr(decontaminate, "_MOST", 20)
    assert [x.tolist() for x in decontaminate.Shard(data, offsets, test.vocabulary).longest(test)] == want and len(before) > 50
    split = list(decontaminate._fitting([(str(k), f"q{k}a q{k}b q{k}c") for k in range(12)], 10))
    assert len(split) == 2 and sum(len(x.items) for x in split) == 12


def test_a_full_bit_table_loses_no_key(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    rows = spark.range(3000).select(F.when(F.col("id") < 2999, F.col("id")).alias("doc_id"))
    for most, passed in ((1 << 26, 1200), (1 << 10, 3000)):
        held = rows.where(common.may_be_among(keys, "doc_id", most)(F.col("doc_id")))
        assert held.join(keys, "doc_id").count() == 1000 and held.count() <= passed
    assert rows.where(common.may_be_among(keys.where("false"), "doc_id")(F.col("doc_id"))).count() == 0
