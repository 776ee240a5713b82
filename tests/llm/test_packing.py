"""Packing: ids of whole texts, pieces that tile documents and sequences, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import packing
from quotemill.llm.queries import op11_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = "aZéÀß×÷ñ'\"-.,;:!?<|>…–1٣ ̈ͅΣςİıﬁ½\x01\x00\x1c 　 漢字🙂\n\t한s"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_units_equal_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "don't stop.It's o.k.,yes;no", "<|endoftext|>a<|startoftext|>", "x<|endoftext|>,y", "\x01", "a \x01 b", "we'll,'s're…ok"]
    texts += ["".join(rng.choices(ODD, k=rng.randrange(1, 40))) for _ in range(4000)]
    texts += [" ".join(rng.choices(["word", "Élan,", "l'été", "(x)", "a-b", "3.14", "日本", "naïve."], k=30)) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, sizes = packing.Units(PATH).of(data, offsets)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    for t, g in zip(texts, got):
        assert g.tolist() == encoded(tokenizer, t)[:-1], repr(t)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    units = packing.Units(PATH)
    for _ in range(3):
        again, _ = units.of(data, offsets)
        assert again.tolist() == ids.tolist()


def judge(rows, texts, tokenizer, capacity=4096):
    """texts: (doc_id, text) of all rows.  Checks all but the amount of padding, which it returns."""
    want = Counter((d, tuple(encoded(tokenizer, t))) for d, t in texts)
    ids_of = defaultdict(list)
    for d, t in want:
        ids_of[d].append(t)
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and r["start"] + r["length"] <= r["doc_tokens"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        fits = [t for t in ids_of[r["doc_id"]] if len(t) == r["doc_tokens"]]
        crc = {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) for t in fits}
        assert r["ids_crc32"] in crc
        covered.update((r["doc_id"], r["doc_tokens"], p) for p in range(r["start"], r["start"] + r["length"]))
    by_size = Counter()
    for (d, t), n in want.items():
        by_size[d, len(t)] += n
    assert covered == Counter({(d, n, p): c for (d, n), c in by_size.items() for p in range(n)})
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_whole_table(spark, tokenizer):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = op11_packing(spark, SF).collect()
    assert judge(rows, texts, tokenizer) == 0
    assert len(rows) < 1.5 * sum(-(-len(encoded(tokenizer, t)) // 4096) for _, t in texts)


@pytest.mark.parametrize("seed", range(3))
def test_mixed_lengths(spark, tokenizer, seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(["go"] * int(4096 * rng.random() ** (1 + 2 * seed)))) for i in range(150)]
    texts += [(7, "again"), (7, "again"), (7, "other"), (None, None), (None, "no id"), (9000, None), (9001, ""), (9002, "go " * 4095), (9003, "go " * 4096), (9004, "go " * 30_000)]
    texts += [(i, "") for i in range(10_000, 10_000 + 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    clash = ("part", "i", "ids", "start", "length", "crc", "k", "bin", "slot", "before", "cell", "pos", "offset", "sequence_id")
    rows = packing.packing_digest(df.select("*", *[F.lit(1).alias(c) for c in clash]), PATH).collect()
    assert judge(rows, texts, tokenizer) == 0


@pytest.mark.parametrize("sizes", [[], [1], [3000], [2049] * 9, [4096] * 3, [1] * 5000, [1023] * 8 + [1] * 2000])
def test_one_length(spark, tokenizer, sizes):
    texts = [(i, "go " * (n - 1)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert judge(packing.packing_digest(df, PATH).collect(), texts, tokenizer) == 0


def test_real_sequences(spark, tokenizer):
    texts = [(i, f"text number {i} " * (i * 37 % 400)) for i in range(120)]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH)
    got = [np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() for r in packing.sequences(pieces).collect()]
    assert all(len(g) == 4096 or len(g).bit_count() == 1 for g in got)
    ids = Counter(x for g in got for x in g)
    assert ids == Counter(x for _, t in texts for x in encoded(tokenizer, t))
    assert packing.sequences(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH, capacity=64), capacity=64).where("n_ids > 64").count() == 0


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 4)
    df = spark.range(300).select(F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    got = {r["at"]: r["before"] for r in packing._with_before(df, "at", "v", 300).collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(300)}
