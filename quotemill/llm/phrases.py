"""Phrase collocation mining with FM-indexes over word ids, one for each shard of texts.

A shard is about ``SHARD_BYTES`` of texts as ids of its own words, with a 0 where a piece ends.  Its index is two Burrows-Wheeler
transforms, of the text and of the text reversed, sorted by as many words as phrases may have.  An interval pair stands for a phrase: one
step extends all intervals at once, to the right through the reversed transform and to the left through the other, and both
ends of the pair follow.  Each phrase is reached once, by steps to the right and to the left in turn, with its count.

Counts are sums over shards, so a shard has to report what is rare in it as well; what is rare everywhere is cut first.  A phrase that is
frequent enough has no rarer part.  Counts travel packed: a row has those of a shard that fall into one bucket of phrases, and a bucket is summed in
one task, which holds about as many phrases as a shard.  For phrases of k + 1 words a shard indexes only the chains of its text in which phrases
of k words that are frequent over all shards follow each other.  Frequent words have numbers without gaps, phrases are rows of
these.  Up to ``KNOWN_TO_ALL`` frequent words (or phrases of a length) are sent to all tasks.  Where there are more, words are joined to the shards
that hold them, behind a table of at most 8 MB of hash bits that spares most rare ones that shuffle, and a bucket returns to each shard its
frequent phrases, packed.  The result is the same.

Spark reads up to 4,096 rows of a file at once, whatever their bytes, so a stored file holds one shard, or the phrases and texts of
``SHARDS_IN_FILE``.

The score of a phrase is its lowest over all cuts into two parts, floor(1000 a n / (l r)) in decimals of 38 digits.

Defined results: a null lang is ``und``; null and empty texts have no words; repeated rows count each time; a table without
frequent phrases gives no rows; other columns than lang and text are ignored.  A text longer than a shard is dealt over several, cut where
pieces end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import LOWER, byte_table, chunks, may_be_among, stored, word_spans

SHARD_BYTES = 16 << 20
LEAST, WORDS, REPORTED = 100, 5, 2000
#: Frequent words, or phrases of a length, that are sent to all tasks (and 32 times as many bytes of words); more are joined to shards.
KNOWN_TO_ALL = 1_000_000
SHARDS_IN_FILE = 4
UNKNOWN_LANG = "und"
#: Bytes that end pieces, and bytes of words.
PIECE_END = byte_table([*b".,;:!?", *range(0x0A, 0x0E)])
IN_WORD = byte_table([b for b in range(256) if b not in (0x20, 0x09) and not PIECE_END[b]])


class FMIndex:
    """The Burrows-Wheeler transform of ids (0 between pieces), sorted by ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        padded = np.concatenate([ids, np.zeros(depth, dtype=ids.dtype)])
        order = np.arange(n)
        for at in reversed(range(depth)):
            order = order[np.argsort(padded[order + at], kind="stable")]
        self.bwt = np.where(order > 0, ids[order - 1], 0) if n else ids
        by_word = np.argsort(self.bwt, kind="stable")
        #: Words of the transform with their places, sorted: a place in this list is a place in the index.
        self.keys = self.bwt[by_word].astype(np.int64) * (n + 1) + by_word
        self.n = n

    def step(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where intervals that begin (or end) at ``at`` do so when a word is put before their phrase."""
        return np.searchsorted(self.keys, words.astype(np.int64) * (self.n + 1) + at)


class Phrases:
    """Phrases of one length with their intervals in both indexes."""

    def __init__(self, words: np.ndarray, lo: np.ndarray, back: np.ndarray, count: np.ndarray):
        self.words, self.lo, self.back, self.count = words, lo, back, count


class BidirectionalIndex:
    def __init__(self, ids: np.ndarray, depth: int = WORDS):
        small = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
        ids = np.concatenate([[0], ids, [0]]).astype(small)  # so that both transforms hold the words that the text holds
        self.forward, self.backward, self.ids = FMIndex(ids, depth), FMIndex(np.ascontiguousarray(ids[::-1]), depth), ids

    def single_words(self) -> Phrases:
        word, count = np.unique(self.ids, return_counts=True)
        lo = np.cumsum(count) - count
        real = word > 0
        return Phrases(word[real][:, None].astype(np.int64), lo[real], lo[real], count[real])

    def extended(self, p: Phrases, to_left: bool) -> Phrases:
        """All phrases of one word more at one side."""
        index, here, there = (self.forward, p.lo, p.back) if to_left else (self.backward, p.back, p.lo)
        total = int(p.count.sum())
        first = np.cumsum(p.count) - p.count
        owner = np.repeat(np.arange(len(p.count)), p.count)
        near = index.bwt[np.arange(total) + (here - first)[owner]].astype(np.int64)
        width = int(near.max()) + 1 if total else 1
        # equal neighbours of a phrase together: the places before a group, among those of its phrase, move the other interval
        key, count = np.unique(owner * width + near, return_counts=True)
        at = np.cumsum(count) - count
        owner, word = key // width, key % width
        there = there[owner] + at - first[owner]
        here = index.step(word, here[owner])
        real = word > 0
        words = np.column_stack([word, p.words[owner]] if to_left else [p.words[owner], word])
        lo, back = (here, there) if to_left else (there, here)
        return Phrases(words[real], lo[real], back[real], count[real])


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes as they are, or in parts of about ``most`` bytes that end where pieces end."""
    if len(data) < 2 * most:
        yield data, offsets
        return
    ends = np.flatnonzero(PIECE_END[data]) + 1
    begin = 0
    while begin < len(data):
        k = int(np.searchsorted(ends, begin + most))
        end = int(ends[k]) if k < len(ends) else len(data)
        yield data[begin:end], np.clip(offsets, begin, end) - begin
        begin = end


def shards(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: shard, ids (of its texts, packed), and its words with their counts and languages: words, counts, lang_of, langs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for rows, whole, at in chunks(batches, "text", most):
            langs = rows.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            of_row = langs.indices.to_numpy(zero_copy_only=False)
            for data, offsets in _parts(whole, at, most):
                shard = _shard(data, offsets, of_row)
                if shard:
                    words, lang, count, ids = shard
                    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    columns = [pa.array([(part << 32) + done]), pa.array([_packed([ids])], pa.binary()), one(words), one(pa.array(count)), one(pa.array(lang, pa.int32())), pa.array([names], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "ids", "words", "counts", "lang_of", "langs"])
                    done += 1

    lang = F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang")
    return docs.select(lang, "text").mapInArrow(run, "shard long, ids binary, words array<string>, counts array<long>, lang_of array<int>, langs array<string>")


def _shard(data: np.ndarray, offsets: np.ndarray, of_row: np.ndarray) -> tuple | None:
    """Words, their languages (numbers of ``of_row``), their counts, and the ids (from 1) of all texts with 0 where pieces end."""
    starts, ends, of_text = word_spans(data, offsets, IN_WORD)
    if not len(starts):
        return None
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.ascontiguousarray(LOWER[data[IN_WORD[data]]])
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    lang = np.repeat(of_row, np.diff(of_text)).astype(np.int64)
    width = len(coded.dictionary)
    key, ids, count = np.unique(lang * width + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
    words = coded.dictionary.take(pa.array(key % width)).cast(pa.string(), safe=False)
    after = np.zeros(len(starts) - 1, dtype=bool)
    before = np.searchsorted(starts, np.flatnonzero(PIECE_END[data]))  # words before each end of a piece
    after[before[(before > 0) & (before < len(starts))] - 1] = True
    after[of_text[1:-1][(of_text[1:-1] > 0) & (of_text[1:-1] < len(starts))] - 1] = True
    ids = np.insert(ids.astype(np.uint32) + 1, np.flatnonzero(after) + 1, 0)
    return words, (key // width).astype(np.int32), count, ids


def _chains(ids: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """The parts of a text where two or more places in a row hold (``there``) a phrase of ``size`` words, each with a 0 behind it."""
    edge = np.diff(np.concatenate([[0], there.astype(np.int8), [0]]))
    first, count = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    first, count = first[count > 1], count[count > 1]
    width = count + size
    begin = np.cumsum(width) - width
    at = np.arange(int(width.sum())) - np.repeat(begin - first, width)
    out = ids[np.minimum(at, len(ids) - 1)]
    out[begin + width - 1] = 0
    return out


def _holds(ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each place of a text whether one of the phrases (a row each) begins there."""
    n, size = grams.shape
    places = len(ids) - size + 1
    if places < 1 or not n:
        return np.zeros(max(places, 0), dtype=bool)
    code = np.concatenate([grams[:, 0], ids[:places]]).astype(np.int64)
    for k in range(1, size):
        code = code << 32 | np.concatenate([grams[:, k], ids[k : k + places]])
        code = np.unique(code, return_inverse=True)[1]
    known = np.zeros(int(code.max()) + 1, dtype=bool)
    known[code[:n]] = True
    return known[code[n:]]


#: A row is a part of a shard's phrases (those of a bucket, packed with their counts), or the shard itself: what is left of its text and the
#: numbers of its words.
_ROWS = "shard long, bucket int, grams binary, ids binary, words binary"
_SCHEMA = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("ids", pa.binary()), ("words", pa.binary())])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers under 2**32, bytes of equal weight together, compressed."""
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    """The columns of :func:`_packed`, a row each."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)


def _grown(number: int, ids: np.ndarray, words: np.ndarray, size: int, go_on: bool, buckets: int) -> pa.Table:
    """All phrases of ``size`` words of a text (ids from 1 into ``words``), and the text."""
    used, ids = np.unique(np.concatenate([[0], ids]), return_inverse=True)
    ids, words = ids[1:].astype(np.uint32), words[used[1:].astype(np.int64) - 1]
    if not len(ids):
        return _SCHEMA.empty_table()
    index = BidirectionalIndex(ids, size)
    now = index.single_words()
    for k in range(2, size + 1):
        now = index.extended(now, to_left=k % 2 == 1)
    del index
    columns = [words[now.words[:, k] - 1] for k in range(size)]
    mixed = np.zeros(len(now.count), dtype=np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * _SPREAD
        mixed ^= mixed >> np.uint64(29)
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    columns = [c[order] for c in [*columns, now.count]]
    grams = [_packed([c[i:j] for c in columns]) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)])]
    n = len(grams)
    del columns, now
    rows = [pa.array(np.full(n, number)), pa.array(some, pa.int32()), pa.array(grams, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
    out = [pa.Table.from_arrays(rows, schema=_SCHEMA)]
    if go_on:
        out.append(pa.Table.from_pylist([{"shard": number, "ids": _packed([ids]), "words": _packed([words])}], schema=_SCHEMA))
    return pa.concat_tables(out)


def _sums(grams: list[bytes], size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a bucket from all shards (columns, a phrase once for each shard), their order by words, where a phrase is first in it, and its
    count there; 0 if that is less than ``least``."""
    all_ = np.concatenate([_unpacked(g, size + 1) for g in grams], axis=1)
    order = np.lexsort(all_[:size][::-1])
    first = np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in all_[:size]], axis=0)])
    total = np.add.reduceat(all_[size][order], np.flatnonzero(first))
    return all_, order, first, np.where(total >= least, total, 0)


def _in_buckets(grown: DataFrame, buckets: int):
    """Packed phrases grouped by their buckets.  A bucket has about a shard's phrases."""
    return grown.where("grams is not null").select("shard", "bucket", "grams").repartition(buckets, "bucket").groupBy("bucket")


def _summed(grown: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """w0, w1, ..., a: the phrases whose counts in all shards come to ``least``."""
    w = [f"w{k}" for k in range(size)]

    def run(parts: pa.Table) -> pa.Table:
        all_, order, first, total = _sums(parts["grams"].to_pylist(), size, least)
        at = order[first][total > 0]
        return pa.table({c: all_[k][at] for k, c in enumerate(w)} | {"a": total[total > 0]})

    return _in_buckets(grown, buckets).applyInArrow(run, ", ".join(f"{c} long" for c in [*w, "a"]))


def _held_phrases(grown: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """of (a shard), grams: the phrases of :func:`_summed` that the shard holds, packed, some for each bucket.  Buckets tell it: rows of single
    phrases need not be joined."""

    def run(parts: pa.Table) -> pa.Table:
        grams = parts["grams"].to_pylist()
        all_, order, first, total = _sums(grams, size, least)
        kept = np.empty(len(order), dtype=bool)
        kept[order] = (total > 0)[np.cumsum(first) - 1]
        ends = np.cumsum([_unpacked(g, size + 1).shape[1] for g in grams]).tolist()
        out = [(of, all_[:size, i:j][:, kept[i:j]]) for of, i, j in zip(parts["shard"].to_pylist(), [0, *ends], ends)]
        out = [(of, _packed(list(columns))) for of, columns in out if columns.size]
        return pa.table({"of": pa.array([of for of, _ in out], pa.int64()), "grams": pa.array([g for _, g in out], pa.binary())})

    return _in_buckets(grown, buckets).applyInArrow(run, "of long, grams binary")


def _pairs(number: int, old: np.ndarray, words: np.ndarray, *how) -> pa.Table:
    """All pairs of frequent words of a shard; ``words`` has the number of each of its own words, or -1."""
    known = np.unique(words[words >= 0])
    new = np.zeros(len(words) + 1, dtype=np.uint32)
    new[1:] = np.where(words >= 0, np.searchsorted(known, words) + 1, 0)
    ids = new[old]
    return _grown(number, _chains(ids, ids > 0, 1), known, 2, *how)


def _longer(number: int, ids: np.ndarray, words: np.ndarray, grams: np.ndarray, *how) -> pa.Table:
    """All phrases of one word more than ``grams``, the frequent ones (a row each), both of whose parts are among them."""
    at = np.minimum(np.searchsorted(words, grams), len(words) - 1)
    grams = (at + 1)[(words[at] == grams).all(axis=1)]
    return _grown(number, _chains(ids, _holds(ids, grams), grams.shape[1]), words, grams.shape[1] + 1, *how)


def _numbers(column: pa.Array, at: int, dtype) -> np.ndarray:
    return _unpacked(column[at].as_buffer(), 1)[0].astype(dtype, copy=False)


def _mapped(left: DataFrame, frequent: Broadcast, size: int, go_on: bool, buckets: int) -> DataFrame:
    """A round in which every task knows all frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids = batch.column("shard")[i].as_py(), _numbers(batch.column("ids"), i, np.uint32)
                if size == 2:
                    names = batch.column("langs")[i].values.take(batch.column("lang_of")[i].values)
                    own = pc.binary_join_element_wise(names, batch.column("words")[i].values, "\t")
                    out = _pairs(number, ids, pc.index_in(own, value_set=known).fill_null(-1).to_numpy().astype(np.int64), go_on, buckets)
                else:
                    out = _longer(number, ids, _numbers(batch.column("words"), i, np.int64), known, go_on, buckets)
                yield from out.to_batches()

    return left.mapInArrow(run, _ROWS)


def _met(left: DataFrame, held: DataFrame, size: int, go_on: bool, buckets: int) -> DataFrame:
    """A round in which a shard meets the frequent phrases that it holds."""

    def run(shard: pa.Table, frequent: pa.Table) -> pa.Table:
        if not shard.num_rows or not frequent.num_rows:
            return _SCHEMA.empty_table()
        number, ids = shard["shard"][0].as_py(), _numbers(shard["ids"], 0, np.uint32)
        if size == 2:
            words = np.full(len(shard["words"][0].values), -1)
            words[frequent["id"].to_numpy()] = frequent["word"].to_numpy()
            return _pairs(number, ids, words, go_on, buckets)
        grams = np.concatenate([_unpacked(g, size - 1) for g in frequent["grams"].to_pylist()], axis=1).T
        return _longer(number, ids, _numbers(shard["words"], 0, np.int64), grams, go_on, buckets)

    of_shard = lambda df, key: df.repartition(buckets, key).groupBy(key)
    return of_shard(left, "shard").cogroup(of_shard(held, "of")).applyInArrow(run, _ROWS)


def _numbered(f: DataFrame) -> DataFrame:
    """Rows with ``word``, a number from 0 without gaps."""
    f = stored(f.withColumn("row", F.monotonically_increasing_id()), like="frequent1")
    part = F.shiftright("row", 33)
    # one row for each partition that was written
    sizes = f.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(W.orderBy("part")) - F.col("rows"))
    out = f.withColumn("part", part).join(sizes.select("part", "before"), "part")
    return stored(out.select("lang", "phrase", "a", (F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("word")), like="words")


def mined(docs: DataFrame, least: int = LEAST, most: int = WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n of all words), (word, lang, phrase) of the words with at least ``least`` occurrences, and (g, a): words and phrases
    of up to ``most`` words, as lists of word numbers, with at least as many."""
    spark = docs.sparkSession
    left = stored(shards(docs, shard_bytes), like="shards", rows_per_file=1)
    each = left.select("shard", "langs", F.posexplode(F.arrays_zip("words", "counts", "lang_of")).alias("id", "x"))
    rows = each.select("shard", "id", F.get("langs", F.col("x.lang_of")).alias("lang"), F.col("x.words").alias("phrase"), F.col("x.counts").alias("count"))
    totals = stored(rows.groupBy("lang").agg(F.sum("count").alias("n")), like="totals")
    words = _numbered(rows.groupBy("lang", "phrase").agg(F.sum("count").alias("a")).where(F.col("a") >= least))
    known = words.select(F.array("word").alias("g"), "a")
    # phrases are summed in as many buckets as the session has shuffle partitions, or one for each shard
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), left.count())
    frequent = words
    for size in range(2, most + 1):
        go_on = size < most
        w = [f"w{k}" for k in range(size)]
        n, width = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)) if size == 2 else F.lit(0)).first()
        if n <= KNOWN_TO_ALL and width <= 32 * KNOWN_TO_ALL:
            grown = _mapped(left, spark.sparkContext.broadcast(_collected(frequent, size)), size, go_on, buckets)
        else:
            grown = _met(left, _held_words(rows, frequent) if size == 2 else _held_phrases(grown, size - 1, least, buckets), size, go_on, buckets)
        grown = stored(grown, like=f"phrases{size}", rows_per_file=SHARDS_IN_FILE * (buckets + 1)) if go_on else grown
        frequent = stored(_summed(grown, size, least, buckets), like=f"frequent{size}")
        known = known.unionByName(frequent.select(F.array(*w).alias("g"), "a"))
        left = grown.where("ids is not null").select("shard", "ids", "words")
    return totals, words.select("word", "lang", "phrase"), known


def _collected(frequent: DataFrame, size: int):
    """All frequent words by number, or all frequent phrases as rows of numbers: at most ``KNOWN_TO_ALL`` of them."""
    if size == 2:
        return frequent.orderBy("word").select(F.concat("lang", F.lit("\t"), "phrase").alias("key")).toArrow()["key"].combine_chunks()
    return np.column_stack([c.to_numpy() for c in frequent.select(*(f"w{k}" for k in range(size - 1))).toArrow().columns])


def _held_words(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """of (a shard), id, word: the frequent words that the shard holds."""
    w = ["lang", "phrase"]
    maybe = may_be_among(frequent.select(F.xxhash64(*w).alias("key")), "key")
    f = frequent.select(*(F.col(c).alias(f"f_{c}") for c in w), "word")
    on = functools.reduce(Column.__and__, (F.col(c) == F.col(f"f_{c}") for c in w))
    return rows.where(maybe(F.xxhash64(*w))).join(f, on).select(F.col("shard").alias("of"), "id", "word")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)); a, n, l and r are under 2**57, so that both products fit 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    product = (wide(a) * wide(n)).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, most: int = WORDS, reported: int = REPORTED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``reported`` best phrases."""
    totals, words, known = mined(docs, least, most, shard_bytes)
    size = F.size("g")
    # a phrase goes if one with a word more, before or after, occurs as often
    shorter = known.where(size > 2).select(F.col("a").alias("o_a"), F.explode(F.array(F.slice("g", 2, size - 1), F.slice("g", 1, size - 1))).alias("o_g"))
    shorter = shorter.groupBy("o_g").agg(F.max("o_a").alias("o_a"))
    found = known.where(size > 1).join(shorter, (F.col("g") == F.col("o_g")) & (F.col("o_a") >= F.col("a")), "left_anti")
    cuts = found.select("g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    for part, count in ((F.slice("g", F.lit(1), F.col("cut")), "l"), (F.slice("g", F.col("cut") + 1, size), "r")):
        counts = known.select(F.col("g").alias("k_g"), F.col("a").alias(count))
        cuts = cuts.withColumn("part", part).join(counts, F.col("part") == F.col("k_g")).drop("k_g", "part")
    # a phrase's words are of one language
    of_lang = words.join(totals, "lang").select(F.col("word").alias("t_word"), "n")
    cuts = cuts.join(of_lang, F.get("g", F.lit(0)) == F.col("t_word")).withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = stored(cuts.groupBy("g").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m")).select("g", "m.*"), like="lowest")
    texts = lowest.select("g", F.posexplode("g").alias("at", "of_word")).join(words, F.col("of_word") == F.col("word"))
    texts = texts.groupBy("g").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "phrase"))), lambda x: x["phrase"]), " ").alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    named = lowest.join(texts, "g").withColumn("rank", rank.cast("long"))
    return named.where(F.col("rank") <= reported).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def oracle(least: int = LEAST, most: int = WORDS, reported: int = REPORTED) -> str:
    """The registered form in DuckDB SQL."""
    return rf"""
with pieces as (
  select coalesce(lang, '{UNKNOWN_LANG}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
each as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, range(1, {most + 1}) t(k)),
f as materialized (select lang, k, phrase, count(*) as a from each group by all having count(*) >= {least}),
found as (
  select * from f where k >= 2 and not exists (
    select 1 from f longer where longer.lang = f.lang and longer.a = f.a and longer.k > f.k and contains(' ' || longer.phrase || ' ', ' ' || f.phrase || ' '))),
cuts as (select *, string_split(phrase, ' ') as s, unnest(range(1, k)) as cut from found),
scored as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, n, cut, (1000::hugeint * c.a * n) // (x.a::hugeint * y.a) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(s[1:cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(s[cut + 1:], ' ') join total on total.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= {reported}
"""
