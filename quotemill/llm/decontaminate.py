"""Benchmark decontamination with suffix arrays of the training documents.

Each task cuts its documents into shards of a few MB, builds the word suffix array of a shard, and finds every
test suffix in it by binary search.  That yields all occurrences of the windows of ``window`` consecutive test words, from these each document's
longest verbatim match with its location (:func:`contamination`), and the longest match of each test suffix over all
documents (:func:`longest_matches`).  Documents never move: there is no shuffle.

The test set travels to the tasks in blocks of at most ``BLOCK_BYTES`` of text.  A test set of more blocks is
handled by as many passes over the same rows, one after the other.

Defined results: null and empty texts have no words, are never hit and never match; repeated rows are each reported;
an empty test set marks nothing; an item of over two million distinct words is refused; an item without words has no window; columns other than ``doc_id`` and ``text`` pass
through :func:`remove_contaminated` unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.common import ALNUM, CHUNK_BYTES, LOWER, chunks, text_bytes, word_hashes, word_spans

#: Bytes of test text that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
WINDOW = 10
_BITS = np.uint64(21)
#: Slots of tie groups that are compared to their ends at once.
_PAIRS = 1 << 18
#: Distinct words of a shard that ranks of ``_BITS`` bits can tell apart; beyond it, words that no item holds count as none.
_MOST = (1 << 21) - 2

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: A document's longest match: words, item, where it starts in the item and in the document (words, from 0).
LONGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType())])


class TestBlock:
    """The words of one block of test items, their windows, and which items hold each distinct window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        column = pa.array([t for _, t in items], type=pa.string())
        data, offsets = text_bytes(column)
        starts, ends, first = word_spans(data, offsets, ALNUM)
        self.words = word_hashes(data, starts, ends)
        self.first, self.items, self.window = first, [i for i, _ in items], window
        low = LOWER[data].tobytes()
        self.vocabulary = np.unique(self.words)
        found: dict[bytes, tuple[int, int, set[str], list[int]]] = {}
        for k, (item, _) in enumerate(items):
            n = int(first[k + 1] - first[k])
            for at in range(int(first[k]), int(first[k]) + (max(n - window + 1, 1) if n else 0)):
                size = min(n, window)
                text = b" ".join(low[starts[i] : ends[i]] for i in range(at, at + size))
                own = found.setdefault(text, (at, size, set(), []))
                own[2].add(item)
                own[3].append(at)
        self.texts = list(found)
        self.at = np.array([x[0] for x in found.values()], dtype=np.int64)
        self.size = np.array([x[1] for x in found.values()], dtype=np.int64)
        self.owners = [sorted(x[2]) for x in found.values()]
        # every place of each window
        self.places = np.array([at for x in found.values() for at in x[3]], dtype=np.int64)
        self.place_at = np.concatenate([[0], np.cumsum([len(x[3]) for x in found.values()], dtype=np.int64)])


class Shard:
    """The suffix array of the words of a few documents; suffixes are ordered by their first twelve words and end with
    their document."""

    DEPTH = 12

    def __init__(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None):
        """``known``: sorted hashes of the test words."""
        self.low = LOWER[data]
        self.starts, self.ends, self.first = word_spans(data, offsets, ALNUM)
        words, n = word_hashes(data, self.starts, self.ends), len(self.starts)
        self.n_words = np.diff(self.first)
        # one blank after each document; position of word i of document d: i + d
        self.at = np.arange(n) + np.repeat(np.arange(len(self.n_words)), self.n_words)
        order = np.argsort(words)
        ranked = words[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.vocabulary = ranked[new]
        number = np.cumsum(new)
        if len(self.vocabulary) > _MOST:
            wanted = np.isin(self.vocabulary, known)
            self.vocabulary = self.vocabulary[wanted]
            number = np.where(wanted, np.cumsum(wanted), 0)[number - 1]
        rank = np.zeros(n + len(self.n_words) + self.DEPTH + 3, dtype=np.uint64)
        rank[self.at[order]] = number.astype(np.uint64)
        self.rank = rank
        # three words in one number, then ties are broken by the next three, then by the next six
        self.key = (rank[:-2] << (_BITS + _BITS)) | (rank[1:-1] << _BITS) | rank[2:]
        places = self.at[rank[self.at] > 0]
        n = len(places)
        own = self.key[places]
        order = np.argsort(own)
        self.suffixes = places[order]
        size = len(rank)
        level = np.zeros(size, dtype=np.int64)
        same = own[order][1:] == own[order][:-1]
        for step in (3, 6):
            dense = np.zeros(n, dtype=np.int64)
            dense[1:] = np.cumsum(~same)
            level[self.suffixes] = dense + 1
            tied = np.zeros(n, dtype=bool)
            tied[1:] |= same
            tied[:-1] |= same
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            positions = self.suffixes[slots]
            ahead = level[np.minimum(positions + step, size - 1)]
            pair = (dense[slots].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
            inner = np.argsort(pair)
            self.suffixes[slots] = positions[inner]
            pair = pair[inner]
            equal = np.zeros(n, dtype=bool)
            equal[slots[1:]] = (pair[1:] == pair[:-1]) & (slots[1:] == slots[:-1] + 1)
            same = equal[1:]
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def keys_of(self, words: np.ndarray) -> np.ndarray:
        """The shard's rank of each word, 0 where the shard lacks it."""
        if not len(self.vocabulary):
            return np.zeros(len(words), dtype=np.uint64)
        slot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[slot] == words, slot + 1, 0).astype(np.uint64)

    def bounds(self, ranks: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the suffix array that start with ranks[at : at + size], at most twelve words each."""
        padded = np.concatenate([ranks, np.zeros(self.DEPTH, dtype=np.uint64)])
        grid = padded[at[:, None] + np.arange(self.DEPTH)]
        beyond = np.arange(self.DEPTH) >= size[:, None]
        full = np.uint64((1 << 21) - 1)
        pack = lambda g: [(g[:, i] << (_BITS + _BITS)) | (g[:, i + 1] << _BITS) | g[:, i + 2] for i in (0, 3, 6, 9)]
        return self._bound(pack(np.where(beyond, 0, grid)), True), self._bound(pack(np.where(beyond, full, grid)), False)

    def _bound(self, wanted: list[np.ndarray], low: bool) -> np.ndarray:
        lo, hi = np.zeros(len(wanted[0]), dtype=np.int64), np.full(len(wanted[0]), len(self.suffixes), dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            p = self.suffixes[np.minimum(mid, len(self.suffixes) - 1)]
            less, tie = np.zeros(len(p), dtype=bool), np.ones(len(p), dtype=bool)
            for k, want in enumerate(wanted):
                have = self.key[np.minimum(p + 3 * k, len(self.key) - 1)]
                less |= tie & (have < want)
                tie &= have == want
            go = less if low else less | tie
            lo, hi = np.where(open_ & go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def word(self, positions: np.ndarray) -> np.ndarray:
        """The word number of each position."""
        return np.searchsorted(self.at, positions)

    def hits(self, test: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of test windows: (word number in the shard, window number); bytes are compared."""
        ranks = self.keys_of(test.words)
        known = np.zeros(len(ranks) + 1, dtype=np.int64)
        np.cumsum(ranks > 0, out=known[1:])
        full = np.flatnonzero(known[test.at + test.size] - known[test.at] == test.size)
        if not len(full) or not len(self.suffixes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lo, hi = self.bounds(ranks, test.at[full], test.size[full])
        count = hi - lo
        window = np.repeat(full, count)
        slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        word = self.word(self.suffixes[slot])
        raw = self.low.tobytes() if len(word) else b""
        sure = [b" ".join(raw[self.starts[i] : self.ends[i]] for i in range(w, w + test.size[k])) == test.texts[k] for w, k in zip(word.tolist(), window.tolist(), strict=True)]
        sure = np.array(sure, dtype=bool)
        return word[sure], window[sure]

    def longest(self, test: TestBlock, doc_order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the length in words of its longest match here, and the word where it starts (-1: none);
        of several, the one in the first document by ``doc_order`` (numbers, as they come if not given), then the first.

        A suffix that no slot shares twelve words with is decided by its neighbours; of those that some share them
        with, all such slots are compared to their ends."""
        ranks, n, size = self.keys_of(test.words), len(test.words), len(self.suffixes)
        length, where = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        if not size or not n:
            return length, where
        left = np.repeat(test.first[1:], np.diff(test.first)) - np.arange(n)
        # no match goes beyond a word that the shard lacks
        lacking = np.where(ranks == 0, np.arange(n), n)
        left = np.minimum(left, np.minimum.accumulate(lacking[::-1])[::-1] - np.arange(n))
        place, after = self.bounds(ranks, np.arange(n), np.minimum(left, self.DEPTH))
        for slots in (place - 1, place):
            some = np.flatnonzero((place == after) & (slots >= 0) & (slots < size))
            length[some] = np.maximum(length[some], self._run(ranks, some, self.suffixes[slots[some]], left[some]))
        tied = place < after
        length[tied] = np.minimum(left[tied], self.DEPTH)
        document = self.doc if doc_order is None else doc_order[self.doc]
        words = len(self.starts)
        order = np.lexsort((np.arange(words), document))
        priority = np.empty(words, dtype=np.int64)
        priority[order] = np.arange(words)
        priority = np.append(priority[self.word(self.suffixes)], words)
        # all slots that share the length, up to twelve words
        some = np.flatnonzero(length)
        if len(some):
            lo, hi = self.bounds(ranks, some, np.minimum(length[some], self.DEPTH))
            where[some] = order[np.minimum.reduceat(priority, np.stack([lo, hi], axis=1).ravel())[::2]]
        deep = np.flatnonzero(tied & (left > self.DEPTH))
        total = np.cumsum(after[deep] - place[deep])
        for part in np.split(deep, np.flatnonzero(np.diff(total // _PAIRS)) + 1) if len(deep) else []:
            count = after[part] - place[part]
            first = np.cumsum(count) - count
            slot = np.arange(count.sum()) + np.repeat(place[part] - first, count)
            run = self._run(ranks, np.repeat(part, count), self.suffixes[slot], np.repeat(left[part], count))
            length[part] = np.maximum.reduceat(run, first)
            best = np.minimum.reduceat(np.where(run == np.repeat(length[part], count), priority[slot], words), first)
            where[part] = order[best]
        return length, where

    def _run(self, ranks: np.ndarray, at: np.ndarray, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Equal words from test word ``at`` and from position ``p`` on, ``left`` at most."""
        run, live = np.zeros(len(at), dtype=np.int64), np.flatnonzero(left > 0)
        while len(live):
            live = live[ranks[at[live] + run[live]] == self.rank[p[live] + run[live]]]
            run[live] += 1
            live = live[run[live] < left[live]]
        return run


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[TestBlock]:
    """The test set in blocks of bounded size; each is fetched when it is asked for."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = named if n == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield from _fitting(sorted((r["item"], r["text"]) for r in part.collect()), window)


def _fitting(items: list[tuple[str, str]], window: int) -> Iterator[TestBlock]:
    block = TestBlock(items, window)
    if len(block.vocabulary) <= _MOST:
        yield block
    elif len(items) == 1:
        raise ValueError(f"item {items[0][0]} has over {_MOST} distinct words")
    else:
        yield from _fitting(items[: len(items) // 2], window)
        yield from _fitting(items[len(items) // 2 :], window)


test_blocks.__test__ = False


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, and what the test set covers in each text: ``n_words``, ``spans``
    (maximal runs of hit words, from 0, end excluded), ``items`` (ids of items with occurring windows) and ``longest``, the longest match of a window
or more (or of a whole shorter item): of several the first in the document, then the smallest item, then its first place."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return _contamination(docs.select(row, docs["text"].alias("text")), benchmark, window, block_bytes)


def _contamination(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows``: row (anything) and text."""
    more = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", LONGEST)]
    schema = T.StructType([*rows.schema.fields, *more])
    out = rows.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(None).cast(LONGEST).alias("longest"))
    for block in test_blocks(benchmark, window, block_bytes):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in chunks(batches, "text", CHUNK_BYTES):
                found = _marked(sent.value, Shard(data, offsets, sent.value.vocabulary), part)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *found], names=schema.names)

        out = out.mapInArrow(mark, schema)
    return out.drop("text")


def _marked(test: TestBlock, shard: Shard, rows: pa.RecordBatch) -> list[pa.Array]:
    """n_words, spans, items and longest of one shard, with what earlier blocks of the test set have found in the same rows."""
    word, window = shard.hits(test)
    cover = np.zeros(len(shard.starts) + 1, dtype=np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + test.size[window], -1)
    hit = np.cumsum(cover)[:-1] > 0
    items: dict[int, set[str]] = {}
    for d, k in set(zip(shard.doc[word].tolist(), window.tolist(), strict=True)):
        items.setdefault(d, set()).update(test.owners[k])
    spans, names = rows.column("spans").to_pylist(), rows.column("items").to_pylist()
    for d, new in items.items():
        own = hit[shard.first[d] : shard.first[d + 1]].copy()
        for x in spans[d]:
            own[x["start"] : x["end"]] = True
        step = np.diff(own.astype(np.int8), prepend=0, append=0)
        spans[d] = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
        names[d] = sorted(new | set(names[d]))
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    best = rows.column("longest").to_pylist()
    order = lambda x: (-x["n_words"], x["doc_word"], x["item"], x["item_word"])
    for d, new in _longest_of_documents(test, shard, word, window).items():
        best[d] = new if best[d] is None else min(best[d], new, key=order)
    kind = pa.struct([("n_words", pa.int64()), ("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64())])
    return [pa.array(shard.n_words, pa.int64()), pa.array(spans, pairs), pa.array(names, pa.list_(pa.string())), pa.array(best, kind)]


def _longest_of_documents(test: TestBlock, shard: Shard, word: np.ndarray, window: np.ndarray) -> dict[int, dict]:
    """Each hit document's longest match: hits that follow each other in document and item are one match."""
    out: dict[int, dict] = {}
    if not len(word):
        return out
    order = np.argsort(word, kind="stable")
    word, window = word[order], window[order]
    owner = np.repeat(np.arange(len(test.items)), np.diff(test.first))
    by_id = np.argsort(np.argsort(np.array(test.items, dtype=object), kind="stable"), kind="stable")
    count = np.diff(test.place_at)[window]
    doc = shard.doc[word]
    edge = np.flatnonzero(np.diff(doc)) + 1
    # whole documents, about _PAIRS places at a time
    cuts = edge[np.flatnonzero(np.diff(np.cumsum(count)[edge - 1] // (16 * _PAIRS), prepend=0))]
    for own in np.split(np.arange(len(word)), cuts):
        n = count[own]
        w, k = np.repeat(word[own], n), np.repeat(window[own], n)
        t = test.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(test.place_at[window[own]], n)]
        order = np.lexsort((w, t - w))
        w, t, size = w[order], t[order], test.size[k[order]]
        full = size == test.window
        follows = np.zeros(len(w), dtype=bool)
        follows[1:] = full[1:] & full[:-1] & (w[1:] == w[:-1] + 1) & (t[1:] == t[:-1] + 1)
        head = np.flatnonzero(~follows)
        length = np.diff(np.append(head, len(w))) - 1 + size[head]
        w, t = w[head], t[head]
        d = shard.doc[w]
        best = np.lexsort((t, by_id[owner[t]], w, -length, d))
        best = best[np.concatenate([[True], d[best][1:] != d[best][:-1]])]
        for i in best.tolist():
            o = int(owner[t[i]])
            out[int(d[i])] = {"n_words": int(length[i]), "item": test.items[o], "item_word": int(t[i] - test.first[o]), "doc_word": int(w[i] - shard.first[d[i]])}
    return out


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of its longest match longest_words (0 if none),
    longest_item, longest_item_word and longest_doc_word."""
    found = _contamination(docs.select(docs["doc_id"].alias("row"), docs["text"].alias("text")), benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        F.col("row").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("longest.n_words", F.lit(0).cast("long")).alias("longest_words"),
        F.col("longest.item").alias("longest_item"), F.col("longest.item_word").alias("longest_item_word"), F.col("longest.doc_word").alias("longest_doc_word"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test window."""
    return contamination(docs, benchmark, window).where(F.size("spans") == 0).select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix (item, word number) that occurs at all: its longest verbatim match over all shards, as
    n_words, doc_id and the document's word number.  Ties go to the smallest doc_id, then the first word."""
    schema = "item_id string, item_word long, n_words long, doc_id long, doc_word long"
    parts = []
    for block in test_blocks(benchmark, WINDOW, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            test = sent.value
            owner = np.repeat(np.arange(len(test.items)), np.diff(test.first))
            for rows, data, offsets in chunks(batches, "text", CHUNK_BYTES):
                shard = Shard(data, offsets, test.vocabulary)
                order = pc.rank(rows.column("doc_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
                length, where = shard.longest(test, order)
                some = np.flatnonzero(length)
                doc = shard.doc[where[some]]
                ids = rows.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array([test.items[owner[i]] for i in some], pa.string()), pa.array(some - test.first[owner[some]], pa.int64()), pa.array(length[some], pa.int64()), ids.cast(pa.int64()), pa.array(where[some] - shard.first[doc], pa.int64())], names=["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        parts.append(docs.select("doc_id", "text").mapInArrow(find, schema))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word"))
    return out.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_word")
