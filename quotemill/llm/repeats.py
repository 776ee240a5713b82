"""Removal of repeated passages with run-length (r-index) shards.

A byte goes if a ``LENGTH``-byte string covers it that also starts earlier: in a document of smaller doc_id, or earlier in the same
one.  Three steps make a corpus-wide index unnecessary:

1. *Anchors.*  Every window of ``LENGTH`` bytes picks one of its ``GRAM``-byte grams by hash (leftmost minimum), so equal windows
   pick the same gram at the same place.  Successive windows with one anchor form a region, described by a few numbers; about one
   row for 35 bytes is shuffled, never the text.  Grams that are frequent in a bounded sample of texts are
   picked only by windows that have no other, so that a common line does not gather its surroundings in one task; the sample decides where work
   is done and never what is found.  Equal regions are combined before the shuffle.
2. *Equal regions.*  Regions that meet under an anchor and are equal as a whole yield removed spans at once, all but the first.
   Anchors that occur once end here.
3. *Run-length index.*  Where one anchor has different regions, their bytes are fetched and gathered into shards of bounded size.  A shard's
   suffixes are sorted, its Burrows-Wheeler transform is kept as runs with the suffix positions at the run ends, and the regions
   are streamed through it from right to left in lockstep, one LF step a byte.  That gives each window the rows that share its
   first ``LENGTH`` bytes; the earliest of them is located by stepping from run end to run end (phi), and all later windows are marked.
   No index takes more than ``BUSY`` regions of one anchor: windows under busier anchors are compared by MD5 in an aggregation, with
   the same result, so no task holds a hot passage's surroundings.

Defined results: null and empty texts keep nothing and lose nothing; rows of one doc_id with equal texts are one document and do not remove each
other, rows of one doc_id with different texts are documents of their own, ordered by the MD5 of their texts; a null doc_id counts as smaller than
all others; texts shorter than ``LENGTH`` bytes stay whole.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import bounded_sample, chunks, key_runs, stored, text_bytes

LENGTH = 100
GRAM = 32
#: Documents of the sample for frequent grams, and how many of them must hold a gram.
SAMPLE, FREQUENT = 2_000, 20
#: Bytes of regions in one index.
SHARD_BYTES = 1 << 19
#: Different regions of one anchor that one index still takes (3 MB of bytes at most); windows of busier anchors meet by aggregation.
BUSY = 20_000
_SPREAD = 8  # chunks whose equal regions are combined before the shuffle
_AT = 30  # bits of a position within a chunk
_CODE = np.random.default_rng(100).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
NO_ID = -(2**63)


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 21), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes (a power of two) from each position."""
    h, size = _CODE[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_P, size, 2**64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return _mix(h)


def frequent_grams(docs: DataFrame, sample: int = SAMPLE, least: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the grams that at least ``least`` of ``sample`` texts hold."""
    some = bounded_sample(docs.select("doc_id"), ["doc_id"], sample).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi").select("text")  # at most 2 * sample ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "text", 1 << 20):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram_hashes(data[a:b])).astype(np.int64))], names=["gram"])

    found = some.mapInArrow(run, "gram long").groupBy("gram").count().where(F.col("count") >= least).select("gram").toArrow()
    return np.sort(found["gram"].to_numpy().astype(np.uint64)) if found.num_rows else np.zeros(0, dtype=np.uint64)


def regions(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk of texts, per region: text number, start of the first window in its text, number of windows, offset of the anchor, anchor hash
    (49 bits), hash of all bytes (64 bits)."""
    none = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    span = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return none
    h = gram_hashes(data)
    order = h >> np.uint64(64 - 33)
    if len(frequent):
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(frequent >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(frequent, h[maybe]), len(frequent) - 1)
        order[maybe[frequent[slot] == h[maybe]]] |= np.uint64(1 << 33)
    low = (order << np.uint64(_AT)) | np.arange(len(order), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    anchor = (low & np.uint64((1 << _AT) - 1)).astype(np.int64)
    # windows within one text
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - LENGTH + 1, 0)
    total = int(counts.sum())
    if not total:
        return none
    text = np.repeat(np.arange(len(lengths)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    own = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(first, total))
    s0, at = start[first], own[first]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * _power(_P, len(data)), out=sums[1:])
    whole = _mix((sums[s0 + n - 1 + LENGTH] - sums[s0]) * _power(_INV, len(data))[s0])
    return text[first], s0 - offsets[text[first]], n, at - s0, h[at] >> np.uint64(15), whole


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans, touching ones joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # running maximum of ends within a document
    base = np.cumsum(new).astype(np.int64) << 40
    reach = np.maximum.accumulate(base + end)
    new[1:] |= base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - base[last]


_ROWS = "key long, doc long, start int, tail long"


def _combine(key, doc, s0, whole):
    """Order by region and place; True where an equal region starts earlier."""
    order = np.lexsort((s0, doc, whole, key))
    key, doc, s0, whole = key[order], doc[order], s0[order], whole[order]
    same = np.concatenate([[False], (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    later = same & ((doc != doc[head]) | (s0 != s0[head]))
    return key, doc, s0, whole, same, later


def region_rows(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """key, doc, start, tail: regions (key = anchor, offset, windows; tail = hash) and, with a negative key, spans already known to go
    (tail = end)."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        key, doc, s0, whole, same, later = _combine(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        size = (key & 127) + LENGTH - 1
        sd, sa, sb = _merged(doc[later], s0[later], (s0 + size)[later])
        keep = ~same
        spread = -1 - (_mix(sd.astype(np.uint64) * np.uint64(_P)) >> np.uint64(2)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[keep], spread])), pa.array(np.concatenate([doc[keep], sd])), pa.array(np.concatenate([s0[keep], sa]).astype(np.int32)), pa.array(np.concatenate([whole[keep], sb]))], names=["key", "doc", "start", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for rows, data, offsets in chunks(batches, "text"):
            text, s0, n, back, anchor, whole = regions(data, offsets, sent.value)
            if len(text):
                key = (anchor.astype(np.int64) << 14) | (back << 7) | n
                parts.append((key, rows.column("doc").to_numpy()[text], s0, whole.astype(np.int64)))
            if len(parts) == _SPREAD:
                yield from flush(parts)
                parts = []
        if parts:
            yield from flush(parts)

    return texts.mapInArrow(run, _ROWS)


def settle_equal(rows: DataFrame) -> DataFrame:
    """anchor, doc, start, end: spans that go (anchor null) and regions that other regions of their anchor must be compared with.

    Rows come ordered by region and place, so one pass with the last region's first row in hand decides them: nothing of an anchor is
    gathered, however many regions meet under it."""
    names = ["anchor", "doc", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = [np.zeros(0, dtype=np.int64)] * 4, False  # first row of the last region, and whether it was given out
        for batch in batches:
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "start", "tail")]
            known = columns[0] < 0
            spans = [x[known] for x in columns[1:]]
            key, doc, start, tail = (np.concatenate([h, x[~known]]) for h, x in zip(held, columns, strict=True))
            if len(key):
                same = np.concatenate([[False], (key[1:] == key[:-1]) & (tail[1:] == tail[:-1])])
                heads = np.flatnonzero(~same)
                head = heads[np.cumsum(~same) - 1]
                later = same & ((doc != doc[head]) | (start != start[head]))
                end = start + (key & 127) + LENGTH - 1
                spans = [np.concatenate([x, y[later]]) for x, y in zip(spans, (doc, start, end), strict=True)]
                anchor = key[heads] >> 14
                several = np.zeros(len(heads), dtype=bool)
                several[1:] |= anchor[1:] == anchor[:-1]
                several[:-1] |= anchor[1:] == anchor[:-1]
                give = several.copy()
                if sent:  # the held row is the first head: it went out before, and its anchor has others
                    give[0] = False
                    several[0] = True
                held, sent = [x[heads[-1:]] for x in (key, doc, start, tail)], bool(several[-1])
                if give.any():
                    at = heads[give]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[give], doc[at], start[at], end[at])], names=names)
            d, a, b = _merged(*spans)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(a), pa.array(b)], names=names)

    keyed = rows.withColumn("anchor", F.when(F.col("key") < 0, F.col("key")).otherwise(F.shiftright("key", 14))).repartition("anchor")
    ordered = keyed.drop("anchor").sortWithinPartitions("key", "tail", "doc", "start")  # an anchor is the upper part of its keys
    return ordered.mapInArrow(run, "anchor long, doc long, start long, end long")


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of a few thousand short texts, with suffix positions at run ends.

    Texts must come in order of precedence; each is closed by a terminator of its own, smaller than all bytes, in the same order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        m, n = len(lengths), len(data) + len(lengths)
        self.first = offsets[:-1] + np.arange(m)
        self.close = self.first + lengths
        text = np.zeros(n, dtype=np.int64)
        text[np.arange(len(data)) + np.repeat(np.arange(m), lengths)] = data.astype(np.int64) + 1
        self.size = n
        left = np.repeat(self.close, lengths + 1) - np.arange(n)  # bytes before the terminator
        # ranks by 7 bytes, then by twice as many, to LENGTH, then to the terminators
        packed = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([text, np.zeros(8, dtype=np.int64)]).astype(np.uint64)
        for k in range(7):
            packed = (packed << np.uint64(9)) | np.where(left >= k, padded[k : k + n], 0).astype(np.uint64)
        order = np.argsort(packed)
        rank = self._ranks(packed, order)
        depth = 7
        longest = int(lengths.max()) + 1 if m else 1
        capped = None
        while depth < longest or capped is None:
            ahead = min(depth, LENGTH - depth) if capped is None else depth
            if capped is None and depth >= LENGTH:
                ahead = 0
            second = np.where(left >= ahead, np.concatenate([rank, np.zeros(ahead, dtype=np.int64)])[ahead : ahead + n], 0)
            order, rank = self._by_pair(rank, second)
            depth += ahead
            if depth == LENGTH and capped is None:
                capped = rank
        # what is equal up to its terminator is ordered by precedence: ties of the sort go by position
        suffix = order
        before = text[suffix - 1]
        before[suffix == 0] = 0
        starts = np.zeros(n + 1, dtype=bool)
        starts[self.first] = True
        before[starts[suffix]] = 0
        head = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)]))
        self.run_start, self.run_byte = head, before[head]
        self.run_length = np.diff(np.append(head, n))
        # where a run's first row goes under LF
        by_byte = np.argsort(self.run_byte, kind="stable")
        to = np.zeros(len(head), dtype=np.int64)
        to[by_byte] = np.cumsum(self.run_length[by_byte]) - self.run_length[by_byte]
        self.run_to = to
        # samples: suffix positions at run starts, and at the ends of the runs before them
        position = np.argsort(suffix[head])
        self.sample_at = suffix[head][position]
        self.sample_before = np.where(head > 0, suffix[head - 1], -1)[position]
        # rows where a new string of LENGTH bytes begins
        by_row = capped[suffix]
        self.bound = np.flatnonzero(np.concatenate([[True], by_row[1:] != by_row[:-1]]))

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        ranked = keys[order]
        out = np.zeros(len(keys), dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        return out

    @classmethod
    def _by_pair(cls, rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by two ranks, ties by position, and the rank of each pair."""
        n = len(rank)
        if n >= 1 << 20:  # one anchor with very many regions
            pair = (rank.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
            order = np.argsort(pair, kind="stable")
            return order, cls._ranks(pair, order)
        # both ranks and the position fit one number: sorting numbers is several times as fast as sorting indices
        key = (rank << 40) | (second << 20) | np.arange(n)
        key.sort()
        order, key = key & ((1 << 20) - 1), key >> 20
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)]))
        return order, out

    def before(self, rows: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix that is one byte longer."""
        run = np.searchsorted(self.run_start, rows, side="right") - 1
        return self.run_to[run] + rows - self.run_start[run]

    def above(self, positions: np.ndarray) -> np.ndarray:
        """phi: the suffix position in the row above that of each position, from the samples."""
        k = np.searchsorted(self.sample_at, positions, side="right") - 1
        return self.sample_before[k] + positions - self.sample_at[k]

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of all texts, streamed from right to left in lockstep: for each text position the row reached, and the number of rows that
        match in ``LENGTH`` bytes or more (0 where fewer are left in the text)."""
        row_of, matches = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        rows, at = np.arange(len(self.close)), self.close.copy()  # the terminators' rows come first, in order
        live = np.flatnonzero(at > self.first)
        rows, at, stop = rows[live], at[live], self.first[live]
        close = self.close[live]
        edges = np.append(self.bound, self.size)
        while len(rows):
            rows, at = self.before(rows), at - 1
            row_of[at] = rows
            full = np.flatnonzero(close - at >= LENGTH)
            k = np.searchsorted(self.bound, rows[full], side="right") - 1
            matches[at[full]] = edges[k + 1] - edges[k]
            more = at > stop
            if not more.all():
                rows, at, stop, close = rows[more], at[more], stop[more], close[more]
        return row_of, matches

    def later(self) -> np.ndarray:
        """True at each position whose ``LENGTH`` bytes also start at an earlier position."""
        row_of, matches = self.stream()
        some = np.flatnonzero(matches > 1)
        out = np.zeros(self.size, dtype=bool)
        if not len(some):
            return out
        group = np.searchsorted(self.bound, row_of[some], side="right") - 1
        edges = np.append(self.bound, self.size)
        # the window in each group's last row, then upwards by phi
        last = np.flatnonzero(row_of[some] == edges[group + 1] - 1)
        earliest = np.full(len(self.bound), self.size, dtype=np.int64)
        position, g, left = some[last], group[last], matches[some[last]]
        while len(position):
            np.minimum.at(earliest, g, position)
            left = left - 1
            go = left > 0
            position, g, left = self.above(position[go]), g[go], left[go]
        out[some] = some > earliest[group]
        return out


def compare_regions(parts: DataFrame) -> DataFrame:
    """anchor, doc, start, bytes -> doc, start, end of the spans that go."""

    def shard(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables).combine_chunks()
        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        data, offsets = text_bytes(table.column("bytes").take(pa.array(order)))
        index = RunLengthIndex(data, offsets)
        at = np.flatnonzero(index.later())
        which = np.searchsorted(index.first, at, side="right") - 1
        a = start[which] + at - index.first[which]
        d, s, e = _merged(doc[which], a, a + LENGTH)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in key_runs(batches, "anchor"):
            held.append(table)
            size += table.nbytes
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, start long, end long")


def _fetched(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the wanted regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            lists = rows.column("wanted")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(rows.num_rows), n)
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            size = end - start
            to = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(to[-1]) - np.repeat(to[:-1], size) + np.repeat(offsets[row] + start, size)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes())])
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(rows.column("doc").to_numpy()[row]), pa.array(start), raw.cast(pa.binary())], names=["anchor", "doc", "start", "bytes"])

    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("wanted"))
    return texts.dropDuplicates(["doc"]).join(per_doc, "doc").mapInArrow(run, "anchor long, doc long, start long, bytes binary")


def _settled(df: DataFrame, like: str) -> DataFrame:
    """Stored, and the shuffle files of what led to it are given back."""
    out = stored(df, like=like)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and doc, a number in the order of documents: the doc_id itself (``NO_ID`` for null) where no two rows share one, else the place among all
    pairs of doc_id and text."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows
    named = rows.drop("doc").withColumn("md5", F.md5(F.coalesce("text", F.lit(""))))
    order = named.select("doc_id", "md5").distinct().orderBy(F.asc_nulls_first("doc_id"), "md5")
    order = stored(order.select(F.col("doc_id").alias("of"), F.col("md5").alias("of_md5"), F.monotonically_increasing_id().alias("doc")), like="order")
    joined = named.join(order, named["doc_id"].eqNullSafe(order["of"]) & (named["md5"] == order["of_md5"]))
    return stored(joined.select("doc_id", "text", "doc"), like="numbered")


def compare_windows(parts: DataFrame) -> DataFrame:
    """anchor, doc, start, bytes -> doc, start, end of the spans that go: the windows of regions under anchors too busy for one index, each
    known by its MD5 and met by aggregation, which combines equal ones before they are shuffled."""
    at = F.explode(F.sequence(F.lit(1), F.length("bytes") - LENGTH + 1)).alias("at")
    windows = parts.select("doc", "start", "bytes", at).select(
        F.unhex(F.md5(F.substring("bytes", F.col("at"), F.lit(LENGTH)))).alias("window"), F.struct("doc", (F.col("start") + F.col("at") - 1).alias("start")).alias("place")
    )
    first = windows.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("window", "first")
    gone = windows.join(first, "window").where("place > first")
    return gone.select("place.doc", "place.start", (F.col("place.start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, start, end (bytes, end excluded; may overlap) of all repeated passages of :func:`numbered` documents but their first occurrences."""
    texts = docs.select("doc", "text")
    found = _settled(settle_equal(region_rows(texts, frequent_grams(docs))), "regions")
    gone, apart = found.where("anchor is null").select("doc", "start", "end"), found.where("anchor is not null")
    busy = apart.groupBy("anchor").count().where(F.col("count") > BUSY).select("anchor")
    if not busy.isEmpty():
        windows = compare_windows(_fetched(apart.join(busy, "anchor", "left_semi"), texts))
        gone = gone.unionAll(_settled(windows, "windows"))
        apart = apart.join(busy, "anchor", "left_anti")
    return gone.unionAll(_settled(compare_regions(_fetched(apart, texts)), "spans"))


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _with_spans(numbered(docs), False)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` without the repeated passages; broken characters at the edges are dropped."""
    return _with_spans(numbered(docs), True)


def _with_spans(docs: DataFrame, keep_text: bool) -> DataFrame:
    spans = repeated_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            removed, count, kept = [], [], []
            raw = data.tobytes()
            for k, spans in enumerate(rows.column("spans").to_pylist()):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if not spans:
                    removed.append(0), count.append(0), kept.append(raw[a:b])
                    continue
                s, e = np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans])
                _, s, e = _merged(np.zeros(len(s), dtype=np.int64), s, e)
                left = [raw[a + x : a + y] for x, y in zip([0, *e.tolist()], [*s.tolist(), b - a], strict=True)]
                removed.append(int((e - s).sum())), count.append(len(s)), kept.append(b"".join(left))
            if keep_text:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], names=["doc_id", "text"])
            else:
                hashes = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), hashes], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, text string" if keep_text else f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
