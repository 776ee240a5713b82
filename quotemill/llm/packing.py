"""Harmonic packing of tokenised documents into sequences of a fixed capacity C.

Documents are tokenised once; every full C tokens are a piece, and so is the rest.  A piece of length x belongs to the class k = C // x,
lengths from C/(k+1) to C/k, and every bin of a class holds exactly k pieces: bins are places in the class divided by k, which each
worker knows from counts of the classes in the partitions before its own.

A bin keeps a gap, the sum of C/k - x over its pieces.  Gaps are filled by a share of the documents that stay out of the bins: a hash
chooses just enough of them, they are laid end to end as one stream, and the stream is cut where gaps end.  What is left of
the stream makes full sequences, and its end sequences of 2048, 1024, ... tokens as far as needed.  So no token is padded, most documents
stay whole, and pieces of classes that do not fill a last bin (under k of them, fewer than C ln C in all) go to the stream as well.

Running sums over the stream and over the gaps come from sums of partitions and of blocks of bins; the stream meets the gaps in one
window for each C tokens, so the work is linear and no window holds more than 2 C rows.

Tokenising: a text is split at ASCII white space and between ASCII (or Latin-1) letters and ASCII punctuation, where this vocabulary's
own splitting pattern splits as well; each different unit is tokenised once for each task (tests compare with whole texts).

Defined results: null and empty texts are documents of the end id alone; repeated rows and rows that share a doc_id (null as well)
are documents of their own; an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import NONSPACE, byte_table, chunks, stored, word_spans

CAPACITY = 4096
END_ID = 2
#: Bytes of text worked on at once, units that a task remembers, and units tokenised in one call.
CHUNK, REMEMBERED, AT_ONCE = 8 << 20, 1_000_000, 200
#: Hash values among which the share of the stream is chosen.
SHARES = 4096
#: Bins (or blocks of them) of one step of a running sum.
BLOCK = 512

_LETTER = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
#: ASCII punctuation that may be cut off; not the apostrophe of contractions nor the marks of special tokens.
_MARK = byte_table([b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<|>"])
#: Continuation bytes of the letters of Latin-1 (after 0xC3).
_LATIN = byte_table([b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_BREAK = "\x01"


class Units:
    """Ids of the units of texts; a unit is tokenised when it is first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = self._encode([_BREAK])[0]
        self.mark = marks[0] if len(marks) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.starts = np.zeros(1, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units that are tokenised in one text, with a mark of one id between them; one by one where that fails."""
        if self.mark is not None and not any(_BREAK in u for u in units):
            ids = np.array(self._encode([f" {_BREAK} ".join(units)])[0], dtype="<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(units) - 1:
                bounds = [0, *(at + 1).tolist(), len(ids) + 1]
                return [ids[a : b - 1] for a, b in zip(bounds, bounds[1:])]
        return [np.array(ids, dtype="<u4") for ids in self._encode(units)]

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "replace") for u in units]
        found = [x for k in range(0, len(texts), AT_ONCE) for x in self._apart(texts[k : k + AT_ONCE])]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        while len(self.ids) < self.used + int(sizes.sum()):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + int(sizes.sum())] = np.concatenate(found)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.used = int(self.starts[-1])
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units))))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        starts, ends, _ = word_spans(data, offsets, NONSPACE)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets) - 1, dtype=np.int64)
        if len(self.place) > REMEMBERED:
            self._forget()
        cuts = _cuts(data, starts, ends)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        letters = np.ascontiguousarray(data[NONSPACE[data]])
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        new = [u for u in names if u not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter((self.place[u] for u in names), dtype=np.int64, count=len(names))[units.indices.to_numpy()]
        sizes = self.starts[at + 1] - self.starts[at]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[at] - before, sizes) + np.arange(int(sizes.sum()))]
        to = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[to[1:]] - total[to[:-1]]


def _cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places inside words between a letter and a mark, either way round."""
    plain, mark = _LETTER[data], _MARK[data]
    latin = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    last, first = plain.copy(), plain
    last[1:] |= latin
    first[:-1] |= latin
    at = np.flatnonzero((last[:-1] & mark[1:]) | (mark[:-1] & first[1:])) + 1
    word = np.searchsorted(starts, at, side="right") - 1
    return at[(word >= 0) & (at > starts[word]) & (at < ends[word])]


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each full ``capacity`` ids of a document and for its rest: part and i (a number of the row), doc_id, start, length,
    doc_tokens, crc (of the ids as little-endian unsigned 32-bit numbers) and ids (these bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, done = Units(path), TaskContext.get().partitionId(), 0
        for rows, data, offsets in chunks(batches, "text", CHUNK):
            ids, sizes = units.of(data, offsets)
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            n_pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n_pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            length = np.minimum(capacity, sizes[doc] - nth * capacity)
            bounds, raw = np.concatenate([[0], np.cumsum(length)]) * 4, ids.astype("<u4").view(np.uint8)
            view = memoryview(raw)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            packed = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(np.arange(done, done + len(doc))), rows.column("doc_id").take(pa.array(doc)),
                    pa.array(nth * capacity), pa.array(length), pa.array(sizes[doc]), pa.array(crc, pa.int64()), packed.cast(pa.binary()),
                ],
                ["part", "i", "doc_id", "start", "length", "doc_tokens", "crc", "ids"],
            )
            done += len(doc)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"part int, i long, doc_id {kind}, start long, length long, doc_tokens long, crc long, ids binary")


def _with_before(df: DataFrame, at: str, value: str, places: int) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over rows of smaller ``at`` (different numbers from 0 to ``places`` - 1)."""
    def earlier(by: str) -> Column:
        order = W.partitionBy(by).orderBy(at) if by else W.orderBy(at)
        return F.coalesce(F.sum(value).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    if places <= BLOCK:
        return df.withColumn("before", earlier(""))
    rows = df.withColumn("block", F.expr(f"{at} div {BLOCK}"))
    blocks = rows.groupBy(F.col("block").alias("place")).agg(F.sum(value).alias("total"))
    blocks = _with_before(blocks, "place", "total", -(-places // BLOCK)).select(F.col("place").alias("of_block"), F.col("before").alias("in_earlier"))
    rows = rows.join(blocks, F.col("block") == F.col("of_block")).withColumn("before", F.col("in_earlier") + earlier("block"))
    return rows.drop("block", "of_block", "in_earlier")


def _stream_share(base: DataFrame, capacity: int, draw: Column) -> int:
    """The smallest bound of ``draw`` under which pieces, laid end to end, fill the gaps that all others leave in their bins."""
    gap = F.lit(float(capacity)) / F.expr(f"{capacity} div length") - F.col("length")
    rows = base.where(F.col("length") < capacity).groupBy(draw.alias("draw")).agg(F.sum("length").alias("tokens"), F.sum(gap).alias("gap")).collect()  # SHARES rows at most
    tokens, gaps = np.zeros(SHARES + 1), np.zeros(SHARES + 1)
    for draw_, t, g in rows:
        tokens[draw_ + 1], gaps[draw_] = t, g
    left = np.cumsum(gaps[::-1])[::-1]
    return int(np.argmax(np.cumsum(tokens) >= left * (1 + 1e-6)))


def _placed(base: DataFrame, capacity: int, streamed: Column) -> DataFrame:
    """Pieces with ``bin`` and ``slot``; both null in the stream."""
    rows = base.drop("ids").withColumn("k", F.when(streamed, F.lit(None)).otherwise(F.expr(f"{capacity} div length")))
    counts = rows.where("k is not null").groupBy("part", "k").agg(F.count("*").alias("rows"))
    counts = stored(counts, like="counts")
    # at most one row for each class; classes are numbers up to the capacity
    classes = counts.groupBy("k").agg((F.sum("rows") / F.col("k")).cast("long").alias("bins"))
    classes = classes.withColumn("first", F.sum("bins").over(W.orderBy("k")) - F.col("bins"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col("part").alias("p_part"), F.col("k").alias("p_k"), before.alias("before")).join(F.broadcast(classes.withColumnRenamed("k", "c_k")), F.col("p_k") == F.col("c_k"))
    within = F.row_number().over(W.partitionBy("part", "k").orderBy("i")) - 1
    rows = rows.withColumn("within", within).join(places, (F.col("part") == F.col("p_part")) & (F.col("k") == F.col("p_k")), "left")
    place = F.col("before") + F.col("within")
    bin_ = F.when(F.floor(place / F.col("k")) < F.col("bins"), F.col("first") + F.floor(place / F.col("k"))).cast("long")
    return rows.select("part", "i", "doc_id", "start", "length", "doc_tokens", "crc", bin_.alias("bin"), F.when(bin_.isNotNull(), place % F.col("k")).alias("slot"))


def _in_gaps(stream: DataFrame, gaps: DataFrame, end: int, capacity: int) -> DataFrame:
    """part, i, skip (ids of the piece before), length, bin, offset: the stream up to place ``end``, cut where gaps end."""

    def in_cells(df: DataFrame, from_: str, size: str) -> DataFrame:
        to = F.least(F.col(from_) + F.col(size), F.lit(end)) - 1
        cell = F.explode(F.sequence(F.expr(f"{from_} div {capacity}"), F.floor(to / capacity).cast("long")))
        return df.where(F.col(from_) < end).withColumn("cell", cell).withColumn("pos", F.greatest(F.col(from_), F.col("cell") * capacity))

    piece = in_cells(stream, "before", "length").select("cell", "pos", F.struct("part", "i", "before").alias("piece"), F.expr("cast(null as struct<bin: long, filled: long, before: long>)").alias("gap"))
    gap = in_cells(gaps, "before", "room").select("cell", "pos", F.expr("cast(null as struct<part: int, i: long, before: long>)").alias("piece"), F.struct("bin", "filled", "before").alias("gap"))
    order = W.partitionBy("cell").orderBy("pos", F.col("gap").isNull())
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    until = F.coalesce(F.lead("pos").over(order), F.least((F.col("cell") + 1) * capacity, F.lit(end)))
    cut = piece.unionByName(gap).select("pos", (until - F.col("pos")).alias("length"), F.last("piece", True).over(so_far).alias("piece"), F.last("gap", True).over(so_far).alias("gap"))
    return cut.where("length > 0").select("piece.part", "piece.i", (F.col("pos") - F.col("piece.before")).alias("skip"), "length", "gap.bin", (F.col("gap.filled") + F.col("pos") - F.col("gap.before")).alias("offset"))


def _after_gaps(stream: DataFrame, start: int, end: int, bins: int, capacity: int) -> DataFrame:
    """The same for the stream from ``start`` to its ``end``: full sequences, then one for each power of two in the rest."""
    full, rest = divmod(end - start, capacity)
    ends = [full * capacity]
    for power in reversed(range(capacity.bit_length())):
        if rest >> power & 1:
            ends.append(ends[-1] + (1 << power))
    tail = F.array(*[F.lit(x).cast("long") for x in ends])
    cell_of = lambda s: F.when(s < ends[0], F.floor(s / capacity)).otherwise(full - 1 + F.size(F.filter(tail, lambda x: x <= s))).cast("long")
    first_of = lambda c: F.when(c < full, c * capacity).otherwise(F.get(tail, (c - full).cast("int")))
    a, b = F.greatest(F.col("before") - start, F.lit(0)), F.col("before") + F.col("length") - start
    rows = stream.where(F.col("before") + F.col("length") > start).withColumn("a", a).withColumn("b", b)
    rows = rows.withColumn("cell", F.explode(F.sequence(cell_of(F.col("a")), cell_of(F.col("b") - 1))))
    rows = rows.withColumn("from", F.greatest("a", first_of(F.col("cell")))).withColumn("to", F.least("b", first_of(F.col("cell") + 1)))
    return rows.select("part", "i", (F.col("from") + start - F.col("before")).alias("skip"), (F.col("to") - F.col("from")).alias("length"), (F.col("cell") + bins).alias("bin"), (F.col("from") - first_of(F.col("cell"))).alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, crc, doc_tokens, sequence_id, offset, and ids (bytes) where wanted.

    ``capacity`` is a power of two."""
    base = stored(tokenised(docs, path, capacity, end_id), like="tokenised")
    draw = F.pmod(F.xxhash64("part", "i"), F.lit(SHARES)).cast("int")
    share = _stream_share(base, capacity, draw)
    drawn = (draw < share) & (F.col("length") < capacity)
    placed = stored(_placed(base, capacity, drawn), like="placed")
    binned = placed.where("bin is not null")
    gaps = stored(binned.groupBy("bin").agg(F.sum("length").alias("filled")), like="filled").withColumn("room", capacity - F.col("filled"))
    bins, room = gaps.agg(F.count("*"), F.coalesce(F.sum("room"), F.lit(0))).first()
    gaps = _with_before(gaps, "bin", "room", bins).where("room > 0")
    # the stream in the order of (part, i)
    stream = placed.where("bin is null").select("part", "i", "length")
    parts = stored(stream.groupBy("part").agg(F.sum("length").alias("tokens")), like="parts")
    last_part, tokens = parts.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = _with_before(parts, "part", "tokens", last_part + 1).select(F.col("part").alias("p"), F.col("before").alias("parts_before"))
    earlier = F.coalesce(F.sum("length").over(W.partitionBy("part").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stream = stored(stream.withColumn("earlier", earlier).join(parts, F.col("part") == F.col("p")).select("part", "i", "length", (F.col("parts_before") + F.col("earlier")).alias("before")), like="stream")
    end = min(room, tokens)
    cut = _in_gaps(stream, gaps, end, capacity).unionByName(_after_gaps(stream, end, tokens, bins, capacity))
    cut = stored(cut, like="cut").withColumnRenamed("length", "size")

    def pieces(of: DataFrame, cut_: DataFrame) -> DataFrame:
        part = F.substring("ids", F.col("skip") * 4 + 1, F.col("size") * 4)
        joined = of.join(cut_.withColumnRenamed("part", "c_part").withColumnRenamed("i", "c_i"), (F.col("part") == F.col("c_part")) & (F.col("i") == F.col("c_i")))
        return joined.select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), F.crc32(part).alias("crc"), "doc_tokens", F.col("bin").alias("sequence_id"), "offset", *([part.alias("ids")] if with_ids else []))

    before = F.coalesce(F.sum("length").over(W.partitionBy("bin").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = binned.withColumn("offset", before)
    if with_ids:
        ids = base.select(F.col("part").alias("b_part"), F.col("i").alias("b_i"), "ids")
        whole = whole.join(ids, (F.col("part") == F.col("b_part")) & (F.col("i") == F.col("b_i")))
    whole = whole.select("doc_id", "start", "length", "crc", "doc_tokens", F.col("bin").alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
    mine = draw < share  # in the stream, and not left over by a class
    # pieces left over by the classes: fewer than C ln C, each in at most two sequences and one more for each power of two
    left_over = F.broadcast(cut.where(~mine))
    return whole.unionByName(pieces(base.where(drawn), cut.where(mine))).unionByName(pieces(base.where(~drawn), left_over))


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: bytes = b"\0\0\0\0") -> DataFrame:
    """sequence_id, n_ids and ids (bytes): the pieces of a sequence in order, padded to ``capacity`` unless a power of two."""
    each = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("all", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    size = F.when(F.bit_count("n_ids") == 1, F.col("n_ids")).otherwise(capacity)
    return each.select("sequence_id", "n_ids", F.rpad(ids, (size * 4).cast("int"), F.lit(pad)).alias("ids"))


def packing_digest(docs: DataFrame, path: str) -> DataFrame:
    """The registered form: pieces without their ids."""
    return pack(docs, path, with_ids=False).select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
