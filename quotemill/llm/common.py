"""Helpers that several operators share: stored intermediate tables, word spans and hashes of whole Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task; a longer document is taken whole.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's checkpoint folder.  Where none is set, a session in one process gets a
    temporary one and any other is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, *, like: str = "t", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends and lost executors lose nothing.  Where rows are large,
    ``rows_per_file`` bounds what a reader, which takes thousands of rows of a file at once, has in memory (0: no bound)."""
    path = f"{shared_dir(df.sparkSession)}/{like}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", maxRecordsPerFile=rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About ``n`` rows, never over 2 n, spread over all partitions: those whose hash of ``keys`` falls below a bound.  All rows
    where there are no more than ``n``.  ``df`` should be cheap to count."""
    total = df.count()
    if total <= n:
        return df
    spread = 1 << 30
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(spread)) < F.lit(spread * n // total)).limit(2 * n)


#: Bits of the largest table of :func:`may_be_among`: 8 MB.
MOST_BITS = 1 << 26


def may_be_among(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A condition that is true for every value of ``keys`` and false for most others, so that only the rows for which it holds
    need be shuffled to meet ``keys``.

    It looks up one bit of a hash in a table of 16 bits a key and of ``most_bits`` at most; a full table lets more rows pass,
    and none is lost.  ``keys`` should be cheap to read."""
    bits = min(most_bits, 1 << max(10, (16 * keys.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slots = keys.select(slot(F.col(key)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def seen(s: pd.Series) -> pd.Series:
        at = s.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: seen(slot(c))


def byte_table(keep: list[int]) -> np.ndarray:
    """A table of 256 booleans that is true at the given byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(keep)] = True
    return table


#: Words of op 9 and of the toxicity features: ASCII letters and digits, and everything beyond ASCII.
ALNUM = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words between ASCII white space.
NONSPACE = byte_table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after the other, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches to about ``most`` bytes of the text column: (rows, bytes, offsets); whole rows only."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 positions of each text's first word; words end where texts end."""
    inside = is_word[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = inside
    after[offsets[1:][offsets[1:] > 0]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, upper-case A-Z taken as lower-case; eight bytes of all words at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = LOWER[data]
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    sizes, out = ends - starts, np.zeros(len(starts), dtype=np.uint64)
    live: np.ndarray | slice = slice(None)
    for at in range(0, _LONG_WORD, 8):
        if at:
            live = np.flatnonzero(sizes > at)
            if not len(live):
                return out
        x = eights[starts[live] + at] & _FIRST_BYTES[np.minimum(sizes[live] - at, 8)]
        x = (x ^ out[live]) * _MIX[0]
        out[live] = (x ^ (x >> np.uint64(31))) * _MIX[1]
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : ends[i]].tobytes())
    return out


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, from batches that are sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
