"""Substring search over stored texts: an index of three-letter grams proposes rows, LIKE itself verifies them.

``write_index`` stores two folders.  ``texts`` holds the rows as they come, numbered: ``slot`` counts runs of ``SLOT_ROWS``
rows, ``row`` the rows of a slot.  They are neither counted nor shuffled for that, and no file holds more than a few slots.  ``grams`` holds
lists of rows: for each gram and piece of a slot (about ``MOST_BYTES`` of text, made in one task) the rows of the piece that
contain the gram.  A gram is stored as one number whose order is that of its letters.  Lists are dealt by gram and block of slots and sorted by
gram in each file, so the files' page indexes say where a gram lies; a frequent gram is many short lists, and no task gets all of them.

``search`` takes a pattern as ``ilike`` would between two percent signs.  The literal pieces between its wildcards give
grams; rows that hold all of them are proposed as bits (one word for 64 rows), fetched by slot, and judged by ``ilike``.  A pattern whose pieces are all
shorter than three letters asks for all grams that begin with its longest piece (texts end in two blanks of their own, so that
their last letters begin grams too); one without any letter reads the texts.

Defined results: those of ``ilike`` on any of the columns.  Null columns match nothing; rows without a key, repeated rows and
columns beyond the indexed ones are kept as they are; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.batches import small
from quotemill.sources import sinks

#: Rows of a slot: the bound of a list of the index.
SLOT_ROWS = 4096
#: Slots of a file of the texts, so that few large input files do not become few tasks.
FILE_SLOTS = 2
#: Slots whose lists of one gram are dealt to one task.
BLOCK_SLOTS = 256
#: Bytes of text whose lists are made at once; a longer text is alone.
MOST_BYTES = 4 << 20
#: Grams of a pattern that are looked up; a longer one takes them in equal steps, as ``ilike`` judges what they propose.
MOST_GRAMS = 8
#: Slots that are named in the filter of the scan of the texts; beyond them the join alone picks rows.
MOST_SLOTS = 1000
#: Words (24 bytes each) that are sent to all tasks, so that the texts are not shuffled to meet them; beyond them the planner decides.
MOST_WORDS = 1 << 18
#: Ends a column inside the indexed text; a NUL is no letter of a text that is searched.
_END = "\x00\x00"
#: Bits of a letter in the number of a gram.
_LETTER = 21


def _whole(columns: tuple[str, ...]) -> Column:
    """The indexed text: all columns in lower case, each with its end."""
    return F.concat(*(F.concat(F.lower(F.coalesce(c, F.lit(""))), F.lit(_END)) for c in columns))


def gram_number(gram: str) -> int:
    """The number of a gram; a shorter beginning of grams has the least number of them."""
    codes = [ord(c) for c in gram] + [0] * (3 - len(gram))
    return codes[0] << 2 * _LETTER | codes[1] << _LETTER | codes[2]


def _lists(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """gram, slot, rows of the texts of one batch, each list once."""
    letters = np.frombuffer("".join(batch["text"].to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False)
    known = np.zeros(1 << _LETTER, bool)
    known[letters] = True
    alphabet = np.flatnonzero(known)
    wide, deep = max(1, int(len(alphabet) - 1).bit_length()), int(batch.num_rows - 1).bit_length()
    if 3 * wide + deep > 63:  # more letters than fit a number beside the row; a single text always fits
        half = batch.num_rows // 2
        yield from _lists(batch.slice(0, half))
        yield from _lists(batch.slice(half))
        return
    dense = np.zeros(1 << _LETTER, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    at, own = dense[letters], np.repeat(np.arange(batch.num_rows), lengths)
    pairs = ((at[:-2] << 2 * wide | at[1:-1] << wide | at[2:]) << deep | own[:-2])[own[:-2] == own[2:]]
    pairs.sort()
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    slots, rows = batch["slot"].to_numpy(), batch["row"].to_numpy()
    gram, place = pairs >> deep, pairs & ((1 << deep) - 1)
    first = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(slots[place], prepend=-1) != 0))
    gram, one = gram[first], (1 << wide) - 1
    number = alphabet[gram >> 2 * wide] << 2 * _LETTER | alphabet[gram >> wide & one] << _LETTER | alphabet[gram & one]
    lists = pa.ListArray.from_arrays(np.append(first, len(pairs)).astype(np.int32), rows[place])
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(slots[place[first]]), lists], ["gram", "slot", "rows"])


def _all_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, ("text",), MOST_BYTES):
        yield from _lists(batch)


def write_index(table: DataFrame, columns: tuple[str, ...], path: str, slot_rows: int = SLOT_ROWS) -> None:
    """Store ``table`` and the index of its text ``columns`` under ``path``."""
    spark = table.sparkSession
    own = F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("own")
    rows = table.select(own).withColumn("id", F.monotonically_increasing_id()).select(F.expr(f"id div {slot_rows}").alias("slot"), (F.col("id") % slot_rows).cast("short").alias("row"), "own")
    rows.write.option("maxRecordsPerFile", FILE_SLOTS * slot_rows).parquet(f"{path}/texts")
    texts = spark.read.schema(rows.schema).parquet(f"{path}/texts")
    lists = texts.select("slot", "row", _whole(tuple(f"own.{c}" for c in columns)).alias("text")).mapInArrow(_all_lists, "gram long, slot long, rows array<short>")
    lists.repartition("gram", F.expr(f"slot div {BLOCK_SLOTS}")).sortWithinPartitions("gram", "slot").write.parquet(f"{path}/grams")


def pieces(pattern: str) -> list[str]:
    """The literal pieces of a LIKE pattern with the escape sign ``\\``."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out[-1] += pattern[at]
        elif c in "%_":
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [p for p in out if p]


def wanted_grams(pattern: str, most: int = MOST_GRAMS) -> list[str]:
    """Grams that every match of the pattern holds, ``most`` at most; none where all pieces are shorter."""
    found = list(dict.fromkeys(p[i : i + 3] for p in pieces(pattern) for i in range(len(p) - 2)))
    step = max(1, -(-len(found) // most))
    return found[::step]


def proposed(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """slot, word, bits of the rows that can match, row r of a slot as bit r % 64 of word r div 64; None where the pattern says nothing about letters."""
    low = spark.sql("select lower(:p) as p", args={"p": pattern}).first()["p"]  # one literal, in the letters of ``ilike``
    grams, index = [gram_number(g) for g in wanted_grams(low)], spark.read.schema("gram long, slot long, rows array<short>").parquet(f"{path}/grams")
    if grams:
        index = index.where(F.col("gram").isin(*grams))
    else:
        short = max(pieces(low), key=len, default="")
        if not short:
            return None
        first = gram_number(short)
        index = index.where(F.col("gram").between(first, first + (1 << (3 - len(short)) * _LETTER) - 1))
    bit = F.expr("shiftleft(1L, row & 63)")
    words = index.select("slot", "gram", F.explode("rows").alias("row")).groupBy("slot", F.shiftright("row", 6).alias("word"))
    if not grams:
        return words.agg(F.bit_or(bit).alias("bits"))
    held = words.agg(*(F.bit_or(F.when(F.col("gram") == g, bit)).alias(f"held{i}") for i, g in enumerate(grams)))
    bits = F.lit(-1).cast("long")
    for i in range(len(grams)):
        bits = bits.bitwiseAND(F.col(f"held{i}"))
    return held.select("slot", "word", bits.alias("bits")).where("bits <> 0")  # null where a gram is in none of the rows


def stored(spark: SparkSession, path: str) -> DataFrame:
    """slot, row and, as ``own``, the columns of the table that was indexed."""
    return spark.read.parquet(f"{path}/texts")


def matches(spark: SparkSession, path: str, columns: tuple[str, ...], pattern: str, most_slots: int = MOST_SLOTS) -> DataFrame:
    """As :func:`stored`, the rows in which one of ``columns`` holds the pattern, in any case."""
    texts = stored(spark, path)
    found = proposed(spark, path, pattern)
    if found is not None:
        at = sinks.scratch(spark, "found")  # stored, as it is read twice, and its size decides whether the texts must be shuffled to meet it
        found.write.parquet(at)
        found = spark.read.schema(found.schema).parquet(at)
        slots = [r["slot"] for r in found.select("slot").distinct().limit(most_slots + 1).collect()]  # bounded
        if not slots:
            return texts.limit(0)
        if len(slots) <= most_slots:
            texts = texts.where(F.col("slot").between(min(slots), max(slots)) & F.col("slot").isin(*slots))
        if found.count() <= MOST_WORDS:
            found = F.broadcast(found)
        texts = texts.withColumn("word", F.shiftright("row", 6)).join(found, ["slot", "word"]).where(F.getbit("bits", F.expr("row & 63")) == 1)
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.col(f"own.{c}").ilike(f"%{pattern}%"), F.lit(False))
    return texts.where(match).select("slot", "row", "own")


def search(spark: SparkSession, path: str, columns: tuple[str, ...], pattern: str, most_slots: int = MOST_SLOTS) -> DataFrame:
    """The indexed table's rows in which one of ``columns`` holds the pattern, in any case."""
    return matches(spark, path, columns, pattern, most_slots).select("own.*")
