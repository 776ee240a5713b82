"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has a bit set where over half of its shingle hashes have it.  Distinct fingerprints meet in buckets,
and a task compares a bucket's members by bit planes: 64 members share one machine word per plane, differing bits are
added up for all of them at once by carry-save counters, and a block of 64 is abandoned as soon as all its counters have
passed the radius.

Two ways lead into buckets.  ``segments`` cuts the 64 bits into radius + 1 segments: fingerprints within the radius
agree in one of them, so no link is lost.  A bucket of over ``split_above`` members is cut anew: its members agree in
one segment, so their remaining bits are cut into radius + 1 segments again, which loses nothing either.  ``minhash``
is for radii too large for that: texts meet where a band of min-hashes of their shingles agrees.  No bucket is gathered whole beyond
``split_above`` members (:func:`bounded_buckets`): there all members are first compared with one of them, those that link to it need not be compared with
each other, and the rest meets all members in blocks, which are tasks of their own.

:func:`near_components` links by the exact Jaccard similarity of the distinct shingle hashes.  There the bit planes only
propose: their radius is wide enough for texts of few shingles too, and every link is verified on the sets, which are made anew from
the texts that have a proposal.

A bucket yields no pairs but a star per connected set, so links never outnumber members.  Components come from
rounds of minimum labels with pointer jumping over stored tables.  Equal fingerprints are one node from the start, so exact
copies, however many, cost one aggregation, and they are dealt over tasks where they meet their component (:func:`join_copies`).

Defined results: null and empty texts and texts of white space have the fingerprint zero and are linked like others
under ``segments``; :func:`drop_near_duplicates` leaves texts without words and rows without doc_id alone.  Rows without doc_id link others
like any row; a component in which no row has one has no component_id.  Repeated rows fall into one component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import LOWER, NONSPACE, chunks, key_runs, may_be_among, stored, word_spans

SEED = 42
SPLIT_ABOVE = 4096
#: Copies of one text that meet their component in one task; more where the table has over 2**26 rows, so that hot keys stay under 2**16.
COPIES_AT_ONCE = 1024
#: Words of a block times planes that are held at once while comparing.
_AT_ONCE = 1 << 18
#: Near pairs that are verified between two looks at what they have linked, and words of near lanes unpacked at once.
_PAIRS = 1 << 12


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all ``size``-word shingles, repeats included, and the n + 1 positions of each text's first one.  A text
    of fewer words, but not none, has one shingle of all of them."""
    starts, ends, first = word_spans(data, offsets, NONSPACE)
    low = LOWER[data]
    # words with one space between them: a shingle is a slice
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    new_starts = new_ends - lengths
    flat = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 0x20, dtype=np.uint8)
    flat[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = low[NONSPACE[data]]
    n_words = np.diff(first)
    counts = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    at = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    head = np.arange(at[-1]) - np.repeat(at[:-1], counts) + np.repeat(first[:-1], counts)
    last = np.minimum(head + size, np.repeat(first[1:], counts)) - 1
    raw, h = flat.tobytes(), xxhash.xxh64_intdigest
    spans = zip(new_starts[head].tolist(), new_ends[last].tolist(), strict=True)
    return np.fromiter((h(raw[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(head)), at


def majority_bits(hashes: np.ndarray, at: np.ndarray, words: int = 1) -> np.ndarray:
    """(n, words) fingerprints of 64 bits each; a text without shingles has zero.  Further words come from the same
    hashes by multiplication."""
    n = len(at) - 1
    out = np.zeros((n, words), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    # sums of up to 255 rows fit the bytes of one long: eight adds a shingle instead of 64
    counts = np.diff(at)[full]
    pieces = -(-counts // 255)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_at, text_at = np.repeat(at[full], pieces) + 255 * nth, np.cumsum(pieces) - pieces
    for w in range(words if len(full) else 0):
        h = hashes if w == 0 else _mixed(hashes, w)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts = np.add.reduceat(bits.view(np.uint64), piece_at, axis=0).view(np.uint8)
        over = (2 * np.add.reduceat(parts, text_at, axis=0, dtype=np.int64) > counts[:, None]).astype(np.uint8)
        out[full, w] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def distinct_hashes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    out = np.zeros(len(at), dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.concatenate(parts) if parts else hashes, out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, bands: int = 0, rows: int = 3) -> DataFrame:
    """doc_id, fingerprint (``words`` longs), n_shingles and, if asked for, ``bands`` hashes of ``rows`` min-hashes; with bands,
    shingles count once a text, and a column ``content`` has 128 bits over the distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            hashes, at = shingle_hashes(data, offsets, shingle)
            if bands:
                hashes, at = distinct_hashes(hashes, at)
            fp = majority_bits(hashes, at, words).astype(np.int64)
            full = np.flatnonzero(np.diff(at) > 0)
            keys = np.zeros((part.num_rows, bands), dtype=np.uint64)
            for k in range(bands * rows if len(full) else 0):
                low = np.minimum.reduceat(_mixed(hashes, 101 + k), at[full])
                keys[full, k // rows] = _mixed(keys[full, k // rows] ^ low, 1)
            lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.astype(np.int64).reshape(-1)))
            columns, names = [part.column("doc_id"), lists(fp, words), pa.array(np.diff(at), pa.int64()), lists(keys, bands)], ["doc_id", "fingerprint", "n_shingles", "bands"]
            if bands:
                columns.append(_contents(hashes, at))
                names.append("content")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fingerprint array<long>, n_shingles long, bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", content binary" if bands else schema)


def _contents(hashes: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def shingle_sets(wanted: DataFrame, shingle: int, words: int) -> DataFrame:
    """node, content, text -> node, fingerprint and shingles (distinct hashes in unsigned order) of the rows whose text has the
    content; others are of rows that share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            hashes, at = distinct_hashes(*shingle_hashes(data, offsets, shingle))
            fp = majority_bits(hashes, at, words).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * words), pa.array(fp.reshape(-1)))
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            out = pa.RecordBatch.from_arrays([part.column("node"), lists, sets], names=["node", "fingerprint", "shingles"])
            yield out.filter(pc.equal(_contents(hashes, at), part.column("content")))

    return wanted.select("node", "content", "text").mapInArrow(run, "node long, fingerprint array<long>, shingles array<long>")


def segment_bounds(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of nearly equal parts."""
    return [(bits * k // parts, bits * (k + 1) // parts - bits * k // parts) for k in range(parts)]


def _segment_keys(nodes: DataFrame, radius: int, split_above: int) -> DataFrame:
    """key, node, fingerprint: the buckets of the pigeonhole rule, large ones cut a second time."""
    fp = F.element_at("fingerprint", 1)
    outer = segment_bounds(64, radius + 1)

    def piece(value, first: int, size: int):
        return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))

    keyed = nodes.select("node", "fingerprint", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), piece(fp, a, n)).alias("key")) for k, (a, n) in enumerate(outer)))).alias("s")).select("node", "fingerprint", "s.*")
    sizes = keyed.groupBy("key").count().where(F.col("count") > split_above).select("key", F.lit(True).alias("large"))
    keyed = keyed.join(sizes, "key", "left")

    def inner(k: int, a: int, n: int):
        # the other 64 - n bits, moved together
        lower = piece(fp, 0, a) if a else F.lit(0).cast("long")
        upper = F.shiftleft(F.shiftrightunsigned(fp, a + n), a) if a + n < 64 else F.lit(0).cast("long")
        rest = lower.bitwiseOR(upper)
        return F.array(*(F.xxhash64("key", F.lit(j), piece(rest, b, m)) for j, (b, m) in enumerate(segment_bounds(64 - n, radius + 1))))

    deep = F.when(F.col("k") == 0, inner(0, *outer[0]))
    for k, (a, n) in enumerate(outer[1:], 1):
        deep = deep.when(F.col("k") == k, inner(k, a, n))
    return keyed.select("node", "fingerprint", F.explode(F.when(F.col("large"), deep).otherwise(F.array("key"))).alias("key"))


def bit_sliced_stars(fp: np.ndarray, group: np.ndarray, radius: int, verified: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (equal, adjacent numbers in ``group``) of fingerprints (n, words) that differ in at most
    ``radius`` bits, as stars: pairs of (member, first member of its connected set), indices into ``fp``.  If given,
    ``verified`` decides which of such pairs link; pairs that are connected already are not asked for."""
    n, words = fp.shape
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, n))
    keep = np.flatnonzero(size > 1)
    if not len(keep):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # blocks of up to 64 lanes; a block's planes are words with one bit a member
    first, size = first[keep], size[keep]
    blocks = -(-size // 64)
    block_of = np.repeat(np.arange(len(keep)), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    base = first[block_of] + 64 * nth
    lanes = np.minimum(64, first[block_of] + size[block_of] - base)
    take = np.minimum(base[:, None] + np.arange(64), n - 1)
    labels = np.arange(n)
    # every member against every block of its group that ends behind it
    step = max(1, _AT_ONCE // max(1, int(blocks.max())))
    members = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owner = np.repeat(np.arange(len(keep)), size)
    first_block = np.cumsum(blocks) - blocks
    planes = np.zeros((words, 64, len(base)), dtype=np.uint64)
    for a in range(0, len(base), 1 << 12):
        lane_fp = fp[take[a : a + (1 << 12)]]
        for w in range(words):
            bits = np.unpackbits(np.ascontiguousarray(lane_fp[:, :, w]).view(np.uint8).reshape(len(lane_fp), 64, 8), axis=2, bitorder="little")
            planes[w, :, a : a + len(lane_fp)] = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, -1)
    counters = max(1, math.ceil(math.log2(radius + 1)))
    for a in range(0, len(members), step):
        q, g = members[a : a + step], owner[a : a + step]
        skip = (q - first[g]) // 64
        count = blocks[g] - skip
        query = np.repeat(q, count)
        block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first_block[g] + skip, count)
        valid = np.where(lanes[block] == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(lanes[block], 63).astype(np.uint64)) - np.uint64(1))
        # only lanes behind the member itself
        own = query - base[block]
        valid &= np.where(own >= 0, np.where(own >= 63, np.uint64(0), ~np.uint64(0) << np.clip(own + 1, 0, 63).astype(np.uint64)), ~np.uint64(0))
        near = _compared(fp, planes, query, block, valid, radius, counters)
        hits = np.flatnonzero(near)
        for b in range(0, len(hits), _PAIRS):
            hit = hits[b : b + _PAIRS]
            bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(bits)
            x, y = query[hit][row], base[block[hit][row]] + lane
            if verified is None:
                _join(labels, x, y)
                continue
            while len(x):
                apart = labels[x] != labels[y]
                x, y = x[apart], y[apart]
                sure = verified(x[:_PAIRS], y[:_PAIRS])
                _join(labels, x[:_PAIRS][sure], y[:_PAIRS][sure])
                x, y = x[_PAIRS:], y[_PAIRS:]
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def _compared(fp, planes, query, block, valid, radius: int, counters: int) -> np.ndarray:
    """For each (query, block) the lanes of ``valid`` within the radius."""
    out = np.zeros(len(query), dtype=np.uint64)
    live = np.flatnonzero(valid)
    q, b, over = query[live], block[live], ~valid[live]
    sums = [np.zeros(len(live), dtype=np.uint64) for _ in range(counters)]
    done = 0
    for w in range(fp.shape[1]):
        own = fp[q, w]
        for plane in range(64):
            carry = planes[w, plane][b] ^ (np.uint64(0) - ((own >> np.uint64(plane)) & np.uint64(1)))
            for s in sums:
                s ^= carry
                carry &= ~s
            over |= carry
            done += 1
            if done % 8 == 0:
                if done % 16 == 0:
                    over |= _greater(sums, radius)
                left = over != ~np.uint64(0)
                if not left.all():
                    live, q, b, over, own = live[left], q[left], b[left], over[left], own[left]
                    sums = [s[left] for s in sums]
                    if not len(live):
                        return out
    out[live] = ~(over | _greater(sums, radius))
    return out


def _greater(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    more, equal = np.zeros_like(sums[0]), np.full_like(sums[0], ~np.uint64(0))
    for k in range(len(sums) - 1, -1, -1):
        if radius >> k & 1:
            equal &= sums[k]
        else:
            more |= equal & sums[k]
            equal &= ~sums[k]
    return more


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the labels of linked members equal to the smallest of their set, in place."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def jaccard_at_least(values: np.ndarray, at: np.ndarray, similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Decides pairs (x, y) of the sets values[at[i] : at[i + 1]], each sorted, distinct and not empty."""
    size = np.diff(at)

    def verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        some = np.flatnonzero(np.minimum(size[x], size[y]) / np.maximum(size[x], size[y]) >= similarity)
        some = some[np.argsort(x[some], kind="stable")]
        for pairs in np.split(some, np.flatnonzero(np.diff(x[some])) + 1) if len(some) else []:
            i, others = x[pairs[0]], y[pairs]
            own, n = values[at[i] : at[i + 1]], size[others]
            first = np.cumsum(n) - n
            flat = values[np.arange(n.sum()) + np.repeat(at[others] - first, n)]
            common = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, first, dtype=np.int64)
            out[pairs] = common / (size[i] + n - common) >= similarity
        return out

    return verified


def bucket_stars(keyed: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """key, node, fingerprint -> the distinct edges (a, b), a > b, of the buckets' stars.  With ``similarity``, a column
    ``shingles`` says which pairs within the radius link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "key"):
            node = table.column("node").to_numpy()
            flat = table.column("fingerprint").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            fp = np.ascontiguousarray(flat.astype(np.int64).view(np.uint64).reshape(len(node), -1))
            verified = None
            if similarity is not None:
                lists = table.column("shingles").combine_chunks()
                at = lists.offsets.to_numpy().astype(np.int64)
                verified = jaccard_at_least(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at - at[0], similarity)
            x, y = bit_sliced_stars(fp, table.column("key").to_numpy(), radius, verified)
            a, b = node[x], node[y]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def within(radius: int) -> Callable[[DataFrame, DataFrame], Column]:
    """Whether the fingerprints of two rows differ in ``radius`` bits or fewer."""
    differ = lambda a, b: F.aggregate(F.zip_with(a["fingerprint"], b["fingerprint"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return lambda a, b: differ(a, b) <= radius


def similar(similarity: float) -> Callable[[DataFrame, DataFrame], Column]:
    """Whether the sets of two rows have this Jaccard similarity."""

    def linked(a: DataFrame, b: DataFrame) -> Column:
        common = F.size(F.array_intersect(a["shingles"], b["shingles"]))
        return common / (F.size(a["shingles"]) + F.size(b["shingles"]) - common) >= similarity

    return linked


def bounded_buckets(keyed: DataFrame, rows: DataFrame, linked: Callable[[DataFrame, DataFrame], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(key, node) -> (key, node) of buckets of about 2 * ``most`` members at most, and edges (a, b) found on the way; ``rows`` has what
    ``linked`` needs of each node.

    In a larger bucket every member is compared with the smallest.  Those that link to it are connected, so no link among them is needed;
    the rest meets all members: blocks of the rest and blocks of all members make a bucket for each two of them."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    small = keyed.join(sizes.where(F.col("n").between(2, most)), "key").select("key", "node")
    large = stored(keyed.join(sizes.where(F.col("n") > most), "key"), like="large")
    if large.isEmpty():
        return small, large.select(F.col("node").alias("a"), F.col("first").alias("b"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = large.where("node <> first").select("node", "first").distinct()
    pairs = pairs.join(a, "node").select("first", F.struct("a.*").alias("own")).join(b.select(F.col("node").alias("first"), F.struct("b.*").alias("other")), "first")
    rated = stored(pairs.select(F.col("own.node").alias("node"), "first", linked(F.col("own"), F.col("other")).alias("linked")), like="rated")
    rest = large.join(rated.where("not linked"), ["node", "first"]).select("key", "node", "n")
    left = stored(rest.groupBy("key").agg(F.count("*").alias("n_rest")), like="left")
    blocks = lambda n: F.ceil(F.col(n) / most).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    ours, theirs = F.pmod(F.xxhash64("node"), blocks("n")).cast("int"), F.pmod(F.xxhash64("node", F.lit("rest")), blocks("n_rest")).cast("int")
    met = large.join(left, "key").select("key", "node", ours.alias("b"), every("n_rest").alias("r"))
    met = met.unionByName(rest.join(left, "key").select("key", "node", theirs.alias("r"), every("n").alias("b"))).distinct()
    return small.unionByName(met.select(F.xxhash64("key", "r", "b").alias("key"), "node")), rated.where("linked").select(F.col("node").alias("a"), F.col("first").alias("b"))


def join_copies(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, of which ``roots`` has one row with the number of its ``copies``; the copies of a hot key are dealt over tasks."""
    total = roots.agg(F.sum("copies")).first()[0] or 0
    most = max(COPIES_AT_ONCE, total >> 16)
    hot = F.broadcast(roots.where(F.col("copies") > most).select(key, F.ceil(F.col("copies") / most).cast("int").alias("salts")))  # under 2**16 rows
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("salts")
    each = roots.drop("copies").join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(each, [key, "salt"], "left").drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> node, component (smallest node reachable) for all nodes with an edge."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), like="edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), like="labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lower.join(up, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        new = stored(jumped, like="labels")
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """doc_id, fingerprint (array of one long), n_shingles, component_id (the smallest doc_id that links lead to).

    Fingerprints link at ``radius`` or fewer differing bits."""
    prints = stored(fingerprints(docs, shingle), like="prints")
    # a fingerprint is its own node, so rows without doc_id link others
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).withColumn("node", F.element_at("fingerprint", 1)), like="nodes")
    lines = nodes.select("node", "fingerprint")
    keyed = stored(_segment_keys(lines, radius, split_above).select("key", "node"), like="keys")
    buckets, known = bounded_buckets(keyed, lines, within(radius), split_above)
    found = components(bucket_stars(buckets.join(lines, "node"), radius).union(known))
    rooted = nodes.join(found, "node", "left").select("fingerprint", "copies", "first_id", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    roots = stored(rooted.join(least, "root").select("fingerprint", "copies", "component_id"), like="roots")
    return join_copies(prints, roots, "fingerprint").select("doc_id", "fingerprint", "n_shingles", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 lowercase hex digits, component_id; three words, radius two."""
    out = simhash_components(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fingerprint", 1)), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprint words of :func:`drop_near_duplicates`.
NEAR_WORDS = 16


def filter_radius(similarity: float, bits: int, margin: float = 4.0, few: int = 48) -> int:
    """A radius that sets of this Jaccard similarity or more keep but for ``margin`` standard errors, whatever their size.

    Strict majorities of few hashes are not the angle's: for up to ``few`` common hashes the share of differing bits is
    summed up exactly, beyond that the angle's holds."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    binomial = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    for common in range(1, few + 1):
        rest = [r for r in range(common + 1) if common / (common + r) >= similarity][-1]
        for only_a, only_b in ((i, r - i) for r in range(rest + 1) for i in range(r // 2 + 1)):
            # chances that a bit is set in a and in b, given how many of the common hashes have it
            k = np.arange(common + 1)[:, None]
            a, b = (((2 * (k + np.arange(n + 1)) > common + n) * binomial(n)).sum(axis=1) for n in (only_a, only_b))
            share = max(share, float((binomial(common) * (a * (1 - b) + b * (1 - a))).sum()))
    return math.ceil(bits * share + margin * math.sqrt(bits * share * (1 - share)))


def near_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 16, rows: int = 3, split_above: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    Texts link where the Jaccard similarity of their distinct shingle hashes is ``similarity`` or more.  Pairs are proposed
    by bands of min-hashes (at similarity 0.8 sixteen bands of three miss one pair in 96,000) and the filter radius;
    the sets of what proposals connect are then made from the texts and compared exactly."""
    radius = filter_radius(similarity, 64 * NEAR_WORDS)
    # rows without doc_id are told apart by their texts
    by_text = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    named = docs.select(F.struct(F.col("doc_id").alias("id"), by_text.alias("by_text")).alias("doc_id"), "text")
    prints = fingerprints(named, shingle, NEAR_WORDS, bands, rows).withColumn("node", F.monotonically_increasing_id())
    prints = stored(prints.withColumns({"lookup": F.xxhash64("doc_id.id", "doc_id.by_text"), "doc_id": F.col("doc_id.id")}), like="prints")
    # equal sets are one node: the row of their smallest doc_id
    first = prints.where("n_shingles > 0").groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lookup", "node")).alias("s"), F.count("*").alias("copies"))
    nodes = stored(first.select("content", F.col("s.doc_id").alias("first_id"), "s.lookup", "s.node", "copies"), like="nodes")
    banded = prints.select("node", "bands").join(nodes.select("node"), "node", "left_semi").select("node", F.posexplode("bands").alias("k", "band"))
    keyed = stored(banded.select("node", F.xxhash64("k", "band").alias("key")), like="keys")
    lines = prints.select("node", "fingerprint")
    buckets, known = bounded_buckets(keyed, lines, within(radius), split_above)
    proposed = components(bucket_stars(buckets.join(lines, "node"), radius).union(known))
    wanted = stored(proposed.join(nodes, "node").select("node", "content", F.col("lookup").alias("wanted")), like="wanted")
    some = docs.select("doc_id", "text", F.xxhash64("doc_id", by_text).alias("lookup"))
    some = some.where(may_be_among(wanted, "wanted")(F.col("lookup")))
    some = some.where("doc_id is not null").unionByName(some.where("doc_id is null").dropDuplicates(["lookup"]))
    sets = stored(shingle_sets(some.join(wanted, some["lookup"] == wanted["wanted"]), shingle, NEAR_WORDS), like="sets")
    buckets, known = bounded_buckets(proposed.select(F.col("component").alias("key"), "node"), sets, similar(similarity), split_above)
    found = components(bucket_stars(buckets.join(sets, "node"), radius, similarity).union(known))
    rooted = nodes.join(found, "node", "left").select("content", "copies", "first_id", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    roots = stored(rooted.join(least, "root").select("content", "copies", "component_id"), like="roots")
    out = join_copies(prints.select("doc_id", "n_shingles", "content"), roots, "content")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose group holds a smaller doc_id.

    Texts are near duplicates if the Jaccard similarity of their distinct five-word shingles is ``similarity`` or more, or
    such links lead from one to the other.  Texts without words stay.  Of rows with one doc_id all stay or go."""
    found = near_components(docs.select("doc_id", "text"), similarity, shingle)
    gone = stored(found.where("component_id <> doc_id and n_shingles > 0").select("doc_id").distinct(), like="gone")
    maybe = may_be_among(gone, "doc_id")(F.col("doc_id"))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, "doc_id", "left_anti"))
