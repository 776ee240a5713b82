"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers, ``floor(scale * x)``.  Candidates are range-partitioned by descending length and packed into blocks of equal
dimension; each block carries its greatest length.  The longest candidates of all give every query a first threshold: the
k-th best score among them.  A query and a block are compared in steps, each of which may end it: the product
of the lengths against the threshold; the sum over the first rotated components plus the product of the residual lengths; exact
integer scores of what is left.  The rotation comes from the SVD of a bounded sample; it is orthogonal whatever
the sample, so bounds hold and only their sharpness depends on it.

Query blocks of bounded size meet candidate blocks by an equi-join on the number of the query block.  Pairs of blocks whose lengths rule
out every query are dropped before any vector is shuffled.  Thresholds rise while a task goes through
its blocks; each task returns at most k rows a query, and a rank filter merges them.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do those of a squared length of 2**62 or more after
scaling, so that no score passes 64 bits; scores are between vectors of equal dimension
alone (those of another dimension are never candidates); rows that repeat are candidates each, but a query's own vec_id never is; every row
whose id is divisible is a query of its own, so a repeated id has one list for each of its rows; a table of
fewer candidates gives all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import bounded_sample, stored

BLOCK = 2048
HEAD = 2048
#: Vectors of the sample from which the rotation is computed.
SAMPLE = 4096


def valid_vectors(vectors: DataFrame, scale: float = 64.0, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, v (array of whole doubles), dim, norm2."""
    x = F.transform(column, lambda c: c.cast("double"))
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).where(finite).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))
    sized = whole.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c).alias("norm2"))
    return sized.where(F.col("norm2") < 2.0**62)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal size."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles where no sum can pass 2**53, else 64-bit integers."""
    most = (np.abs(q).max(initial=0.0)) * (np.abs(c).max(initial=0.0)) * max(1, q.shape[1])
    return q @ c.T if most < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: higher scores first, then smaller ids."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one block each: dim, n, top (greatest length), ids, flat; the order within partitions is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([float(part.column("norm2").to_numpy().max() ** 0.5)]), pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=["dim", "top", "ids", "flat"])

    return rows.select("id", "v", "dim", "norm2").mapInArrow(run, "dim int, top double, ids binary, flat binary")


def top_inner_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, column: str = "embedding", key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each vector whose id is divisible by ``every``."""
    whole = stored(valid_vectors(vectors, scale, column, key), like="vectors")
    n = max(1, whole.count())
    # the longest vectors and the rotation, both of bounded size
    head = {}
    least = whole.select("norm2").orderBy(F.desc("norm2")).limit(HEAD).agg(F.min("norm2")).first()[0]
    for r in whole.where(F.col("norm2") >= F.lit(least)).limit(HEAD).collect():
        head.setdefault(r["dim"], []).append((r["id"], r["v"]))
    head = {d: (np.array([i for i, _ in x], dtype=np.int64), np.array([v for _, v in x], dtype=float).reshape(len(x), d)) for d, x in head.items()}
    sample = {}
    for r in bounded_sample(whole, ["id"], SAMPLE).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    turn = {d: np.linalg.svd(np.array(x, dtype=float) / max(1.0, np.abs(x).max()), full_matrices=True)[2].T if d else np.zeros((0, 0)) for d, x in sample.items()}
    sent = whole.sparkSession.sparkContext.broadcast((head, turn))
    queries = _packed(whole.where(F.pmod("id", F.lit(every)) == 0).repartition(max(1, -(-n // (every * block))), F.xxhash64("id")), block)

    def with_needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [_Search(x["ids"], x["flat"], x["dim"], *sent.value, k).needs() for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], names=[*batch.schema.names, "needs"])

    queries = queries.mapInArrow(with_needs, "dim int, top double, ids binary, flat binary, needs double")
    queries = stored(queries.withColumn("q", F.monotonically_increasing_id()), like="queries")
    numbers = queries.select("q", "ids", "flat")
    per_block = queries.groupBy("dim").agg(F.collect_list(F.struct("q", "needs")).alias("qs"))  # 16 bytes for each block * every rows
    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (16 * block)))
    blocks = _packed(whole.repartitionByRange(parts, F.desc("norm2")).sortWithinPartitions(F.desc("norm2")), block)
    pairs = blocks.join(F.broadcast(per_block), "dim").select("dim", "top", F.col("ids").alias("c_ids"), F.col("flat").alias("c_flat"), F.explode(F.filter("qs", lambda x: x["needs"] <= F.col("top"))["q"]).alias("q"))
    pairs = pairs.join(numbers, "q").repartition(parts, "q", "c_ids").sortWithinPartitions("q", F.desc("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, turns = sent.value
        now, state = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda c, i=row, b=batch: b.column(c)[i].as_py()
                if cell("q") != now:
                    if state is not None:
                        yield from state.rows(now)
                    now, state = cell("q"), _Search(cell("ids"), cell("flat"), cell("dim"), heads, turns, k)
                state.meet(cell("c_ids"), cell("c_flat"), cell("top"))
        if state is not None:
            yield from state.rows(now)

    found = pairs.mapInArrow(run, "q long, nth int, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class _Search:
    """One block of queries and the best it has met."""

    def __init__(self, ids: bytes, flat: bytes, dim: int, heads: dict, turns: dict, k: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.q = np.frombuffer(flat, dtype="<f8").reshape(len(self.ids), dim)
        self.k, self.dim, self.turn = k, dim, turns.get(dim, np.eye(dim))
        self.lead = min(dim, max(4, dim // 4))
        self.length, self.first, self.rest = self._rotated(self.q)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2 for _ in self.ids]
        self.least = np.full(len(self.ids), -np.inf)
        if dim in heads:
            head_ids, head = heads[dim]
            scores = _scores(self.q, head).astype(float)
            scores[self.ids[:, None] == head_ids[None, :]] = -np.inf
            if len(head_ids) > k:
                self.least = np.partition(scores, len(head_ids) - k, axis=1)[:, len(head_ids) - k]

    def _rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = x @ self.turn
        return np.sqrt((x * x).sum(axis=1)), y[:, : self.lead], np.sqrt((y[:, self.lead :] ** 2).sum(axis=1))

    def meet(self, ids: bytes, flat: bytes, top: float) -> None:
        c_ids = np.frombuffer(ids, dtype=np.int64)
        c = np.frombuffer(flat, dtype="<f8").reshape(len(c_ids), self.dim)
        # bounds are doubles: a millionth of slack is far beyond their rounding
        active = np.flatnonzero(self.length * top * (1 + 1e-6) + 1e-6 >= self.least)
        if not len(active):
            return
        length, first, rest = self._rotated(c)
        bound = self.first[active] @ first.T + self.rest[active][:, None] * rest[None, :] + 1e-6 * (1 + self.length[active][:, None] * length[None, :])
        open_ = bound >= self.least[active][:, None]
        some = open_.any(axis=1)
        active, open_ = active[some], open_[some]
        columns = np.flatnonzero(open_.any(axis=0))
        if not len(active) or not len(columns):
            return
        scores = _scores(self.q[active], c[columns])
        own = c_ids[columns]
        good = open_[:, columns] & (scores >= self.least[active][:, None]) & (self.ids[active][:, None] != own[None, :])
        for row in np.flatnonzero(good.any(axis=1)):
            q = active[row]
            at = np.flatnonzero(good[row])
            s = np.concatenate([self.best[q][0], scores[row, at].astype(np.int64)])
            i = np.concatenate([self.best[q][1], own[at]])
            keep = _best(s, i, self.k)
            self.best[q] = (s[keep], i[keep])
            if len(keep) == self.k:
                self.least[q] = max(self.least[q], float(s[keep[-1]]))

    def needs(self) -> float:
        """The length that a candidate must have for any query of the block to be able to gain by it."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.length > 0, (self.least - 1e-6) / (self.length * (1 + 1e-6)), -np.inf)
        return float(least.min())

    def rows(self, q: int) -> Iterator[pa.RecordBatch]:
        n = [len(s) for s, _ in self.best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(n), q)), pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([i for _, i in self.best])), pa.array(np.concatenate([s for s, _ in self.best]))], names=["q", "nth", "query_id", "vec_id", "score"])


#: The registered search in DuckDB SQL.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v, row_number() over () as n from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank::int as rank, vec_id, score from (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score,
         row_number() over (partition by q.n order by list_inner_product(q.v::double[], c.v::double[]) desc, c.vec_id) as rank
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
where rank <= 20
"""
