"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained on the driver from confirmed toxic texts (positives) and from texts of the corpus without
labels (unlabelled: a sample of all rows outside the held-out fold, whatever is known of them), with the non-negative risk estimator of Kiryo et al. (2017): with the share ``prior`` of
positives among the unlabelled, the risk on negatives is max(0, R_u(-) - prior * R_p(-)), and where that
difference falls below zero the step goes against it.  The score is a logistic function whose scale and offset are then
fitted to labelled training rows of both kinds, so that 0.5 is the point of equal odds.

Only features of bounded samples, by hash of doc_id, reach the driver: at most ``POSITIVES`` toxic, ``NEGATIVES`` other labelled and ``UNLABELLED``
rows.  Each labelled row stands for as many as its kind has labelled rows to a sampled one, and the prior is the share of positives
in all labelled training rows, whatever the samples hold.  Scoring covers whole texts, in the tasks, without a shuffle.

Defined results: null and empty texts get the score of the offset alone; rows without a label (or with a null one) are
never learned from; labels that repeat count as toxic if any of them is; with no positive or no other row to
learn from, every score is the known share of positives (0 if nothing is known); :func:`drop_toxic` keeps texts without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.common import ALNUM, chunks, stored, word_hashes, word_spans

BUCKET_BITS = 20
#: Bytes of the beginnings of words that are features too: inflected forms share them.  Of nine choices the one of least log loss in a
#: cross-validation over the four folds that are learned from; held-out rows had no part in it.
PREFIXES = (5,)
#: Most training rows of each kind.
POSITIVES = 2_000
NEGATIVES = 1_000
UNLABELLED = 4_000
#: A word is a feature if at least so many training texts hold it.
MIN_TEXTS = 3
#: Pseudo-counts that draw the values of rare features to zero.
SMOOTH = 20.0
FOLDS = 5


def held_out(doc_id="doc_id"):
    """True for the fifth of the rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and of the beginnings of longer words of each text, sorted, and the n + 1 positions
    where each text's begin."""
    starts, ends, first = word_spans(data, offsets, ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first)) << BUCKET_BITS
    pairs = [np.zeros(0, dtype=np.int64)]
    for size in (0, *PREFIXES):
        some = slice(None) if size == 0 else np.flatnonzero(ends - starts > size)
        h = word_hashes(data, starts[some], ends[some] if size == 0 else starts[some] + size)
        # a prefix is another feature than the word of the same letters
        bucket = ((h * np.uint64(2 * size + 1)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        pairs.append(np.unique(text[some] | bucket))
    pairs = np.unique(np.concatenate(pairs))
    return pairs & ((1 << BUCKET_BITS) - 1), np.searchsorted(pairs, np.arange(len(first)) << BUCKET_BITS)


@dataclass
class Model:
    weights: np.ndarray
    scale: float
    offset: float

    def scores(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        # summed text by text: the same text has the same score wherever it stands
        raw = np.zeros(len(at) - 1)
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            raw[full] = np.add.reduceat(self.weights[buckets].astype(np.float64), at[full])
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.offset, -40, 40)))


def train(buckets: np.ndarray, at: np.ndarray, kind: np.ndarray, prior: float) -> Model:
    """A model from rows of ``kind`` 1 toxic, 0 unlabelled, -1 labelled otherwise, which serves the scale of the score alone."""
    n, size = len(at) - 1, 1 << BUCKET_BITS
    toxic, negative = kind == 1, kind == -1
    n_p, n_n = int(toxic.sum()), int(negative.sum())
    if not n_p or not n_n or not (kind == 0).any() or not 0 < prior < 1:
        share = prior if 0 < prior < 1 else float(prior > 0)
        return Model(np.zeros(size, dtype=np.float32), 0.0, float(np.clip(np.log((share + 1e-17) / (1 - share + 1e-17)), -40, 40)))
    taught = kind >= 0
    counts = np.bincount(buckets[np.repeat(taught, np.diff(at))], minlength=size)
    used = np.flatnonzero(counts >= min(MIN_TEXTS, max(1, int(taught.sum()) // 20)))
    column = np.full(size, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    keep = column[buckets] >= 0
    row, col = row[keep], column[buckets[keep]]
    own = nnpu_weights(row, col, len(used), toxic, kind == 0, prior)
    f, known = np.bincount(row, own[col], n), toxic | negative
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = own
    mass = np.where(toxic, prior / n_p, (1 - prior) / n_n)[known] * (n_p + n_n)
    return Model(weights, *_platt(f[known], toxic[known].astype(float), mass))


def nnpu_weights(row: np.ndarray, col: np.ndarray, width: int, toxic: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, rate: float = 0.1, decay: float = 2e-4) -> np.ndarray:
    """Weights of sparse binary features (``row`` holds ``col``) by non-negative PU training of logistic loss, Adam over whole batches."""
    n, n_p, n_u = len(toxic), int(toxic.sum()), int(unlabelled.sum())
    mine = (toxic | unlabelled)[row]
    row, col = row[mine], col[mine]
    # a feature's value is its log odds between positives and unlabelled, near zero for the rare ones
    in_p, in_u = np.bincount(col[toxic[row]], minlength=width), np.bincount(col[unlabelled[row]], minlength=width)
    value = np.log((in_p + SMOOTH) / (in_u * (n_p / n_u) + SMOOTH))
    p_weight, u_weight = toxic / n_p, unlabelled / n_u
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, rounds + 1):
        f = np.bincount(row, (w * value)[col], n) + bias
        up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        positive, negative = -(1 - up), up  # slopes of log(1 + e**-f) and log(1 + e**f)
        loss = np.logaddexp(0, f)
        rest = u_weight @ loss - prior * (p_weight @ loss)
        slope = u_weight * negative - prior * p_weight * negative
        slope = prior * p_weight * positive + slope if rest >= 0 else -slope
        g, gb = value * np.bincount(col, slope[row], width) + decay * w, slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w * value


def _platt(f: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logistic function by Newton steps with a small ridge; ``mass`` is what each row counts."""
    x = np.stack([f, np.ones_like(f)], axis=1)
    beta = np.array([1.0, float(np.log((mass @ y) / (mass @ (1 - y))))])
    n_pos, n_neg = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        g = x.T @ (mass * (p - goal)) + 1e-3 * (beta - [1.0, 0.0])
        h = (x * (mass * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of all labelled rows outside the held-out fold."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))


def training_rows(docs: DataFrame, known: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, negatives: int = NEGATIVES) -> DataFrame:
    """doc_id, kind, buckets of samples of :func:`known_labels` (kind 1 and -1) and of all rows outside the held-out fold (kind 0)."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = [(known.where("toxic"), 1, positives), (some, 0, unlabelled), (known.where("not toxic"), -1, negatives)]
    chosen = [x.select("doc_id", F.lit(kind).alias("kind")).orderBy(*order).limit(n) for x, kind, n in chosen]
    chosen = chosen[0].union(chosen[1]).union(chosen[2])
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled + negatives short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            buckets, at = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("kind"), lists], names=["doc_id", "kind", "buckets"])

    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kind int, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, negatives: int = NEGATIVES, prior: float | None = None) -> Model:
    """``prior``: the share of positives among the unlabelled; that of the labelled training rows if not given."""
    known = stored(known_labels(labels), like="known")
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    table = training_rows(docs, known, positives, unlabelled, negatives).toArrow()
    # rows come in any order
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("kind", "ascending")]))
    lists = table["buckets"].combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    share = counted.get(True, 0) / max(1, sum(counted.values())) if prior is None else prior
    buckets, kind = lists.flatten().to_numpy(zero_copy_only=False), table["kind"].to_numpy()
    del table, lists
    return train(buckets, at - at[0], kind, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` as the struct ``row``, with ``score``."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return _scored(docs.select(row, docs["text"].alias("text")), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((model.weights, model.scale, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for part, data, offsets in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(own.scores(*features(data, offsets)), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    scored = _scored(docs.select(docs["doc_id"].alias("row"), docs["text"].alias("text")), model).withColumnRenamed("row", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold or hold no word."""
    wordless = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    return score(docs, fit(docs, labels)).where((F.col("score") < threshold) | wordless).select("row.*")
