"""The Merkle manifest against a plain one: nested loops over small tables."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quotemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def tree(digests):
    """(root, for each leaf the (left, right) siblings of each level)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 3 * 3 : a // 3 * 3 + 3]
            paths[i].append(("".join(run[: a % 3]), "".join(run[a % 3 + 1 :])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def brute(rows):
    nulls_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    rows = sorted(rows, key=lambda r: (nulls_first(r[3]), nulls_first(r[0]), leaf(r, r[1])))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[3])]
    low = [tree([leaf(r, r[1]) for r in g]) for g in groups]
    root, tops = tree([sub for sub, _ in low])
    out = []
    for g, (sub, paths), top in zip(groups, low, tops):
        for r, path in zip(g, paths):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in merkle.manifest_digest(df).collect()), key=repr)


def rows_of(*sizes):
    out = []
    for s, n in enumerate(sizes):
        out += [(s * 1000 + i, f"é text\n{i}", "en", f"s{s}", i) for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (1, 1), (28, 1, 9, 2), (100, 5, 1, 3, 10, 82)])
def test_sizes(spark, sizes):
    rows = rows_of(*sizes)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_ties_and_names(spark):
    rows = rows_of(7, 2) + [(1, "a\nb", None, None, None), (2, None, "", "", 0), (None, "x\n", None, None, 1), (None, None, None, None, None), (3, "", "de", "ü", 2)]
    rows += [(5, "same\n", "en", "s0", 1)] * 5 + [(5, "other\n", "en", "s0", 1), (2, "long " * 50_000 + "\n", "en", "Z", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    more = [F.lit(1).alias(c) for c in ("tree", "pos", "n", "d", "seg", "leaf", "other", "part", "root", "within", "level", "of")]
    assert found(df.select("*", *more)) == brute(rows)
    assert found(df.repartition(13)) == brute(rows)
    assert merkle.manifest_digest(df.limit(0)).count() == 0


def test_one_source_over_many_ranges(spark):
    rows = [(i, f"t\n{i}", "en", "hot" if i % 3 else "cold", i) for i in range(400)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_real_proofs(spark):
    m = merkle.manifest(spark.createDataFrame(rows_of(11, 4), SCHEMA)).collect()
    assert len(m) == 15 and all(len(r["leaf"]) == 32 and r["other"] is None and len({len(s["l"]) % 32 for s in r["seg"]}) == 1 for r in m)
    assert {len(r["seg"]) for r in m if r["source"] == "s0"} == {4}
