"""Merkle manifest of a dataset with proofs by pointer jumping.

A leaf is the SHA-256 of a row's columns, each as UTF-8 byte count, ``:`` and value (``-`` for null).  The leaves of a source ascend by
doc_id; every ``ARITY`` consecutive nodes become the SHA-256 of their digests (as hex text) until one remains, the subroot.
The subroots, ordered by source, grow into the root in the same way.

Proofs: every node holds a segment, the siblings to its left and right towards its parent.  Self-joins double the distance that segments
span, of the nodes above the leaves only: after round k the nodes whose level is a multiple of 2**k hold the segments of 2**k levels.  A
leaf then reaches its subroot in one join for each round, and the root through its source's own proof, that is in log2(depth)
joins, whose right sides shrink to a third for each level.

Places in a source come from one sort by (source, doc_id, leaf) into ranges, counts for each range and sums of these counts, so a
source that holds most rows is spread over all tasks.  Tables of levels and segments lie in the shared folder.

Defined results: a null source is a source of its own and comes first; rows with a null doc_id come first in their source and are never
tampered with; rows that share a doc_id are ordered by leaf, and equal rows are leaves of their own, side by side; a lone leaf is its
source's subroot and a lone subroot the root, and the proof without siblings is the digest of the empty text; an empty table gives
no rows; other columns than the five are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import stored

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)), 256))


def manifest_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, and ``other``: the leaf of the row with the columns of ``tampered`` in place of its own, null without these."""
    own = [F.col(c) for c in columns]
    other = leaf(*((tampered or {}).get(c, F.col(c)) for c in columns)) if tampered else F.lit(None).cast("binary")
    return docs.select("doc_id", "source", leaf(*own).alias("leaf"), other.alias("other"))


def numbered(leaves: DataFrame) -> DataFrame:
    """The same rows with ``tree`` (rank of the source from 0, null first), ``pos`` (place within it from 0) and ``n`` (rows of the source)."""
    dealt = leaves.repartitionByRange("source", "doc_id", "leaf").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, like="leaves")
    # one row for each range and source that meet
    runs = stored(dealt.groupBy("part", "source").agg(F.count("*").alias("rows")), like="runs")
    runs = runs.withColumn("run", F.row_number().over(W.partitionBy("part").orderBy("source")) - 1)
    # one row for each range: does it go on with the source that the range before ended with?
    ends = runs.groupBy("part").agg(F.min_by(F.struct("source"), "run").alias("first"), F.max_by(F.struct("source"), "run").alias("last"), F.count("*").alias("sources"))
    by_part = W.orderBy("part")
    goes_on = F.coalesce((F.col("first") == F.lag("last").over(by_part)).cast("int"), F.lit(0))
    ends = ends.withColumn("goes_on", goes_on)
    ends = ends.withColumn("tree0", F.sum(F.col("sources") - F.col("goes_on")).over(by_part) - F.col("sources"))
    runs = runs.join(ends.select("part", "tree0"), "part").select("part", "source", "rows", (F.col("tree0") + F.col("run")).cast("long").alias("tree"))
    of_tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select(F.col("part").alias("in_part"), F.col("source").alias("of"), "tree", before.alias("before"), F.sum("rows").over(of_tree).alias("n")), like="places")
    within = F.row_number().over(W.partitionBy("part", "source").orderBy("doc_id", "leaf")) - 1
    placed = dealt.withColumn("within", within).join(runs, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    return placed.select(*leaves.columns, "tree", (F.col("before") + F.col("within")).alias("pos"), "n")


def _joined(kids: Column) -> Column:
    """Digests of a list of (pos, d), one after the other, as bytes."""
    return F.aggregate(kids, F.lit(b"").cast("binary"), lambda all_, k: F.concat(all_, k["d"]))


def grow(leaves: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """From ``tree``, ``pos``, ``n`` and ``d`` of the leaves of trees of ``most`` leaves at most: (nodes, roots).

    Nodes: tree, level, pos and ``seg``, a list of one pair of bytes: siblings to the left and to the right.  None where no tree has
    two leaves.  Roots: tree, d."""
    level, nodes, now, roots = 0, None, leaves.select("tree", "pos", "n", "d"), None
    while True:
        ended = now.where("n = 1").select("tree", "d")
        roots = ended if roots is None else roots.unionByName(ended)
        if most <= 1:
            return nodes, roots
        up = now.where("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("kids"), F.max("n").alias("n"))
        up = stored(up, like=f"level{level + 1}")
        each = up.select("tree", "kids", F.posexplode("kids").alias("slot", "kid"))
        left, right = _joined(F.slice("kids", 1, F.col("slot"))), _joined(F.expr(f"slice(kids, slot + 2, {ARITY})"))
        edges = each.select("tree", F.lit(level).alias("level"), F.col("kid.pos").alias("pos"), F.array(F.struct(left.alias("l"), right.alias("r"))).alias("seg"))
        nodes = edges if nodes is None else nodes.unionByName(edges)
        now = up.select("tree", F.col("up").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.unhex(F.sha2(_hex(_joined(F.col("kids"))), 256)).alias("d"))
        level, most = level + 1, -(-most // ARITY)


def _up(df: DataFrame, steps: DataFrame, levels: int, at: Column | None = None) -> DataFrame:
    """Append to ``seg`` the segment of the ancestor ``levels`` above (at ``at``), where there is one."""
    s = steps.select(F.col("tree").alias("s_tree"), F.col("level").alias("s_level"), F.col("pos").alias("s_pos"), F.col("seg").alias("s_seg"))
    on = (F.col("tree") == F.col("s_tree")) & (F.expr(f"pos div {ARITY**levels}") == F.col("s_pos"))
    if at is not None:
        on &= at == F.col("s_level")
    grown = F.when(F.col("s_seg").isNull(), F.col("seg")).otherwise(F.concat("seg", "s_seg"))
    return df.join(s, on, "left").select(*[c for c in df.columns if c != "seg"], grown.alias("seg"))


def to_root(leaves: DataFrame, nodes: DataFrame | None, most: int) -> DataFrame:
    """``leaves`` (with tree and pos) with ``seg``: the segments from each leaf to the root of its tree, by pointer jumping."""
    out = leaves.withColumn("seg", F.expr("cast(array() as array<struct<l: binary, r: binary>>)"))
    if nodes is None:
        return out
    depth = 0
    while ARITY**depth < most:
        depth += 1
    out = _up(out, nodes.where("level = 0"), 0)
    steps, jump = nodes.where("level > 0"), 1
    while jump < depth:
        # here the nodes of levels jump, 2 jump, ... hold the segments of the next ``jump`` levels
        out = _up(out, steps.where(F.col("level") == jump), jump)
        upper = steps.where(F.col("level") % (2 * jump) == 0)
        steps = stored(_up(upper, steps.where(F.col("level") % (2 * jump) == jump), jump, F.col("level") + jump), like=f"jump{2 * jump}")
        jump *= 2
    return out


def fold(start: Column, seg: Column) -> Column:
    """The root that a leaf's digest and its segments lead to, as hex text."""
    return F.aggregate(seg, _hex(start), lambda d, s: F.sha2(F.concat(_hex(s["l"]), d, _hex(s["r"])), 256))


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, other, subroot, root (32 bytes each) and ``seg``, the siblings from the leaf to the root."""
    leaves = numbered(manifest_leaves(docs, columns, tampered))
    leaves = stored(leaves, like="numbered")
    most, trees = leaves.agg(F.max("n"), F.max("tree")).first()
    most, trees = most or 0, 0 if trees is None else trees + 1
    nodes, roots = grow(leaves.withColumn("d", F.col("leaf")), most)
    roots = stored(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "d"), like="subroots")
    top_nodes, root = grow(roots, trees)
    tops = to_root(roots.join(root.select(F.col("tree").alias("r_tree"), F.col("d").alias("root")), F.col("tree") == F.col("r_tree")), top_nodes, trees)
    tops = stored(tops.select(F.col("pos").alias("of"), F.col("d").alias("subroot"), "root", F.col("seg").alias("top")), like="tops")
    out = to_root(leaves, nodes, most).join(tops, F.col("tree") == F.col("of"))
    return out.select("doc_id", "source", "leaf", "other", "subroot", "root", F.concat("seg", "top").alias("seg"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The registered form: rows whose crc32 of doc_id is even are folded from a leaf whose text has lost its line feeds."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = manifest(docs, tampered={"text": text})
    siblings = F.concat_ws("", F.transform("seg", lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))))
    m = m.select("doc_id", *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("other"), F.col("seg")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB SQL: eight shifts for each byte."""
    shift = "if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1)"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {shift})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {byte}), 4294967295)"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


#: The registered form in DuckDB SQL.
ORACLE = f"""
with recursive d as (
  select *, case when coalesce({_crc32_sql("doc_id::varchar")} % 2 = 0, false) then replace(text, chr(10), '') else text end as changed from documents),
l as (
  select doc_id, source, sha256({" || ".join(map(_field_sql, COLUMNS))}) as leaf,
         sha256({" || ".join(_field_sql("changed" if c == "text" else c) for c in COLUMNS)}) as other from d),
leaves as materialized (
  select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by source) as n from l),
nodes(tree, level, pos, n, d) as (
  select tree, 0, pos, n, leaf from leaves
  union all
  select tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 3),
sub as materialized (select tree, d as subroot, level as height from nodes where n = 1),
tops(level, pos, n, d) as (
  select 0, tree, count(*) over (), subroot from sub
  union all
  select level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' order by pos)) from tops where n > 1 group by level, pos // 3),
sides as materialized (
  select a.tree, a.level, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
top_sides as materialized (
  select a.level, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from tops a join tops b on a.level = b.level and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
low(row, tree, pos, level, said, folded) as (
  select row_number() over (), tree, pos, 0, '', other from leaves
  union all
  select row, low.tree, low.pos // 3, low.level + 1, said || l || r, sha256(l || folded || r) from low join sides s on s.tree = low.tree and s.level = low.level and s.pos = low.pos),
ids as (select row_number() over () as row, doc_id, leaf from leaves),
high(row, tree, pos, level, said, folded) as (
  select row, low.tree, low.tree, 0, said, folded from low join sub on sub.tree = low.tree and sub.height = low.level
  union all
  select row, high.tree, high.pos // 3, high.level + 1, said || l || r, sha256(l || folded || r) from high join top_sides s on s.level = high.level and s.pos = high.pos)
select doc_id, leaf, subroot, root, sha256(said) as proof_sha256, folded as folded_root, folded = root as verified
from high join ids using (row) join sub using (tree), (select d as root, level as top from tops where n = 1) where high.level = top
"""
