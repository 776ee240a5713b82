"""Mixing sources by temperature.

The weight of a source is its share of all tokens raised to an exponent, normalised.  The exponent lies between 0 (all sources alike) and 1
(as they are); bisection finds the largest one whose mix has the target entropy, and the smallest one that repeats no
source more often than the limit; where both are given, the repetition limit wins.  Only sums over the table of sources are taken for
that, never the table itself.

Weights become tokens of a budget, and tokens become passes over blocks: the texts of a source are dealt into blocks of about
``block_tokens`` by hash, each pass is a permutation of its blocks, full passes take all of them, and the last, partial pass takes blocks in
its order until the budget ends within one, from which texts are taken in the order of a hash.  Every text thus has a number of
``copies``, and the mix overshoots a source's budget by less than one text.  Prefix sums run over blocks of one source and over the
texts of one block; no window holds the texts of a source.

Defined results: texts without tokens (null, empty, white space) are in no mix; a null source is a source of its own; rows that repeat with
one doc_id are decided alike; a source of less than one token of budget is left out; an empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotemill.llm.common import stored

BLOCK_TOKENS = 200_000
#: Shares of the largest possible entropy, and the most passes over a source, of the registered mix.
ENTROPY, REPEATS = 0.95, 4.0
ROUNDS = 50
#: Bisection steps whose possible midpoints one job evaluates together.
LEVELS = 5


def n_tokens(text="text"):
    """White-space separated tokens."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^ \t\n\r\f\x0b]+")).cast("long")


def _draw(*parts):
    """A number from 0 to 2**60 - 1 that the parts decide."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(15)), 16, 10).cast("long")


def source_tokens(docs: DataFrame, tokens=None) -> DataFrame:
    """source, tokens; sources without tokens are left out."""
    return docs.select("source", (n_tokens() if tokens is None else tokens).alias("t")).groupBy("source").agg(F.sum("t").alias("tokens")).where("tokens > 0")


def _all_moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Per exponent: sum of share**e, the entropy of the mix, and its largest weight relative to the share; one job for all."""
    each = shares.select("share", F.posexplode(F.array(*map(F.lit, exponents))).alias("k", "e"))
    power = F.pow("share", "e")
    sums = each.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(power / F.col("share")).alias("top"))
    return [(z, math.log(z) - exponents[k] * s / z, top / z) for k, z, s, top in sorted(sums.collect())]  # one row per exponent


def _moments(shares: DataFrame, exponent: float) -> tuple[float, float, float]:
    return _all_moments(shares, [exponent])[0]


def _halvings(lo: float, hi: float, levels: int) -> list[float]:
    """The midpoints that ``levels`` bisection steps can meet, as a heap: after place k follow 2k + 1 (lower half) and 2k + 2."""
    spans, out = [(lo, hi)], []
    for k in range(2**levels - 1):
        a, b = spans[k]
        out.append((a + b) / 2)
        spans += [(a, out[k]), (out[k], b)]
    return out


def temperature(shares: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_ratio: float = 1.0, rounds: int = ROUNDS) -> float:
    """The exponent for a target entropy (in nats) and a limit of passes; ``budget_ratio`` is budget over available tokens."""

    def bisect(holds) -> float:
        """The largest exponent in [0, 1] where a condition that holds towards 0 holds; ``LEVELS`` steps a job."""
        if holds(_moments(shares, 1.0)):
            return 1.0
        lo, hi = 0.0, 1.0
        for done in range(0, rounds, LEVELS):
            levels, k = min(LEVELS, rounds - done), 0
            mids = _halvings(lo, hi, levels)
            moments = _all_moments(shares, mids)
            for _ in range(levels):
                ok = holds(moments[k])
                lo, hi, k = (mids[k], hi, 2 * k + 2) if ok else (lo, mids[k], 2 * k + 1)
        return lo

    exponent = 1.0 if entropy is None else bisect(lambda m: m[1] >= entropy)
    if repeats is not None and _moments(shares, exponent)[2] * budget_ratio > repeats:
        exponent = max(exponent, bisect(lambda m: m[2] * budget_ratio > repeats))
    return exponent


def mix_weights(docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, tokens=None) -> DataFrame:
    """source, tokens, weight, goal (tokens of the budget); ``entropy`` is a share of the logarithm of the number of sources."""
    sources = stored(source_tokens(docs, tokens), like="sources")
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("goal"))
    budget = total if budget is None else budget
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(total)))
    exponent = temperature(shares, None if entropy is None else entropy * math.log(n), repeats, budget / total)
    z = _moments(shares, exponent)[0]
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    return shares.select("source", "tokens", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + 1e-6).cast("long").alias("goal"))


def mix(docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """doc_id, source, n_tokens, copies, block, block_order (place of the block in the partial pass) and draw (order within
    a block) of every text with at least one copy."""
    rows = stored(docs.select("doc_id", "source", n_tokens().alias("n_tokens")).where("n_tokens > 0"), like="tokens")
    goals = mix_weights(rows, budget, entropy, repeats, F.col("n_tokens"))
    goals = goals.select(F.col("source").alias("of"), "tokens", "goal", F.ceil(F.col("tokens") / block_tokens).cast("long").alias("n_blocks"), F.floor(F.col("goal") / F.col("tokens")).cast("long").alias("passes"))
    goals = stored(goals.withColumn("rest", F.col("goal") - F.col("passes") * F.col("tokens")), like="goals")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = rows.join(goals, rows["source"].eqNullSafe(goals["of"])).withColumn("draw", _draw(F.lit(seed), name))
    dealt = dealt.withColumn("block", F.pmod(_draw(F.lit(seed), F.lit("block"), name), F.col("n_blocks")))
    blocks = dealt.groupBy("of", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest"))
    turn = _draw(F.lit(seed), F.coalesce("of", F.lit("")), F.col("block").cast("string"))
    order = W.partitionBy("of").orderBy(turn, "block")
    blocks = blocks.withColumn("block_order", F.row_number().over(order).cast("long")).withColumn("ahead", F.sum("in_block").over(order.rowsBetween(W.unboundedPreceding, -1)))
    blocks = stored(blocks.select("of", "block", "block_order", F.greatest(F.lit(0), F.col("rest") - F.coalesce("ahead", F.lit(0))).alias("room"), "in_block"), like="blocks")
    b = blocks.withColumnRenamed("of", "of_b").withColumnRenamed("block", "block_b")
    placed = dealt.join(b, dealt["of"].eqNullSafe(b["of_b"]) & (dealt["block"] == b["block_b"]))
    # the block in which the budget ends: texts in order until it is spent
    cut = placed.where("room > 0 and room < in_block").groupBy("of", "block", "doc_id", "draw").agg(F.sum("n_tokens").alias("t"), F.first("room").alias("room"))
    before = F.sum("t").over(W.partitionBy("of", "block").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    taken = cut.withColumn("before", F.coalesce(before, F.lit(0))).where("before < room").select(F.col("of").alias("of_t"), F.col("doc_id").alias("id_t"), F.lit(1).cast("long").alias("taken"))
    placed = placed.join(taken, placed["doc_id"].eqNullSafe(taken["id_t"]) & placed["of"].eqNullSafe(taken["of_t"]), "left")
    extra = F.when(F.col("room") >= F.col("in_block"), 1).otherwise(F.coalesce("taken", F.lit(0))).cast("long")
    return placed.withColumn("copies", F.col("passes") + extra).where("copies > 0").select("doc_id", "source", "n_tokens", "copies", "block", "block_order", "draw")


def realise(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, once for each copy, with ``epoch`` (from 1) and ``mix_order``: sorted by both, each pass over
    a source runs through its blocks in an order of its own, and sources are interleaved.  Where ``docs`` has such a column, the
    new one is called ``mix_epoch`` or ``mix_mix_order``."""
    plan = chosen.groupBy(F.col("doc_id").alias("of"), F.col("source").alias("from")).agg(F.max("copies").alias("copies"), F.min("block").alias("block"), F.min("draw").alias("draw"))
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    joined = rows.join(plan, rows["row"].getField("doc_id").eqNullSafe(plan["of"]) & rows["row"].getField("source").eqNullSafe(plan["from"]))
    each = joined.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = _draw(F.col("epoch").cast("string"), F.coalesce("from", F.lit("")), F.col("block").cast("string"))
    place = F.concat_ws("-", F.lpad(order.cast("string"), 19, "0"), F.lpad(F.col("draw").cast("string"), 19, "0"))
    new = {c: c if c not in docs.columns else f"mix_{c}" for c in ("epoch", "mix_order")}
    own = (F.col("row").getField(c).alias(c) for c in docs.columns)
    return each.select(*own, F.col("epoch").alias(new["epoch"]), place.alias(new["mix_order"]))


#: The registered mix in DuckDB SQL.
ORACLE = r"""
with recursive rows0 as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0b]+'))::bigint as n_tokens from documents),
r as materialized (select * from rows0 where n_tokens > 0),
src as materialized (select source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double / sum(sum(n_tokens)) over () as share from r group by source),
tot as (select sum(tokens)::bigint as total, 0.95 * ln(count(*)) as want from src),
start as (select (select -sum(share * ln(share)) from src) >= (select want from tot) as whole),
step(k, lo, hi) as (
  select 0, case when whole then 1.0 else 0.0 end::double, 1.0::double from start
  union all
  select k + 1, case when ok then mid else lo end, case when ok then hi else mid end
  from (select k, lo, hi, (lo + hi) / 2 as mid,
               (select ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) from src) >= (select want from tot) as ok
        from step where k < 50)),
x1 as (select max(lo) as e from step where k = (select max(k) from step)),
over1 as (select (select max(pow(share, e) / share) / sum(pow(share, e)) from src) > 4.0 as bad, e from x1),
step2(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when ok then mid else lo end, case when ok then hi else mid end
  from (select k, lo, hi, (lo + hi) / 2 as mid, (select max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) from src) > 4.0 as ok from step2 where k < 50)),
ex as (select case when bad then greatest(e, (select lo from step2 order by k desc limit 1)) else e end as e from over1),
goal as (select source, tokens, floor(pow(share, e) / (select sum(pow(share, e)) from src) * (select total from tot) + 1e-6)::bigint as goal, ceil(tokens / 200000.0)::bigint as n_blocks from src, ex),
g as materialized (select *, goal // tokens as passes, goal - (goal // tokens) * tokens as rest from goal),
dealt as materialized (
  select r.*, g.passes, g.rest, ('0x' || left(md5('mix:' || coalesce(doc_id::varchar, '')), 15))::bigint as draw,
         ('0x' || left(md5('mix:block:' || coalesce(doc_id::varchar, '')), 15))::bigint % n_blocks as block
  from r join g on r.source is not distinct from g.source),
bl as (select source, block, sum(n_tokens)::bigint as in_block, any_value(rest) as rest, ('0x' || left(md5('mix:' || coalesce(source, '') || ':' || block), 15))::bigint as turn from dealt group by source, block),
bo as (select *, row_number() over w as block_order, coalesce(sum(in_block) over (partition by source order by turn, block rows between unbounded preceding and 1 preceding), 0) as ahead from bl window w as (partition by source order by turn, block)),
room as materialized (select source, block, block_order, in_block, greatest(0, rest - ahead)::bigint as room from bo),
placed as materialized (select d.*, block_order, in_block, room from dealt d join room using (block) where d.source is not distinct from room.source),
cut as (select *, coalesce(sum(n_tokens) over (partition by source, block order by draw, doc_id rows between unbounded preceding and 1 preceding), 0) as before from placed where room > 0 and room < in_block),
fin as (select p.*, p.passes + case when p.room >= p.in_block then 1 when c.before < c.room then 1 else 0 end as copies from placed p left join cut c on p.doc_id = c.doc_id)
select doc_id, source, n_tokens, copies::bigint as copies, block, block_order, draw from fin where copies > 0
"""
