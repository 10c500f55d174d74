"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are w = share ** alpha, normalised, with shares by tokens. The exponent is found by bisection between 1 (as the
corpus is) and 0 (all sources alike), so that the weights' entropy or the most-repeated source meets a target. A source's
token quota is then filled by passes over its blocks, each pass in another random order; the last pass ends at the block
that comes nearest to the quota. Where blocks begin is a prefix sum in two levels, so that no task holds a source's blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, quoted, saved

#: A source has at least so many blocks (if it has so many rows), and at most so many rows a block on average.
LEAST_BLOCKS, BLOCK_ROWS = 64, 1024
#: Blocks whose places one task works out.
STRETCH = 1024
#: Up to so many sources their table is broadcast (tens of bytes each); beyond, it is joined by shuffling.
BROADCAST_SOURCES = 100_000
#: Exponents tried in one pass over the source table: five bisections at once.
AT_ONCE, PASSES = 31, 6


def token_count(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """Text that also tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def exponent(sources: DataFrame, entropy: float | None = None, max_repetition: float | None = None, evenness: float | None = None) -> float:
    """The exponent in [0, 1] for one target, over sources (tokens) that have any tokens.

    entropy: of the weights, in nats; ValueError if no exponent in [0, 1] gives it. evenness, in [0, 1]: the entropy that
    lies so far between the corpus's own and the largest one, which there always is. max_repetition: how often the most
    repeated source may be seen where the least repeated one is seen once; the smallest exponent, which mixes most evenly,
    that keeps to it: 0 if the limit doesn't bind. Sources that are all alike give 1.
    """
    if sum(x is not None for x in (entropy, max_repetition, evenness)) != 1:
        raise ValueError("give one target: entropy, max_repetition or evenness")
    known = sources.where("tokens > 0")
    share = lambda total: F.col("tokens") / F.lit(float(total))
    total, most, least, n = known.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not total or most == least:
        return 1.0
    if max_repetition is not None and most / least <= max_repetition:
        return 0.0
    if max_repetition is None:
        own = known.agg(-F.sum(share(total) * F.log(share(total)))).first()[0]
        if evenness is not None:
            entropy = own + evenness * (math.log(n) - own)
        if not own - 1e-9 <= entropy <= math.log(n) + 1e-9:
            raise ValueError(f"the weights' entropy can be {own:.6g} to {math.log(n):.6g} nats, not {entropy:.6g}")
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        tried = [lo + (hi - lo) * (i + 1) / (AT_ONCE + 1) for i in range(AT_ONCE)]
        if max_repetition is None:
            sums = known.agg(*(f for a in tried for f in (F.sum(share(total) ** a), F.sum(share(total) ** a * F.log(share(total)))))).first()
            # entropy falls as the exponent rises
            met = [math.log(sums[2 * i]) - a * sums[2 * i + 1] / sums[2 * i] >= entropy for i, a in enumerate(tried)]
        else:
            met = [(most / least) ** (1 - a) > max_repetition for a in tried]
        k = sum(met)  # true for the smaller exponents
        lo, hi = ([lo, *tried][k], [*tried, hi][k])
        if hi - lo < 1e-9:
            break
    return (lo + hi) / 2 if max_repetition is None else hi


def mix(docs: DataFrame, entropy: float | None = None, max_repetition: float | None = None, evenness: float | None = None, budget: float | None = None, seed: int = 7) -> DataFrame:
    """The columns of ``docs`` (it must have doc_id, text and source) and _mix_tokens, _mix_epoch, _mix_weight, _mix_key.

    A row appears once for each pass over its block. _mix_key, in [0, 1), orders the mixture: sorting by it interleaves
    the sources in proportion. ``budget`` is the mixture's tokens; by default the least under which every source is seen
    at least once, so that no row is left out. Null is a source of its own. Rows of sources without any token appear once
    at weight 0. Repeated rows are taken as they come; rows with the same doc_id share a block and a key. Where ``docs``
    has a column of such a name, the new one has underscores appended. An empty table gives none.
    """
    thin = saved(docs.select(source_key().alias("s"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), token_count().alias("t")), "mix-rows")
    sources = saved(thin.groupBy("s").agg(F.sum("t").alias("tokens"), F.count("*").alias("n")), "mix-sources")
    alpha = exponent(sources, entropy, max_repetition, evenness)
    z, n_sources = sources.agg(F.sum(F.when(F.col("tokens") > 0, F.col("tokens").cast("double") ** alpha)), F.count("*")).first()
    weight = F.when(F.col("tokens") > 0, F.col("tokens").cast("double") ** alpha / F.lit(z or 1.0)).otherwise(0.0)
    weighted = sources.withColumn("weight", weight)
    if budget is None:
        budget = weighted.agg(F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("weight")))).first()[0] or 0.0
    blocks = F.least(F.col("n"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS))).cast("long")
    plan = saved(weighted.withColumn("blocks", blocks).withColumn("quota", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(budget))).otherwise(0.0)), "mix-plan")
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)

    block = F.pmod("h", F.col("blocks")).alias("block")
    sized = thin.join(hint(plan.select("s", "blocks")), "s").groupBy("s", block).agg(F.sum("t").alias("t"))
    passes = F.coalesce(F.ceil(F.try_divide(F.col("quota"), F.col("tokens")) - 1e-9), F.lit(1)).cast("int")
    epochs = F.sequence(F.lit(1), F.greatest(F.lit(1), passes))
    dealt = sized.join(hint(plan.select("s", "tokens", "quota", "weight", "blocks")), "s").withColumn("epoch", F.explode(epochs))
    # where a block begins in its pass: stretches of the random order are summed first, and blocks within each
    turn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "s", "block"), 11).cast("double") / float(1 << 53)
    dealt = dealt.withColumn("turn", turn).withColumn("stretch", F.floor(F.col("turn") * F.ceil(F.col("blocks") / STRETCH)).cast("long"))
    before = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = dealt.groupBy("s", "epoch", "stretch").agg(F.sum("t").alias("t"))
    stretches = stretches.select("s", "epoch", "stretch", before(Window.partitionBy("s", "epoch").orderBy("stretch")).alias("base"))
    start = F.col("base") + before(Window.partitionBy("s", "epoch", "stretch").orderBy("turn", "block"))
    limit = F.least(F.col("tokens").cast("double"), F.col("quota") - (F.col("epoch") - 1) * F.col("tokens"))
    # a block is taken if more than half of it lies within the quota
    schedule = dealt.join(stretches, ["s", "epoch", "stretch"]).withColumn("start", start).where((F.col("tokens") == 0) | (F.col("start") + F.col("t") / 2 <= limit + 1e-6 * F.col("tokens")))
    at = (F.col("epoch") - 1) * F.col("tokens") + F.col("start")
    schedule = saved(schedule.select("s", "block", "epoch", "weight", at.alias("at"), "t", "quota"), "mix-schedule")

    # rows meet the schedule as one struct, so that their columns may have any name
    own = docs.select(F.struct(*quoted(docs)).alias("row"), source_key().alias("s"), token_count().alias("n"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    own = own.join(hint(plan.select("s", "blocks")), "s").withColumn("block", F.pmod("h", "blocks"))
    mixed = own.join(schedule, ["s", "block"])
    # rows of a block lie between its ends, in an order of their own
    within = F.shiftrightunsigned(F.xxhash64("h", "epoch"), 11).cast("double") / float(1 << 53)
    key = F.least(F.lit(1 - 1e-12), F.coalesce(F.try_divide(F.col("at") + within * F.col("t"), F.col("quota")), F.lit(0.0)))
    names = free_names(docs, "_mix_tokens", "_mix_epoch", "_mix_weight", "_mix_key")
    return mixed.select("row.*", *(c.alias(x) for c, x in zip((F.col("n"), F.col("epoch"), F.col("weight"), key), names, strict=True)))
