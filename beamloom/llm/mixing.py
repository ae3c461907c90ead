"""Mixing sources to target weights by temperature. DataFrame operations only.

Token shares p of the sources are raised to an exponent and normalised: w ~ p^x. x = 1 keeps the natural mix, x = 0 is
uniform. The exponent is found by bisection on [0, 1]: the largest x whose weights reach the target entropy, raised where needed
until the repetition limit holds (both entropy and repetition fall as x grows). Each step is an aggregate over the
source table, which stays a table: 64 trial exponents at once cut the interval by 64.

The target is a share of the greatest entropy (entropy_share), or lies on the way from the natural mix's entropy to the
uniform one's (toward_uniform), which binds wherever sources are uneven.

The budget defaults to the smallest at which every source has `fewest` whole passes: with one or more, no document is
left out. A source of T tokens with budget share B is realised as B / T passes over a pseudo-random permutation of its
documents: whole passes give every document, each in its own order, the last pass a prefix of the permutation, up to the
document that crosses the budget. Documents are dealt to blocks: block b of a source's stream holds its tokens in
[b, b + 1) * (w * block budget), so each block has the target weights. A block is a BLOCKS-th of the budget unless its
tokens are told.

Prefix sums along a permutation would put one source in one task. Documents are therefore split by leading bits of
their permutation key into buckets of about BUCKET_ROWS rows, and buckets into groups of GROUP_BUCKETS; groups' sums are
accumulated per source, buckets' within their group, and rows within their bucket. Rows of one source that share id,
bytes and words are one row with a number before that, so rows that are repeated often don't fill a bucket; they lie one
after the other in the permutation.

Defined results: a null text is empty, a null source is a source of its own; documents without words cost no tokens
and go with their neighbours; very long texts are counted whole; ties of a permutation go by id; repeated rows are
separate documents; a source without tokens has one pass over its rows; extra columns are kept by mix() and ignored by
mix_plan(); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timeseries import explode_range
from .common import WORD, whole_text, written
from .filters import columns_of, free_name

BUCKET_ROWS = 2000
GROUP_BUCKETS = 2000
BLOCKS = 64
TRIALS, ROUNDS = 64, 6
KEY_BITS = 40


def token_count(text: str | Column = "text") -> Column:
    """Words of the whole text."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _trial(shares: DataFrame, low: float, high: float) -> list:
    """(x, entropy, repeats) at TRIALS + 1 exponents over [low, high]: one aggregate, one small row each."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(TRIALS))).alias("step")
    terms = shares.select("p", steps).withColumn("x", F.lit(low) + F.col("step") * F.lit((high - low) / TRIALS)).withColumn("power", F.pow("p", "x"))
    # with Z the sum of powers, entropy = ln Z - x * sum(power * ln p) / Z; passes go as power / p, the least is one pass
    passes = F.col("power") / F.col("p")
    sums = terms.groupBy("x").agg(
        F.sum("power").alias("z"), F.sum(F.col("power") * F.log("p")).alias("logs"), F.max(passes).alias("most"), F.min(passes).alias("least")
    )
    out = sums.select("x", (F.log("z") - F.col("x") * F.col("logs") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repeats"))
    return out.orderBy("x").collect()


def fit_exponent(shares: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The exponent in [0, 1] closest to the natural mix that reaches `entropy` nats, but within `repeats` passes."""

    def largest(holds) -> float:
        """Bisection: holds(row) is true up to some exponent and false beyond it."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = _trial(shares, low, high)
            if not rows or holds(rows[-1]):
                return high
            good = [r["x"] for r in rows if holds(r)]
            if not good:
                return low
            low, high = good[-1], next(r["x"] for r in rows if r["x"] > good[-1])
        return low

    x = 1.0 if entropy is None else largest(lambda r: r["entropy"] >= entropy)
    if repeats is not None:
        x = max(x, largest(lambda r: r["repeats"] > repeats))
    return x


def weights(measured: DataFrame, entropy_share: float | None, toward_uniform: float | None, repeats: float | None, budget: int | None, fewest: float) -> DataFrame:
    """(source, tokens, docs, kinds, weight, passes) of measured(source, n_tokens, rows); passes = budget share over tokens."""
    sources = measured.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("tokens"), F.sum("rows").alias("docs"), F.count(F.lit(1)).alias("kinds"))
    sources = written(sources, "sources")
    known = sources.filter("tokens > 0")
    total, count = known.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = float(total or 1)
    shares = known.select((F.col("tokens") / F.lit(total)).alias("p"))
    most = math.log(count or 1)
    target = None if entropy_share is None else entropy_share * most
    if toward_uniform is not None:
        natural = shares.agg(F.sum(-F.col("p") * F.log("p"))).first()[0] or 0.0
        target = max(target or 0.0, natural + toward_uniform * (most - natural))
    x = fit_exponent(shares, target, repeats)
    z, least = shares.agg(F.sum(F.pow("p", F.lit(x))), F.min(F.pow("p", F.lit(x)) / F.col("p"))).first()
    z = z or 1.0
    # a source's passes are budget * weight / tokens; by default the fewest passes are `fewest`
    scale = fewest / (least or 1.0) if budget is None else budget / (z * total)
    share = F.col("tokens") / F.lit(total)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(x)) / F.lit(z)).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.pow(share, F.lit(x)) / share * F.lit(scale)).otherwise(1.0)
    near = F.abs(passes - F.round(passes)) < 1e-9
    passes = F.when(near, F.round(passes)).otherwise(passes)
    return written(sources.select("source", "tokens", "docs", "kinds", weight.alias("weight"), passes.alias("passes")), "weights")


def permutation_key(seed: int, copy: Column) -> Column:
    """A document's place in the permutation of its source's pass `copy`."""
    drawn = F.xxhash64(F.lit(seed), copy.cast("int"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.octet_length(whole_text()))
    return F.shiftrightunsigned(drawn, 64 - KEY_BITS)


def realised(docs: DataFrame, entropy_share, toward_uniform, repeats, budget, fewest, seed) -> tuple[DataFrame, DataFrame]:
    """Each copy of each document with its place in its source's stream, and the source table."""
    most = F.octet_length(whole_text()).alias("bytes")
    kinds = docs.select(F.col("doc_id"), "source", token_count().alias("n_tokens"), most).groupBy("doc_id", "source", "n_tokens", "bytes")
    measured = written(kinds.agg(F.count(F.lit(1)).alias("rows")), "measured")
    mix = weights(measured, entropy_share, toward_uniform, repeats, budget, fewest)
    joined = measured.join(mix, measured["source"].eqNullSafe(mix["source"])).drop(mix["source"])
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("passes").cast("int") - 1))))
    drawn = F.xxhash64(F.lit(seed), F.col("copy").cast("int"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("bytes"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("kinds") / BUCKET_ROWS))
    copies = copies.withColumn("key", F.shiftrightunsigned(drawn, 64 - KEY_BITS))
    copies = copies.withColumn("bucket", F.floor(F.col("key") * buckets / float(1 << KEY_BITS)).cast("long"))

    place = ["source", "copy", "bucket"]
    inside = Window.partitionBy(*place).orderBy("key", "doc_id", "bytes", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("n_tokens") * F.col("rows")
    sums = copies.groupBy(*place).agg(F.sum(taken).alias("sum")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    upper = ["source", "copy", "group"]
    along = Window.partitionBy("source").orderBy("copy", "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(*upper).agg(F.sum("sum").alias("sum"))
    groups = groups.select(*[F.col(c).alias(f"g_{c}") for c in upper], F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("start"))
    earlier = Window.partitionBy(*upper).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    bases = sums.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("copy") == F.col("g_copy")) & (F.col("group") == F.col("g_group")))
    bases = bases.select(*[F.col(c).alias(f"b_{c}") for c in place], (F.col("start") + F.col("inside")).alias("base"))
    ranked = copies.withColumn("before", F.coalesce(F.sum(taken).over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("copy") == F.col("b_copy")) & (F.col("bucket") == F.col("b_bucket"))
    ranked = explode_range(ranked.join(bases, same), F.lit(0), F.col("rows") - 1, "nth")
    ranked = ranked.withColumn("position_tokens", F.col("base") + F.col("before") + F.col("nth") * F.col("n_tokens"))
    allowed = (F.col("copy") < F.floor("passes")) | (F.col("position_tokens") < F.col("passes") * F.col("tokens"))
    return ranked.filter(allowed), mix


def mix_plan(
    docs: DataFrame, entropy_share: float | None = None, toward_uniform: float | None = 0.5, repeats: float | None = 4.0, budget: int | None = None, fewest: float = 1.0, block_tokens: int | None = None, seed: int = 7,
) -> DataFrame:
    """(doc_id, source, n_tokens, copy, block, position_tokens, weight, passes) for each realised copy of each document.

    entropy_share: target entropy as a share of the logarithm of the number of sources. toward_uniform: target entropy as
    a share of the way from the natural mix's to that logarithm; of both the greater counts, and it gives way to
    `repeats`, the most passes over a source against the fewest. fewest: passes over the source that has the fewest,
    unless a budget is told. copy: 0 on the first pass. position_tokens: tokens of the source's stream before the document.
    """
    ranked, _ = realised(docs, entropy_share, toward_uniform, repeats, budget, fewest, seed)
    at, stream = F.col("position_tokens"), F.col("passes") * F.col("tokens")
    blocks = at * BLOCKS / stream if block_tokens is None else at / (F.col("weight") * block_tokens)
    block = F.when(F.col("weight") > 0, F.floor(blocks)).otherwise(0)
    return ranked.select("doc_id", "source", "n_tokens", "copy", block.cast("long").alias("block"), "position_tokens", "weight", "passes")


def mix(docs: DataFrame, entropy_share: float | None = None, toward_uniform: float | None = 0.5, repeats: float | None = 4.0, budget: int | None = None, fewest: float = 1.0, seed: int = 7) -> DataFrame:
    """docs with each document as often as mix_plan() realises it; the columns of docs, in no order.

    Texts are not shuffled: a source's last pass ends at one place of its permutation, and each document compares its
    own key with that. Rows that share an id are in the last pass together.
    """
    ranked, sources = realised(docs, entropy_share, toward_uniform, repeats, budget, fewest, seed)
    last = ranked.filter(F.col("copy") == F.floor("passes")).groupBy("source").agg(F.max("key").alias("key"))
    ends = sources.join(last, sources["source"].eqNullSafe(last["source"]), "left")
    name, whole, key, copy = (free_name(docs, x) for x in ("__source", "__whole", "__key", "__copy"))
    cuts = written(ends.select(sources["source"].alias(name), F.floor("passes").cast("int").alias(whole), F.coalesce("key", F.lit(-1)).alias(key)), "cuts")
    joined = docs.join(cuts, docs["source"].eqNullSafe(cuts[name]))
    copies = F.col(whole) + (permutation_key(seed, F.col(whole)) <= F.col(key)).cast("int")
    return joined.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*columns_of(docs))
