"""Temperature mixing: sources to target weights, realised as budgeted block permutations.

A source with the token share p gets the weight p^a / sum of all p^a. The exponent a is bisected
between 0 (all sources alike) and 1 (as they are) until the weights have the wanted entropy and no
source is repeated too often. A weight times the budget is the source's own budget. It is filled
epoch by epoch: each epoch permutes the source's blocks of documents anew, and the last one ends in
the block in which the budget is used up.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import if_small, materialise, running_total
from caseloom.operators.skew import lookup_join

BLOCK_TOKENS = 1_000_000
# Each step tries so many exponents at once and goes on between two of them.
POINTS = 16
STEPS = 8


@dataclass
class Curve:
    """Normaliser, entropy and highest number of repetitions at an exponent."""

    norm: float
    entropy: float
    repeats: float


def curves(shares: DataFrame, exponents: list[float]) -> list[Curve]:
    """One :class:`Curve` an exponent, from one aggregation; repetitions are for a budget of all tokens."""
    power = [F.exp(F.lit(a) * F.col("_log")) for a in exponents]
    sums = []
    for k, p in enumerate(power):
        sums += [F.sum(p).alias(f"z{k}"), F.sum(p * F.col("_log")).alias(f"e{k}"), F.max(p / F.col("_share")).alias(f"r{k}")]
    row = shares.where("_share > 0").agg(*sums).first()
    found = []
    for k, a in enumerate(exponents):
        z = row[f"z{k}"]
        found.append(Curve(z, log(z) - a * row[f"e{k}"] / z, row[f"r{k}"] / z) if z else Curve(1.0, 0.0, 1.0))
    return found


def bisected(shares: DataFrame, enough) -> float:
    """The smallest exponent in [0, 1] at which ``enough`` (rising with the exponent) holds, else 1."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * k / (POINTS - 1) for k in range(POINTS)]
        first = next((k for k, c in enumerate(curves(shares, points)) if enough(c)), POINTS - 1)
        if first == 0:
            return points[0]
        low, high = points[first - 1], points[first]
    return high


def source_weights(
    rows: DataFrame, budget: int | None, entropy_share: float, max_repeats: float
) -> tuple[DataFrame, float]:
    """``_source, _tokens, _docs, _budget, _weight`` by source, and the exponent.

    The entropy may be at most ``entropy_share`` times the logarithm of the number of sources, and
    no source may be repeated more than ``max_repeats`` times; both hold from some exponent on, and
    the smallest such one is taken (1 if there is none). ``budget`` None stands for the smallest
    budget that takes every document at least once.
    """
    totals = materialise(
        rows.groupBy("_source").agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_docs")), "sources"
    )
    seen = totals.agg(F.sum("_tokens"), F.count_if(F.col("_tokens") > 0)).first()
    tokens, sources = seen[0] or 0, seen[1]
    share = F.col("_tokens") / F.lit(float(max(tokens, 1)))
    shares = totals.select("*", share.alias("_share"), F.when(share > 0, F.log(share)).alias("_log"))
    size = (budget or tokens) / max(tokens, 1)
    most = entropy_share * log(sources) if sources > 1 else 0.0
    exponent = bisected(shares, lambda c: c.entropy <= most + 1e-12)

    if budget is None:
        # Repetitions relative to the largest source, which is taken exactly once.
        ends = shares.where("_share > 0").agg(F.max("_share"), F.min("_share")).first()
        largest, smallest = ends[0] or 1.0, ends[1] or 1.0
        ratio = log(largest / smallest)
        least = 0.0 if ratio == 0 else 1 - min(1.0, log(max_repeats) / ratio)
        exponent = max(exponent, least)
        # In units of all tokens.
        size = curves(shares, [exponent])[0].norm * largest ** (1 - exponent)
    else:
        exponent = max(exponent, bisected(shares, lambda c: c.repeats * size <= max_repeats + 1e-12))
    norm = curves(shares, [exponent])[0].norm
    weight = F.when(F.col("_share") > 0, F.exp(F.lit(exponent) * F.col("_log")) / F.lit(norm)).otherwise(0.0)
    # The small addend takes back what rounding took from a whole number.
    planned = F.floor(weight * F.lit(size * tokens) + 1e-3).cast("bigint")
    if budget is None:
        planned = F.greatest(planned, F.col("_tokens"))
    return shares.select("_source", "_tokens", "_docs", planned.alias("_budget"), weight.alias("_weight")), exponent


def mixed_rows(
    docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0,
    seed: int = 0, block_tokens: int = BLOCK_TOKENS, carry: list[str] | None = None,
) -> DataFrame:
    """One row per document and epoch in which the mixture takes it.

    Columns: ``carry`` (default ``doc_id, source``), ``n_tokens`` (words), ``weight`` of the source,
    ``epoch``, ``block`` and ``mix_key``, the place of the block in the source's budget from 0 to 1:
    sorted by it, the sources interleave in their proportions at every point. To carry a column with
    one of these names, carry it inside a struct.

    A block has about ``block_tokens`` words, however large its source is. Rows are dealt to blocks by
    a hash of id, length and source, those without id also of their text, so that only rows equal
    in all of it lie together for certain.

    A source takes whole blocks while its budget lasts, and of the block in which it ends the
    documents, by a hash, that fit; so no source exceeds its budget and none falls short by more
    than a document. A document longer than its source's budget is never taken. A null source is a source of its own. Null and empty texts have no tokens; a
    source without any is taken once. Repeated rows, also of one id, are rows of their own, always
    taken together with their block. An empty table gives an empty result.
    """
    carry = [f"`{c}`" for c in carry or ["doc_id", "source"]]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text"), source, nameless)
    rows = docs.select(F.struct(*carry).alias("_row"), source.alias("_source"), words.alias("_n"), place.alias("_place"))
    # The statistics need no texts; the rows themselves are read again.
    counted = materialise(rows.select("_source", "_n", "_place"), "mix-counts")
    weights, _ = source_weights(counted.select("_source", "_n"), budget, entropy_share, max_repeats)
    plan = materialise(weights.withColumn("_blocks", F.greatest(F.ceil(F.col("_tokens") / block_tokens), F.lit(1))), "mix-plan")
    own_block = F.pmod("_place", "_blocks")
    n_sources = plan.count()

    def with_blocks(some: DataFrame) -> DataFrame:
        sized = plan.select("_source", "_blocks")
        small = if_small(sized, n_sources)
        joined = some.join(small, "_source") if small is not sized else lookup_join(some, sized, "_source", "_place", "inner")
        return joined.withColumn("_block", own_block)

    blocks = materialise(with_blocks(counted).groupBy("_source", "_block").agg(F.sum("_n").alias("_block_tokens")), "mix-blocks")
    # Without a budget no document is dropped, nor a block without words that comes last.
    first = "epoch = 0 and (_tokens = 0 or _block_tokens = 0)" if budget is None else "epoch = 0 and _tokens = 0"
    last = F.when(F.col("_tokens") > 0, F.floor((F.col("_budget") - 1) / F.col("_tokens"))).otherwise(0)
    planned = plan.drop("_blocks")
    turns = (
        blocks.join(if_small(planned, n_sources), "_source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))))
        .withColumn("_turn", F.xxhash64(F.lit(seed), "_source", "epoch", "_block"))
    )
    drawn = (
        running_total(turns, ["_source", "epoch"], ["_turn", "_block"], "_block_tokens", "_before")
        .withColumn("_left", F.col("_budget") - F.col("epoch") * F.col("_tokens") - F.col("_before"))
        .where(f"_left > 0 or ({first})")
        .select(
            "_source", "_block", "epoch", "_left", (F.col("_left") >= F.col("_block_tokens")).alias("_whole"),
            F.col("_weight").alias("weight"),
            F.when(F.col("_budget") > 0, (F.col("epoch") * F.col("_tokens") + F.col("_before")) / F.col("_budget"))
            .otherwise(0.0).alias("mix_key"),
        )
    )
    drawn = materialise(drawn, "mix-draws")
    # A block has a bounded size, so this join has no hot key.
    joined = with_blocks(rows)
    result = ["_row.*", F.col("_n").alias("n_tokens"), "weight", "epoch", F.col("_block").alias("block"), "mix_key"]
    whole = joined.join(drawn.where("_whole"), ["_source", "_block"]).select(*result)
    in_block = Window.partitionBy("_source", "_block", "epoch").orderBy("_turn", "_place", "_n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    part = (
        joined.join(drawn.where("not _whole"), ["_source", "_block"])
        .withColumn("_turn", F.xxhash64(F.lit(seed), "epoch", "_place"))
        .withColumn("_until", F.sum("_n").over(in_block))
        .where("_until <= _left")
        .select(*result)
    )
    return whole.union(part)
