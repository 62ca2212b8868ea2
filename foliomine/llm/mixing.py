"""Temperature mixing of sources.

The weight of a source is its share of all tokens to the power of an exponent,
normalised. The exponent is bisected: it falls from 1 until the weights reach a target
entropy, but no further than the limit on how often a source's documents repeat. A budget
that breaks this limit even at the exponent 1, where all sources repeat alike, is cut to
the tokens that the limit allows. The weights become token budgets, and the budgets blocks: each source is a stream of passes
over its documents, every pass in an order of its own, cut at the budget; block k of n
takes the k-th part of every stream, in a permuted order. So every block holds the
sources in the wanted weights.

Only sums over sources come to the driver, and no step gathers the rows of a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliomine.llm.ordering import running_total
from foliomine.llm.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
POINTS = 15  # exponents tried at once: four steps of a bisection in one job
STEPS = 6


@dataclass(frozen=True)
class Target:
    """What the mixture is to reach.

    ``entropy`` is the entropy of the weights as a share of that of equal weights.
    ``max_repeats`` bounds the tokens taken of a source by so many times those it has,
    whatever the other two ask for; it is 1 at least. ``budget`` counts tokens; None is the
    smallest one that uses every document.
    """

    entropy: float = 0.95
    max_repeats: float = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 20


def n_tokens(text: Column) -> Column:
    """Words of a text and one for its end."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + 1


def _key(source: Column) -> Column:
    """A source's name that joins as a null does not."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _order(number: Column) -> Column:
    return F.xxhash64("doc_id", "n_tokens", number)


def _evaluate(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """``(sum of powers, entropy of the weights)`` of each exponent."""
    log = F.log("share")
    sums = []
    for i, a in enumerate(exponents):
        power = F.exp(log * a)
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * log * a).alias(f"s{i}")]
    row = sources.agg(*sums).first()
    z = [row[f"z{i}"] for i in range(len(exponents))]
    return [(z[i], math.log(z[i]) - row[f"s{i}"] / z[i]) for i in range(len(exponents))]


def find_exponent(sources: DataFrame, total: int, target: Target) -> float:
    """The exponent from 0 to 1 for ``sources(share)``: the largest one at which the
    weights reach the target entropy, or, where its repeats are over the limit, the
    smallest one at which they are not."""
    known = sources.agg(F.count("*").alias("n"), F.min("share").alias("low"), F.max("share").alias("high")).first()
    if known["n"] < 2:
        return 1.0
    enough = target.entropy * math.log(known["n"])

    def repeats(a: float, z: float) -> float:
        if target.budget is None:
            return (known["low"] / known["high"]) ** (a - 1)
        return known["low"] ** (a - 1) / z * target.budget / total

    at_one = _evaluate(sources, [1.0])[0]
    if at_one[1] >= enough:
        return 1.0
    low = [0.0, 0.0]  # of the entropy's bracket, of the limit's
    high = [1.0, 1.0]
    for _ in range(STEPS):
        grids = [[lo + (hi - lo) * k / (POINTS + 1) for k in range(1, POINTS + 1)] for lo, hi in zip(low, high)]
        found = _evaluate(sources, grids[0] + grids[1])
        diverse = [h >= enough for _, h in found[:POINTS]]
        rare = [repeats(a, z) <= target.max_repeats for a, (z, _) in zip(grids[1], found[POINTS:])]
        for side, passed in ((0, [not d for d in diverse]), (1, rare)):
            points = [low[side], *grids[side], high[side]]
            first = passed.index(True) + 1 if any(passed) else POINTS + 1
            low[side], high[side] = points[first - 1], points[first]
    return max(low[0], high[1] if high[1] > 1e-6 else 0.0)


def plan(docs: DataFrame, target: Target) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``doc_id, key, source, n_tokens``, sources ``key, tokens, budget, passes,
    base`` and the number of blocks."""
    rows = docs.select(
        "doc_id", "source", _key(F.col("source")).alias("key"), n_tokens(F.col("text")).alias("n_tokens")
    )
    rows = materialise(rows, "rows")
    sums = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sources = materialise(sums.withColumn("share", F.col("tokens") / F.lit(max(total, 1))), "sources")
    if target.max_repeats < 1:
        raise ValueError("max_repeats is 1 at least")
    if target.budget is not None:
        target = replace(target, budget=min(target.budget, math.floor(total * target.max_repeats)))
    exponent = find_exponent(sources, total, target) if total else 1.0
    z, _ = _evaluate(sources, [exponent])[0] if total else (1.0, 0.0)
    power = F.pow("share", F.lit(exponent))
    if target.budget is None:
        highest = sources.agg(F.max("share")).first()[0] or 1.0
        wanted = total * z * highest ** (1 - exponent)
        budget = F.greatest(F.round(power / z * wanted).cast("long"), F.col("tokens"))
    else:
        wanted = target.budget
        budget = F.round(power / z * wanted).cast("long")
    most = F.floor(F.col("tokens") * F.lit(float(target.max_repeats)))  # rounding may go beyond it
    sources = sources.withColumn("budget", F.least(budget, most))
    sources = sources.withColumn("passes", F.ceil(F.col("budget") / F.col("tokens")).cast("int"))
    sources = sources.withColumn("stream", F.col("tokens") * F.col("passes"))
    sources = materialise(running_total(sources, "stream", "key", column="base"), "budgets")
    return rows, sources, max(1, -(-int(wanted) // target.block_tokens))


def _streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every copy of every document that the budgets hold, with the tokens before it in
    its source's stream."""
    copies = rows.join(sources.select("key", "passes"), "key").where("passes > 0")
    copies = copies.select(
        "doc_id", "source", "key", "n_tokens",
        F.explode_outer(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"),
    )
    copies = copies.withColumn("place", _order(F.col("pass")))
    placed = running_total(copies, "n_tokens", "key", "pass", "place", "doc_id")
    placed = placed.join(sources.select("key", "budget", "base", "passes"), "key")
    placed = placed.withColumn("offset", F.col("before") - F.col("base"))
    return placed.where(F.col("offset") + F.col("n_tokens") <= F.col("budget"))


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """``doc_id, source, n_tokens, pass, block, slot``, a row per copy of a document in
    the mixture; read by block and slot it is the training order.

    Uses ``doc_id``, ``source`` and ``text`` of ``docs``. A null or empty text is its
    end mark alone, a null source is a source, rows of equal ids and texts are copies
    to be mixed like others. A copy is taken if its tokens fit whole into what its
    source's budget has left; without a set budget every document is taken once at
    least. An empty table gives an empty result.
    """
    rows, sources, n_blocks = plan(docs, target)
    taken = _streams(rows, sources)
    block = F.floor(F.col("offset") * F.lit(float(n_blocks)) / F.col("budget")).cast("long")
    permuted = Window.partitionBy("block").orderBy("shuffled", "doc_id", "pass")
    return (
        taken.withColumn("block", F.least(block, F.lit(n_blocks - 1)))
        .withColumn("shuffled", F.xxhash64("doc_id", "pass", "block"))
        .select(
            "doc_id", "source", "n_tokens", "pass", "block",
            F.row_number().over(permuted).cast("long").alias("slot"),
        )
    )


def mix_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as :func:`mix` takes it. Texts
    stay in their rows: what is joined are the sources' passes and, for the last pass,
    the place up to which the budget reached.

    Nulls, empty texts, repeated rows and empty tables are as in :func:`mix`; columns may
    have any names.
    """
    rows, sources, _ = plan(docs, target)
    taken = _streams(rows, sources)
    reach = taken.groupBy("key").agg(F.max(F.struct("pass", "place")).alias("reach"))
    reach = materialise(reach.select("key", "reach"), "reach")
    # The row goes as one column beside what is computed, so no name of it can clash.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    tagged = docs.select(
        whole, "doc_id", _key(F.col("source")).alias("key"), n_tokens(F.col("text")).alias("n_tokens")
    )
    joined = tagged.join(reach, "key")
    copies = F.col("reach.pass") + F.when(_order(F.col("reach.pass")) <= F.col("reach.place"), 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
