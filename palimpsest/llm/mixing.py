"""Mixing sources to target weights by temperature.

A source with token share s gets the weight s^a / sum s^a. The exponent a is bisected between 0 (all sources alike) and
1 (in proportion) until the weights have the target entropy, or until no source is repeated more than the limit. A
budget of tokens then gives each source weight * budget tokens, realised in blocks: each block of a source is a
permutation of its documents by a keyed hash; blocks are whole but for the last, which ends before the document that
would exceed the source's tokens. Without a budget, it is the smallest that uses every document once.

Everything is distributed: an exponent's sums are aggregates over the table of sources (63 exponents in one pass, so
five passes narrow it to a part in 10^9), and the cut of a last block comes from sums over SLICES slices of each
permutation, so that only the documents of one slice a source are ever ordered.

Edge cases: other columns may have any names; a null source is a source of its own; null and empty texts count no tokens and are placed like others;
a source without tokens gets weight 0 and each of its documents is drawn once without a budget, else never; repeated rows are documents of
their own, and rows equal in id and text are drawn together; empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh, materialise, whole

#: Slices of a permutation by its key's first bits.
SLICES = 4096
#: Exponents tried in one pass, and passes: the interval shrinks by 64 each time.
FAN, PASSES = 63, 5


def four_bytes(text: Column) -> Column:
    """Tokens of a text as its bytes / 4, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def source_totals(docs: DataFrame, tokens: Column, source_col: str = "source") -> DataFrame:
    """source, n_docs, tokens: one row a source."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens).alias("tokens"))


def exponent(totals: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> tuple[float, float, float]:
    """The exponent, the sum of shares to its power, and the budget.

    entropy: target as a fraction of the highest, log(sources); the nearest that an exponent from 0 to 1 has.
    repeats: the smallest exponent at which weight * budget is at most repeats times each source's tokens.
    """
    full = totals.filter("tokens > 0")
    head = full.agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not head["n"]:
        return 1.0, 1.0, float(budget or 0)
    everything, low, high = float(head["all"]), head["least"] / head["all"], head["most"] / head["all"]
    share = F.col("tokens") / F.lit(everything)

    def measure(tries: list[float]) -> list[tuple[float, float]]:
        sums = [F.sum(F.pow(share, a)).alias(f"z{i}") for i, a in enumerate(tries)] + [F.sum(F.pow(share, a) * F.log(share)).alias(f"l{i}") for i, a in enumerate(tries)]
        row = full.agg(*sums).first()
        return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(tries))]

    def budget_at(a: float, z: float) -> float:
        return float(budget) if budget else everything * high ** (1 - a) * z

    def enough(a: float, z: float, l: float) -> bool:  # noqa: E741
        """Is a large enough? True from some exponent on."""
        if entropy is not None:
            return math.log(z) - a * l / z <= entropy * math.log(head["n"]) + 1e-12
        return low ** (a - 1) / z * budget_at(a, z) / everything <= (repeats or math.inf) * (1 + 1e-12)

    lo, hi = 0.0, 1.0
    ends = measure([lo, hi])
    if enough(lo, *ends[0]):
        hi, z = lo, ends[0][0]
    else:
        z = ends[1][0]
        for _ in range(PASSES):
            tries = [lo + (hi - lo) * (i + 1) / (FAN + 1) for i in range(FAN)]
            got = measure(tries)
            k = next((i for i, (a, (zz, l)) in enumerate(zip(tries, got, strict=True)) if enough(a, zz, l)), None)
            if k is None:
                lo = tries[-1]
            else:
                lo, hi, z = (tries[k - 1] if k else lo), tries[k], got[k][0]
    return hi, z, budget_at(hi, z)


def plan(totals: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> DataFrame:
    """source, n_docs, tokens, weight, goal (tokens), blocks (whole permutations), rest (tokens of the last)."""
    a, z, total = exponent(totals, entropy, repeats, budget)
    everything = F.lit(float(totals.agg(F.sum("tokens")).first()[0] or 1))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / everything, a) / z).otherwise(0.0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * total / F.col("tokens")).otherwise(0.0 if budget else 1.0)
    return (
        totals.withColumn("weight", weight)
        .withColumn("goal", F.col("weight") * total)
        .withColumn("blocks", F.floor(ratio + 1e-9).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("goal") - F.col("blocks") * F.col("tokens")))
    )


def draw(docs: DataFrame, sources: DataFrame, tokens: Column, seed: int = 11, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of docs, and _block (from 0), _key (order within the block) and _weight, for each draw.

    Where docs has a column of such a name, the added one has underscores behind it.
    """
    s = sources.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"), "blocks", "rest")
    id_, text = F.col(f"row.{id_col}"), F.col(f"row.{text_col}")
    base = docs.select(whole(docs), F.col(source_col).alias("_s"), tokens.alias("_tokens"))
    last = F.xxhash64(F.lit(seed), id_, text)
    # xxhash64 with another first value gives each block a permutation of its own.
    base = base.withColumn("_last", last).withColumn("_slice", F.shiftrightunsigned(F.col("_last"), 64 - (SLICES.bit_length() - 1)).cast("int"))
    light = base.select("_s", "_slice", "_last", "_tokens")
    sums = light.groupBy("_s", "_slice").agg(F.sum("_tokens").alias("_in"))
    run = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_in").over(run)).join(s, F.col("_s").eqNullSafe(F.col("_source")))
    # The slice in which the last block of a source ends, and the tokens left for it.
    ends = sums.filter("rest > 0 and _upto - _in <= rest and _upto > rest").groupBy("_s").agg(F.min_by(F.struct("_slice", (F.col("rest") - (F.col("_upto") - F.col("_in"))).alias("left")), "_slice").alias("_end"))
    inside = light.alias("l").join(ends.alias("e"), F.col("l._s").eqNullSafe(F.col("e._s")) & (F.col("l._slice") == F.col("e._end._slice")))
    order = Window.partitionBy("l._s").orderBy("l._last").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside.withColumn("_sum", F.sum("l._tokens").over(order)).filter("_sum <= e._end.left").groupBy(F.col("l._s").alias("_c")).agg(F.max("l._last").alias("_cut"))
    per = (
        s.join(ends.select(F.col("_s").alias("_e"), F.col("_end._slice").alias("_end_slice")), F.col("_source").eqNullSafe(F.col("_e")), "left")
        .join(cuts, F.col("_source").eqNullSafe(F.col("_c")), "left")
        .select("_source", "_weight", "blocks", "rest", "_end_slice", "_cut")
    )
    per = materialise(per)
    # Unsigned order: the slice first, then the signed key within it (all keys of a slice have one sign).
    partly = (F.col("rest") > 0) & ((F.col("_slice") < F.col("_end_slice")) | ((F.col("_slice") == F.col("_end_slice")) & (F.col("_last") <= F.col("_cut"))))
    drawn = base.join(per, F.col("_s").eqNullSafe(F.col("_source")))
    n = F.col("blocks") + F.when(partly, 1).otherwise(0)
    drawn = drawn.withColumn("_n", n.cast("int")).filter("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    drawn = drawn.withColumn("_block", F.col("_block").cast("long"))
    key = F.when(F.col("_block") == F.col("blocks"), F.col("_last")).otherwise(F.xxhash64(F.lit(seed), F.col("_block"), id_, text))
    return drawn.withColumn("_key", key).select("row.*", *[F.col(x).alias(fresh(x, docs.columns)) for x in ("_block", "_key", "_weight")])
