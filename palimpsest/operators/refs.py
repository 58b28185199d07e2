"""References: current states, compare-and-swap over a log, one-to-one matching, predecessor checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.publish import fold


def presence(quarantined: Column, present: Column, promised: Column) -> Column:
    """Quarantined wins over present, present over promised."""
    return F.when(quarantined, "quarantined").when(present, "present").when(promised, "promised").otherwise("unknown")


def current(log: DataFrame, key: str = "key") -> DataFrame:
    """key, generation, target: the state with the highest generation."""
    return log.groupBy(key).agg(F.max(F.struct("generation", "target")).alias("s")).select(key, "s.generation", "s.target")


def cas_outcomes(attempts: DataFrame, key: str = "key") -> DataFrame:
    """attempt, outcome: attempts (key, seq, expected generation or null for absent) in seq order; see publish.fold()."""
    return fold(attempts, key).select("attempt", "outcome")


def matched(updates: DataFrame, actions: DataFrame, on: list[str], order_u: str, order_a: str) -> DataFrame:
    """update, action, rank: one-to-one by match key, first with first; either is null if left over."""
    u = updates.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(order_u)))
    a = actions.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(order_a)))
    left, right = u.select(*on, "_r", F.col(order_u).alias("update")), a.select(*on, "_r", F.col(order_a).alias("action"))
    return left.join(right, [*on, "_r"], "full").select("update", "action", F.col("_r").cast("long").alias("rank"))


def broken_chain(log: DataFrame, key: str, generation: str, previous: str, target: str) -> DataFrame:
    """Rows whose generation isn't the one before plus 1, or whose previous isn't the target before."""
    w = Window.partitionBy(key).orderBy(generation)
    g, t = F.lag(generation).over(w), F.lag(target).over(w)
    rows = log.withColumn("_g", g).withColumn("_t", t)
    first = F.col("_g").isNull()
    good = F.when(first, (F.col(generation) == 0) & F.col(previous).isNull()).otherwise((F.col(generation) == F.col("_g") + 1) & F.col(previous).eqNullSafe(F.col("_t")))
    return rows.filter(~good).drop("_g", "_t")


def published(batch: DataFrame) -> DataFrame:
    """The batch if every row's outcome is accepted, else nothing: all or none."""
    bad = batch.filter("outcome <> 'accepted'").limit(1)
    return batch.join(bad.select(F.lit(1).alias("_bad")), F.lit(True), "left_anti")
