"""Publication: compare-and-swap over a log, staged checks in a fixed order, all or nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The checks of an update, in the order in which the first failing one is reported.
CHECKS = ("operation_unknown", "operation_kind", "duplicate_key", "expected", "target_unknown", "target_kind", "identity", "action", "closure")


def fold(attempts: DataFrame, key: str = "key") -> DataFrame:
    """attempt, outcome, generation: compare-and-swap in seq order. attempts: key, seq, attempt, expected (a generation, null for absent).

    An attempt is accepted if the key's state is the one that it expects: none, or that generation. It then leaves the
    next generation. generation is the state after the attempt, null for none. Each key's rows stream through one task
    with one number as state, so a key of any length takes no memory.
    """
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, none = None, None, True
        for b in batches:
            outcomes, states = [], []
            for k, want in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if none or k != at:
                    at, state, none = k, None, False
                won = want == state
                if won:
                    state = 0 if state is None else state + 1
                outcomes.append("accepted" if won else "conflict")
                states.append(state)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(outcomes, pa.string()), pa.array(states, pa.int64())], names=["attempt", "outcome", "generation"])

    rows = attempts.select(key, "seq", "attempt", F.col("expected").cast("long").alias("expected"))
    return rows.repartition(key).sortWithinPartitions(key, "seq", "attempt").mapInArrow(run, f"attempt {kinds['attempt']}, outcome string, generation long")


def first_failing(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds no longer (false or null), or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def staged(updates: DataFrame, states: DataFrame, objects: DataFrame, actions: DataFrame, dangling: DataFrame) -> DataFrame:
    """batch, key, target, reason: the first failing check of each update, null if none.

    updates: batch, key, kind (what the key points to), expected, target, operation. states: key, generation. objects:
    object, kind, identity. actions: operation, key, target, each to be used by exactly one update. dangling: object, of
    targets whose closure fails.
    """
    o = objects.select(F.col("object").alias("target"), F.col("kind").alias("_kind"), F.col("identity").alias("_identity"))
    op = objects.select(F.col("object").alias("operation"), F.col("kind").alias("_op"))
    same = updates.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("_same"))
    wanted = actions.groupBy("operation", "key", "target").agg(F.count(F.lit(1)).alias("_actions"))
    bad = dangling.select(F.col("object").alias("target"), F.lit(True).alias("_bad")).distinct()
    s = states.select("key", F.col("generation").alias("_generation"))
    rows = updates.join(o, "target", "left").join(op, "operation", "left").join(same, ["batch", "key"]).join(wanted, ["operation", "key", "target"], "left").join(bad, "target", "left").join(s, "key", "left")
    passed = (
        F.col("_op").isNotNull(), F.col("_op") == "operation", F.col("_same") == 1, F.col("expected").eqNullSafe(F.col("_generation")),
        F.col("_kind").isNotNull(), F.col("_kind") == F.col("kind"), F.col("_identity").eqNullSafe(F.col("key")), F.col("_actions") == 1, F.col("_bad").isNull(),
    )
    return rows.select("batch", "key", "target", first_failing(dict(zip(CHECKS, passed, strict=True))).alias("reason"))


def published(checked: DataFrame, states: DataFrame) -> DataFrame:
    """batch, key, reason, generation: a batch is all or nothing; the reason of a refused one is its updates' first in the
    order of checks, and generation is then null."""
    place = F.coalesce(*[F.when(F.col("reason") == name, i) for i, name in enumerate(CHECKS)])
    worst = checked.groupBy("batch").agg(F.min_by("reason", place).alias("_reason"))
    s = states.select("key", F.col("generation").alias("_generation"))
    out = checked.join(worst, "batch").join(s, "key", "left")
    return out.select("batch", "key", F.col("_reason").alias("reason"), F.when(F.col("_reason").isNull(), F.coalesce(F.col("_generation") + 1, F.lit(0))).cast("long").alias("generation"))


def transitions(operations: DataFrame, kind: int = 2) -> DataFrame:
    """operation, position, key, target of the bound actions. operations: operation, actions (array of struct kind, key, target)."""
    rows = operations.select("operation", F.posexplode("actions").alias("position", "a"))
    return rows.filter(F.col("a.kind") == kind).select("operation", F.col("position").cast("long").alias("position"), "a.key", "a.target")


def exactly_one(declared: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The columns of on and n of what is declared not exactly once."""
    n = declared.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return wanted.select(*on).distinct().join(n, on, "left").select(*on, F.coalesce("n", F.lit(0)).cast("long").alias("n")).filter("n <> 1")


# Which field of a line's state each action kind of an operation sets.
FIELD_OF_ACTION = {0: 2, 1: 3, 2: 4, 3: 5, 4: 6, 5: 7, 6: 8, 7: 9, 8: 10, 9: 11}


def field_of(action: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_OF_ACTION.items() for x in kv]), action)


def stale_revisions(commits: DataFrame, order: str = "seq") -> DataFrame:
    """commit, ok: a commit holds if no other has been made since the revision that it read. commits: store, seq, commit, read.

    Every commit moves the revision on, so that the one at place n sees revision n.
    """
    w = Window.partitionBy("store").orderBy(order)
    return commits.select("commit", (F.col("read") == F.row_number().over(w) - 1).alias("ok"))
