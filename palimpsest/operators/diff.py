"""Two-way diffs and three-way merges of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.access import can_access
from palimpsest.operators.manifest import collisions


def _sides(named: dict[str, DataFrame], key: str, value: list[str]) -> DataFrame:
    """One row a key with a nullable struct of value columns for each side: a union and one aggregation, so one shuffle.

    Keys must be unique in each side (see duplicates()).
    """
    rows = None
    for name, df in named.items():
        cols = [F.struct(*value).alias(n) if n == name else F.lit(None).cast(df.select(F.struct(*value)).schema[0].dataType).alias(n) for n in named]
        part = df.select(F.col(key), *cols)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[F.first(n, ignorenulls=True).alias(n) for n in named])


def duplicates(df: DataFrame, key: str = "path") -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def input_problems(sides: dict[str, DataFrame], key: str = "path") -> DataFrame:
    """side, problem, path of what a diff or a merge must refuse: repeated paths and portable collisions within a side."""
    out = None
    for name, df in sides.items():
        twice = duplicates(df, key).select(F.lit(name).alias("side"), F.lit("duplicate").alias("problem"), F.col(key).alias("path"))
        clash = collisions(df, key).select(F.lit(name).alias("side"), F.lit("collision").alias("problem"), F.col("first_path").alias("path"))
        out = twice.unionByName(clash) if out is None else out.unionByName(twice).unionByName(clash)
    return out


def checked_merge(base: DataFrame, line: DataFrame, incoming: DataFrame, key: str = "path", same: list[str] | None = None) -> DataFrame:
    """merge(), which refuses repeated paths and portable collisions in a side or in what it keeps."""
    plan = merge(base, line, incoming, key, same)
    bad = input_problems({"base": base, "line": line, "incoming": incoming, "merged": merged_rows(plan, key)}, key)
    if (found := bad.limit(1).collect()):
        raise ValueError(f"{found[0]['problem']} in {found[0]['side']}")
    return plan


def refreshed_conflicts(stored: DataFrame, found: DataFrame, match: list[str], kept: list[str], fresh: list[str]) -> DataFrame:
    """The rows of stored conflicts after found ones are written: the same unresolved conflict (null-safe on match) keeps
    the columns of kept and takes those of fresh; others are inserted. action: keep, refresh or insert."""
    s = stored.select(*[F.col(c).alias(f"_s{c}") for c in [*match, *kept, *fresh, "status"]], F.lit(True).alias("_stored"))
    f = found.select(*[F.col(c).alias(f"_f{c}") for c in [*match, *kept, *fresh]], F.lit(True).alias("_found"))
    on = F.col("_sstatus") == "unresolved"
    for c in match:
        on = on & F.col(f"_s{c}").eqNullSafe(F.col(f"_f{c}"))
    both = s.join(f, on, "full")
    action = F.when(F.col("_stored").isNull(), "insert").when(F.col("_found").isNull(), "keep").otherwise("refresh")
    old, new = F.col("_stored").isNotNull(), F.col("_found").isNotNull()
    cols = [F.when(old, F.col(f"_s{c}")).otherwise(F.col(f"_f{c}")).alias(c) for c in [*match, *kept]]
    cols += [F.when(new, F.col(f"_f{c}")).otherwise(F.col(f"_s{c}")).alias(c) for c in fresh]
    return both.select(*cols, action.alias("action"))


def diff(before: DataFrame, after: DataFrame, key: str = "path", same: list[str] | None = None) -> DataFrame:
    """path, status: added, modified or deleted. same: the columns whose equality means unchanged."""
    both = _sides({"a": before, "b": after}, key, same or ["hash"])
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select(key, status.alias("status")).filter("status is not null")


def hidden_changes(before: DataFrame, after: DataFrame, actor: Column, key: str = "path", policy: str = "domains") -> DataFrame:
    """hidden: how many paths differ among the rows that the actor may not see."""
    a, b = (x.filter(~can_access(actor, F.col(policy))) for x in (before, after))
    return diff(a, b, key).agg(F.count(F.lit(1)).alias("hidden"))


def permissioned_diff(before: DataFrame, after: DataFrame, actor: Column, key: str = "path", policy: str = "domains") -> DataFrame:
    """status, path of what the actor may see, and a row `hidden` with the number of hidden changes as path.

    Each side is filtered on its own: a path that becomes hidden is deleted for the actor and counts as hidden.
    """
    a, b = (x.filter(can_access(actor, F.col(policy))) for x in (before, after))
    seen = diff(a, b, key).select("status", F.col(key).alias("path"))
    return seen.unionByName(hidden_changes(before, after, actor, key, policy).select(F.lit("hidden").alias("status"), F.col("hidden").cast("string").alias("path")))


def opaque_changes(before: DataFrame, after: DataFrame, secret: str, key: str = "path") -> DataFrame:
    """opaque_changed: changes among rows known by keyed identities only; no path leaves."""
    hide = lambda x: x.select(F.sha2(F.concat(F.lit(secret), F.col(key)), 256).alias("id"), F.sha2(F.concat_ws("|", "hash", F.col("bytes").cast("string")), 256).alias("print"))
    return diff(hide(before), hide(after), "id", ["print"]).agg(F.count(F.lit(1)).alias("opaque_changed"))


def merge(base: DataFrame, line: DataFrame, incoming: DataFrame, key: str = "path", same: list[str] | None = None) -> DataFrame:
    """path, base, line, incoming (structs of the compared columns), outcome, kind.

    outcome: keep_line, take_incoming, delete or conflict. kind of a conflict: add_add, delete_modify or both_modified.
    """
    rows = _sides({"base": base, "line": line, "incoming": incoming}, key, same or ["hash"])
    b, l, i = F.col("base"), F.col("line"), F.col("incoming")  # noqa: E741
    keep = F.when(l.isNull(), "delete").otherwise("keep_line")
    outcome = F.when(l.eqNullSafe(i), keep).when(b.eqNullSafe(l), F.when(i.isNull(), "delete").otherwise("take_incoming")).when(b.eqNullSafe(i), keep).otherwise("conflict")
    kind = F.when(b.isNull(), "add_add").when(l.isNull() | i.isNull(), "delete_modify").otherwise("both_modified")
    return rows.withColumn("outcome", outcome).withColumn("kind", F.when(F.col("outcome") == "conflict", kind))


def merged_rows(plan: DataFrame, key: str = "path") -> DataFrame:
    """path, the compared columns and origin of what a merge keeps."""
    side = F.when(F.col("outcome") == "keep_line", F.col("line")).when(F.col("outcome") == "take_incoming", F.col("incoming"))
    rows = plan.withColumn("_side", side).filter("_side is not null")
    return rows.select(key, "_side.*", F.when(F.col("outcome") == "keep_line", "line").otherwise("incoming").alias("origin"))


def upsert_conflicts(stored: DataFrame, found: DataFrame, match: list[str]) -> DataFrame:
    """The columns of match and action: refresh an unresolved conflict of the same null-safe key, else insert.

    Stored conflicts without a match are kept.
    """
    s = stored.filter("status = 'unresolved'").select(*[F.col(c).alias(f"_{c}") for c in match], F.lit(True).alias("_stored"))
    on = F.lit(True)
    for c in match:
        on = on & F.col(f"_{c}").eqNullSafe(F.col(c))
    both = found.select(*match, F.lit(True).alias("_found")).join(s, on, "full")
    action = F.when(F.col("_stored").isNull(), "insert").when(F.col("_found").isNull(), "keep").otherwise("refresh")
    return both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in match], action.alias("action"))
