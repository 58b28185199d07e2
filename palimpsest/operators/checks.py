"""Integrity checks: DataFrames of violations; no rows means that a check holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(edges: DataFrame, objects: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """source, target of edges to no object."""
    return edges.select(F.col(source).alias("source"), F.col(target).alias("target")).join(objects.select(F.col("object").alias("target")), "target", "left_anti").select("source", "target")


def version_chain(version: Column, previous: Column) -> Column:
    """Holds: version 0 has no previous one, all others have."""
    return (version == 0) == previous.isNull()


def sorted_unique(values: Column) -> Column:
    return values == F.array_sort(F.array_distinct(values))


def unsorted_groups(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, ok: whether a group's values, in the order of another column, are strictly ascending."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return df.select(group, F.coalesce(F.col(value) > before, before.isNull()).alias("_ok")).groupBy(group).agg(F.bool_and("_ok").alias("ok"))


def not_one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """side, value of what maps to more than one."""
    f = pairs.groupBy(F.col(a).alias("value")).agg(F.count_distinct(b).alias("n")).filter("n > 1").select(F.lit("left").alias("side"), F.col("value").cast("string").alias("value"))
    g = pairs.groupBy(F.col(b).alias("value")).agg(F.count_distinct(a).alias("n")).filter("n > 1").select(F.lit("right").alias("side"), F.col("value").cast("string").alias("value"))
    return f.unionByName(g)


def overlapping(regions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Regions [start, end) that are empty or overlap the next of their key."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    return regions.withColumn("_next", nxt).filter((F.col(start) >= F.col(end)) | (F.col("_next") < F.col(end))).drop("_next")


def gaps(ledger: DataFrame, version: str, key: str) -> DataFrame:
    """Rows whose version isn't the last one plus 1."""
    before = F.lag(version).over(Window.partitionBy(key).orderBy(version))
    return ledger.withColumn("_before", before).filter(F.col(version) != F.coalesce(F.col("_before") + 1, F.lit(0))).drop("_before")


def field_problems(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """object, field, problem: required fields that lack and fields that no rule knows.

    objects: object, kind, fields (array of names). rules: kind, field, required.
    """
    have = objects.select("object", "kind", F.explode("fields").alias("field"))
    unknown = have.join(rules, ["kind", "field"], "left_anti").select("object", "field", F.lit("unknown").alias("problem"))
    need = objects.select("object", "kind").join(rules.filter("required").select("kind", "field"), "kind")
    lack = need.join(have, ["object", "kind", "field"], "left_anti").select("object", "field", F.lit("missing").alias("problem"))
    return unknown.unionByName(lack)


def presence_row(presence: Column, kind: Column, length: Column) -> Column:
    """Holds: present (1) and quarantined (3) rows have a kind and a length; promised rows (2) have no length."""
    return F.when(presence.isin(1, 3), kind.isNotNull() & length.isNotNull()).when(presence == 2, length.isNull()).otherwise(True)


def incident_rule(incidents: DataFrame, flag: Column) -> DataFrame:
    """ok: the repository's flag is set exactly if an open incident fails closed."""
    return incidents.agg(F.coalesce(F.bool_or(F.col("open") & F.col("fail_closed")), F.lit(False)).eqNullSafe(flag).alias("ok"))
