"""Total orders: positions of rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans import cut


def by_segments(path: Column) -> Column:
    """Paths by segments, each by its bytes: `a/b` comes before `a-b`."""
    return F.split(path, "/")


def by_encoded_name(name: Column) -> Column:
    """Names as their encodings sort: shorter ones first, then by bytes."""
    return F.struct(F.octet_length(name).alias("n"), name.alias("name"))


def positions(df: DataFrame, *by: Column) -> DataFrame:
    """df with position, from 0, in the order of by: ranges are dealt out, sorted on their own, and begin where the one before ends."""
    keys = [c.alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    dealt = cut(df.select("*", *keys).repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return dealt.join(before, "_part").withColumn("position", (F.col("_before") + rank - 1).cast("long")).drop("_part", "_before", *names)
