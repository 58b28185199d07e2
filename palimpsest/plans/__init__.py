"""Plan builders: lineage cuts, set equality, keyed upserts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that spark.checkpoint.dir names; a temporary one only where all runs on one machine."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not found and not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint(eager=True)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing, extra: counts of rows of a that b lacks and the other way round."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra")))


def every(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old whose key new lacks, and new; keys compare null-safe."""
    o, n = old.alias("o"), new.alias("n")
    on = every([F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    return o.join(n, on, "left_anti").unionByName(new)
