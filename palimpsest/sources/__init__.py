"""Readers of tables, JSON documents and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import codecs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_table(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One row a *.json file, with an explicit schema; a missing folder is an empty table, a bad file ends the read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(folder, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json")


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none is an error that names the key's column only."""
    found = df.filter(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"no row has this {key}")
    return found


def key_file(key) -> F.Column:
    """The file name of a key."""
    return F.replace(key, F.lit("/"), F.lit("__"))


def record_files(spark: SparkSession, folder: str, magic: bytes, audited: bool = True) -> DataFrame:
    """path (relative), status, identity, kind, schema, payload of the record files below a folder."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.rgl").load(folder)
    return codecs.records(files.select(F.substring_index("path", root, -1).alias("path"), "content"), magic, audited)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), bytes and class of every file below a folder, whether or not it is a record."""
    from palimpsest.operators.store import inventory_class

    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.substring_index("path", root, -1)
    return files.select(path.alias("path"), F.col("length").alias("bytes")).withColumn("class", inventory_class(F.col("path")))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), hash, bytes of the regular files below a folder; pruned names are left out."""
    from palimpsest.operators.manifest import should_scan

    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.substring_index(F.col("path"), root, -1)
    return files.select(path.alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes")).filter(should_scan(F.col("path")))
