"""The corpus pipeline: toxic documents go, one of each group of near copies stays, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it as the next stage's docs. All stages but the last return the columns of docs, whatever further ones there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, mixing, neardup, toxicity
from palimpsest.llm.common import discard, materialise, table, whole
from palimpsest.llm.digests import PATTERN, RANKS

#: The pipeline's sources are repeated at most so often, and every document is used at least once.
REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of a toxicity of 0.5 or more; the machine learns from the labelled rows of docs."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.annotate(docs, machine)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).drop(scored.columns[-1])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at 0.8 on shingles of five words: that with the smallest doc_id.

    Rows that share doc_id and text count as one, of which one stays; rows without doc_id come last in a group.
    """
    id_key, text_key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_id"), F.xxhash64("text").alias("_h")
    stays = neardup.linked(docs, words=5).filter("stays").select(id_key, F.col("h").alias("_h")).distinct().hint("merge")
    # The join and the removal of repeated rows share one partitioning; what stays grows with the input, so it is never broadcast.
    return docs.select(whole(docs), id_key, text_key).join(stays, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the temperature at which none is repeated more than REPEATS times; every document is drawn at least once."""
    tokens = mixing.four_bytes(F.col("text"))
    totals = materialise(mixing.source_totals(docs, tokens))
    return mixing.draw(docs, mixing.plan(totals, repeats=REPEATS), tokens).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each drawn document."""
    return bpe.round_trip(docs, RANKS, PATTERN).drop("n_split")


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode_texts)]

#: No stage but the last could be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
