"""One thin query an operator: it applies the operator to its whole table and derives the columns of the contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, crosspoly, edits, licences, mixer, mixing, neardup, quotes, spots, toxicity
from palimpsest.llm.common import materialise, remainder, table

#: The rank file and the pattern of the byte-level tokenizer.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels are learnt from the folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs.filter(remainder("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places in every document."""
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")


def op8_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return spots.compare_with_next(table(spark, sf_dir, "documents"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a cut a third of the way in, a sentence put in
    after two thirds, and the first 40 code points put at the end."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, drop, insert: F.struct(start.cast("int").alias("start"), F.lit(drop).alias("drop"), insert.alias("insert"))
    three = F.array(edit(n / 3, 17, F.lit("")), edit(n * 2 / 3, 3, F.lit(" It's an edited sentence.")), edit(n + 100, 0, F.substring("text", 1, 40)))
    return edits.count(docs.withColumn("edits", three), RANKS, PATTERN)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of as many tokens as the documents have, at 97 % of the highest entropy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    tokens = mixing.four_bytes(F.col("text"))
    light = materialise(docs.select("doc_id", "source", F.xxhash64("text").alias("text"), tokens.alias("tokens")))
    totals = materialise(mixing.source_totals(light, F.col("tokens")))
    total = totals.agg(F.sum("tokens")).first()[0]
    drawn = mixing.draw(light, mixing.plan(totals, entropy=0.97, budget=total), F.col("tokens"))
    return drawn.select("doc_id", "source", F.col("_block").alias("block"), F.col("_key").alias("order_key"), "tokens", F.col("_weight").alias("weight"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.8 on shingles of two words."""
    return neardup.linked(table(spark, sf_dir, "documents"), words=2).drop("h", "node", "stays")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; folds 1 to 9 of 10 are learnt from."""
    out = mixer.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return out.withColumn("held_out", ~F.col("train")).drop("train")


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return crosspoly.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as mail (each message quotes the one before it, and within that the first line of
    the one before that) and taken apart again; every row is a message, whatever key it shares. Rows come thread by thread in reply order."""
    every = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    back = lambda n: every.select("conv_id", (F.col("turn") + n).alias("turn"), *[(F.col("text") if i == n else F.lit(None).cast("string")).alias(f"back{i}") for i in (1, 2)])
    earlier = back(1).unionByName(back(2)).groupBy("conv_id", "turn").agg(F.min("back1").alias("back1"), F.min("back2").alias("back2"))  # of rows with one key, the smallest text is quoted
    mail = every.join(earlier, ["conv_id", "turn"], "left")
    first = F.split("back2", "\n", 2)[0]
    head = F.when(F.col("back2").isNotNull(), F.concat(quotes.quoted(first, ">> "), F.lit("\n"))).otherwise("")
    text = F.when(F.col("back1").isNotNull(), F.concat(F.lit("On an earlier day they wrote:\n"), head, quotes.quoted(F.col("back1")), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    found = quotes.threads(mail.select("conv_id", "turn", text.alias("text")))
    order = ["thread_conv", "thread_turn", "place"]
    kept = ["conv_id", "turn", "n_quotes", "n_linked", "deepest", "reply_conv", "reply_turn", "n_chars", "clean_sha256"]
    found = found.select("*", F.length("clean").cast("long").alias("n_chars"), F.sha2(F.col("clean"), 256).alias("clean_sha256"))
    return found.select(*order, *kept).orderBy(*order).select(*kept)
