"""Licence scans: an exact set-similarity join of text blocks with a table of licence templates, in DataFrame functions only.

Blocks are windows of consecutive words, SPREAD times as long as the template, wherever lines break. A template is a set
of words; a block matches where it holds at least the threshold of the template's words (containment).

The words of all texts meet the templates' vocabulary in a join, which leaves each text's template words with their
places. These give the global order of template words, rarest first. Three exact filters spare most comparisons:
  prefix: with |T| words of which `need` must occur, one of the first |T| - need + 1 must occur in the text: the first
    words of all templates are a table that the words of texts are joined with, and only pairs of text and template that
    meet there are looked at;
  length: the text has at least `need` of the template's words;
  position: of the template's words in the text, that `need` - 1 places after a block's first one lies in the block.
Blocks that overlap are one match, with the best containment of them. Only template words are shuffled, once as a row a
text. The tables of templates are sent to every task up to SENT rows, beyond that they are joined by shuffles.

Words are runs of characters other than ASCII without letters and digits; only A-Z are lower-cased. Besides, phrases
are found by place: consecutive words anywhere in the text.

Edge cases: templates without words match nothing; null and empty texts have no words, no labels (an empty string) and score 0; a text of one very long line
has the same blocks as if it had many; repeated rows are scanned each; empty tables give empty tables; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Lines by which licences are declared, and the labels of the method.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "subject to the terms of the mozilla public license version 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: Words of a block for each word of the template: a statement may have as many other words in it as its own.
SPREAD = 2
#: Java's form of a run of characters that are in no word, before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() is faster; only two characters that it turns into ASCII letters need the other way."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("K") | text.contains("İ"), plain).otherwise(F.lower(text))


def normal(text: Column) -> Column:
    """The words with a space before each and one behind the last; empty without words."""
    words = F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


#: Rows of a table of templates that are sent to every task.
SENT = 200_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df.hint("merge")


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame, threshold: float) -> DataFrame:
    """t (a number), label, own (distinct words), need, width. templates: text to label, or a table of label and text."""
    if isinstance(templates, dict):
        rows = spark.createDataFrame([(i, label, text) for i, (text, label) in enumerate(templates.items())], "t int, label string, text string")
    else:
        rows = templates.select(F.row_number().over(Window.orderBy("label", "text")).alias("t"), "label", "text")
    words = F.split(F.trim(normal(F.col("text"))), " ")
    own = F.array_distinct(words)
    return rows.filter(normal(F.col("text")) != "").select("t", "label", own.alias("own"), F.ceil(threshold * F.size(own) - 1e-9).cast("int").alias("need"), (SPREAD * F.size(words)).alias("width"))


def found_blocks(docs: DataFrame, templates: DataFrame, text_col: str) -> DataFrame:
    """k1, k2 (a text's key), found: array of (t, word, label, containment) of each match. templates: see template_table()."""
    templates = materialise(templates)
    vocabulary = materialise(templates.select(F.explode("own").alias("word")).distinct().withColumn("tok", F.row_number().over(Window.orderBy("word"))))
    n_words = vocabulary.count()
    words = F.split(F.trim(normal(F.col(text_col))), " ")
    places = docs.select(*key(docs, text_col), F.posexplode(words).alias("at", "word")).join(sent(vocabulary, n_words), "word")
    # Equal texts are one: each task shuffles one row a text, and a set holds one text's words however many copies there are.
    texts = materialise(places.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("at", "tok"))).alias("hits")).withColumn("toks", F.array_distinct(F.transform("hits", lambda h: h["tok"]))))

    often = texts.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    ranked = vocabulary.join(often, "tok", "left").select("word", "tok", F.coalesce("n", F.lit(0)).alias("n"))
    each = templates.select("t", "need", F.size("own").alias("size"), F.explode("own").alias("word")).join(ranked, "word")
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("n", "word")))
    prefixes = materialise(each.filter("place <= size - need + 1").select("tok", "t"))
    by_number = materialise(each.groupBy("t").agg(F.collect_set("tok").alias("own")).join(templates.drop("own"), "t"))
    meet = texts.select("k1", "k2", F.explode("toks").alias("tok")).join(sent(prefixes, prefixes.count()), "tok").select("k1", "k2", "t").distinct()
    pairs = meet.join(sent(by_number, by_number.count()), "t").join(texts.hint("merge"), ["k1", "k2"])
    pairs = pairs.filter(F.size(F.array_intersect("toks", "own")) >= F.col("need"))
    pairs = pairs.withColumn("hits", F.filter("hits", lambda h: F.array_contains("own", h["tok"])))
    matches = pairs.withColumn("blocks", blocks(F.col("hits"))).withColumn("joined", joined(F.col("blocks"))).filter(F.size("joined") > 0)
    return matches.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("joined"))).alias("found"))


def blocks(hits: Column) -> Column:
    """Of one text and template (columns own, need, width, t, label): blocks begin at the template's words in the text."""
    need, width, size = F.col("need"), F.col("width"), F.size("own")

    def block(hs: Column, j: Column) -> Column:
        near = F.filter(F.slice(hs, j + 1, width), lambda x: x["at"] < hs[j]["at"] + width)
        held = F.size(F.array_distinct(F.transform(near, lambda x: x["tok"])))
        return F.struct(F.col("t").alias("t"), hs[j]["at"].cast("long").alias("word"), F.col("label").alias("label"), (held / size).alias("containment"))

    def of(hs: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(hs) - need), lambda j: hs[j + (need - 1)]["at"] < hs[j]["at"] + width)
        return F.filter(F.transform(begins, lambda j: block(hs, j)), lambda m: m["containment"] * size > need - 0.5)

    none = F.array().cast("array<struct<t:int,word:bigint,label:string,containment:double>>")
    # Bound once, so that inner functions don't compute it again.
    return F.transform(F.array(hits), lambda hs: F.when(F.size(hs) >= need, of(hs)).otherwise(none))[0]


def joined(all_: Column) -> Column:
    """The first of each run of overlapping blocks, with the run's best containment."""
    width = F.col("width")
    first = F.filter(F.transform(all_, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["m"]["word"] >= F.get(all_, x["i"] - 1)["word"] + width))
    begin = F.transform(first, lambda x: x["i"])
    return F.transform(
        begin,
        lambda i, n: F.struct(
            all_[i]["t"].alias("t"), all_[i]["word"].alias("word"), all_[i]["label"].alias("label"),
            F.array_max(F.transform(F.slice(all_, i + 1, F.coalesce(F.get(begin, n + 1), F.size(all_)) - i), lambda m: m["containment"])).alias("containment"),
        ),
    )


def key(docs: DataFrame, text_col: str) -> list[Column]:
    """Two hashes of a text: rows with one text have one key."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text, F.length(text)).alias("k2")]


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    templates: text to label, or a table of label and text. blocks: array of (word, label, containment) of each match;
    word is the place of its first word in the text. score: the best containment, 1 for a phrase.
    """
    found = materialise(found_blocks(docs, template_table(docs.sparkSession, templates, threshold), text_col))
    rows = docs.select(F.col(id_col).alias("id"), *key(docs, text_col), normal(F.col(text_col).cast("string")).alias("norm"))
    norm = F.col("norm")
    n_words = F.greatest(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("long")

    def places(phrase: str) -> Column:
        words = phrase.split()
        # The words are bound once; an inner function that split the text itself would do so for each place.
        at = F.transform(
            F.array(F.split(F.trim(norm), " ")),
            lambda ws: F.filter(F.sequence(F.lit(0), F.size(ws) - len(words)), lambda i: _every([F.get(ws, i + k) == w for k, w in enumerate(words)])),
        )[0]
        return F.when(norm.contains(f" {phrase} "), at).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("places", F.array(*[places(p) for p in phrases]))
    starts = F.flatten(F.col("places"))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))))
    light = rows.select(
        "id", "k1", "k2", n_words.alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), base.alias("base"),
    )
    out = light.join(found.hint("merge"), ["k1", "k2"], "left")
    none = F.array().cast("array<struct<word:bigint,label:string,containment:double>>")
    blocks_ = F.coalesce(F.transform("found", lambda m: F.struct(m["word"].alias("word"), m["label"].alias("label"), m["containment"].alias("containment"))), none)
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda m: m["containment"])), F.lit(0.0)))
    labels = F.array_sort(F.array_union("base", F.transform(blocks_, lambda m: m["label"])))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"), score.alias("score"), blocks_.alias("blocks"),
    )


def _every(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
