"""Manifests: files with content hashes, deduplicated blobs, path forms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import codecs

# Names that a scan prunes. A store passes the name of its own folder besides.
PRUNED = (".git", "target", "node_modules")
#: Largest content that is kept inline, in bytes.
INLINE = 65_536


def should_scan(path: Column, pruned: tuple[str, ...] = PRUNED) -> Column:
    """No segment of the path is pruned."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in pruned]))


def fingerprinted(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """path, hash (SHA-256 in hexadecimal), bytes."""
    return df.select(path.alias("path"), F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("bytes"))


def blobs(df: DataFrame, key: str = "hash", order: str = "doc_id") -> DataFrame:
    """One row a content: n_refs and the first reference."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_refs"), F.min(order).alias(f"min_{order}"))


def new_blobs(arriving: DataFrame, stored: DataFrame, key: str = "hash") -> DataFrame:
    """Contents to write: each once, without those stored."""
    return arriving.select(key).distinct().join(stored.select(key), key, "left_anti")


def representation(size: Column) -> Column:
    return F.when(size <= INLINE, "inline").otherwise("chunked")


def normalized_path(path: Column) -> Column:
    """Trimmed, without leading ./ (repeated), with forward slashes."""
    return F.replace(F.regexp_replace(F.trim(path), r"^(\./)+", ""), F.lit("\\"), F.lit("/"))


def normalized_domains(domains: Column) -> Column:
    """Trimmed, sorted and distinct, without blanks; none means public."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(domains, lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.size(kept) == 0, F.array(F.lit("public"))).otherwise(kept)


# Characters and names that are not portable.
BAD_CHARACTERS = r'[<>:"|?*\x00-\x1F\x7F]'
DEVICES = r"(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])"


def segment_problem(segment: Column) -> Column:
    """The first rule that a path segment of ASCII characters breaks, or null; see path_problems() for others."""
    return (
        F.when(segment == "", "empty")
        .when(F.octet_length(segment) > 255, "too_long")
        .when(segment.isin(".", "..") | segment.rlike(r"[\x00/\\]"), "unsafe")
        .when(segment.rlike(BAD_CHARACTERS), "not_portable")
        .when(segment.rlike(r"[ .]$") | F.lower(segment).rlike(rf"^{DEVICES}(\.|$)"), "reserved")
    )


def path_problem(path: Column) -> Column:
    """The first broken rule of any segment, or of the whole."""
    bad = F.filter(F.transform(F.split(path, "/"), segment_problem), lambda x: x.isNotNull())
    return F.coalesce(F.get(bad, 0), F.when(F.octet_length(path) > 1023, "path_too_long"))


def path_problems(df: DataFrame, path: str = "path") -> DataFrame:
    """df with reason: the first broken rule. Paths that aren't ASCII must be in normal form C, and are folded in full
    before device names are looked for; only those go through Python."""
    plain = F.col(path).rlike(r"^[\x00-\x7F]*$")
    own = path_problem(F.col(path))
    folded = codecs.case_folded(F.col(path))
    stems = F.exists(F.split(folded, "/"), lambda s: s.rlike(rf"^{DEVICES}(\.|$)"))
    strange = F.coalesce(F.when(~codecs.is_composed(F.col(path)), "not_composed"), own, F.when(stems, "reserved"))
    ascii_, other = df.filter(F.coalesce(plain, F.lit(True))), df.filter(~plain)
    return ascii_.withColumn("reason", own).unionByName(other.withColumn("reason", strange))


def folded_places(paths: DataFrame, path: str = "path") -> DataFrame:
    """place, folded: every distinct file and folder, with its full case folding; only what isn't ASCII goes through Python."""
    places = paths.select(F.explode(prefixes(F.col(path))).alias("place")).distinct()
    plain = F.col("place").rlike(r"^[\x00-\x7F]*$")
    return places.filter(plain).withColumn("folded", F.lower("place")).unionByName(places.filter(~plain).withColumn("folded", codecs.case_folded(F.col("place"))))


def name_problems(entries: DataFrame, group: str, name: str) -> DataFrame:
    """group, problem, name: names of one manifest that repeat, or that differ only by case."""
    twice = entries.groupBy(group, name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(group, F.lit("repeated").alias("problem"), F.col(name).alias("name"))
    each = folded_places(entries.select(F.col(name).alias("path")), "path").select(F.col("place").alias(name), "folded")
    by = entries.select(group, name).distinct().join(each, name).groupBy(group, "folded").agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return twice.unionByName(by.filter("n > 1").select(group, F.lit("folds_alike").alias("problem"), "name"))


def list_hashes(df: DataFrame, group: str, path: str = "path", hash_: str = "hash") -> DataFrame:
    """group, n_files, list_hash: SHA-256 of each group's `path=hash` lines in order, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, digest = None, 0, None
        done: list[tuple] = []
        for b in batches:
            for g, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or g != at:
                    if digest is not None:
                        done.append((at, n, digest.hexdigest()))
                    at, n, digest = g, 0, hashlib.sha256()
                digest.update((("\n" if n else "") + line).encode())
                n += 1
        if digest is not None:
            done.append((at, n, digest.hexdigest()))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["g", "n", "h"])

    rows = df.select(F.col(group).cast("string").alias("g"), F.concat_ws("=", path, hash_).alias("line")).repartition("g").sortWithinPartitions("g", "line")
    return rows.mapInArrow(run, "g string, n long, h string").select(F.col("g").cast(df.schema[group].dataType).alias(group), F.col("n").alias("n_files"), F.col("h").alias("list_hash"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path by whole segments, shortest first, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    """folded, first_path, second_path: spellings of one folded place, at any level (files and folders above them)."""
    by = folded_places(paths, path).groupBy("folded").agg(F.min("place").alias("first_path"), F.max("place").alias("second_path"))
    return by.filter("first_path <> second_path")


def files_under_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """ancestor, path: files whose folded path is a folder of another file."""
    p = F.col(path)
    above = paths.select(p.alias("_path"), F.slice(prefixes(p), 1, F.size(F.split(p, "/")) - 1).alias("_above")).select("_path", F.explode("_above").alias("place"))
    folded = folded_places(paths, path)
    files = paths.select(p.alias("place")).join(folded, "place").select(F.col("place").alias("ancestor"), "folded")
    return above.join(folded, "place").join(files, "folded").select("ancestor", F.col("_path").alias("path"))
