"""Document fingerprints by spot signatures (SpotSigs).

Anchors are very common words. Each anchor starts a chain: the anchor and the next content words (words that are no
anchors), hashed to 32 bits. The set of chains is the fingerprint, written as the sorted hashes in hexadecimal. Two
fingerprints compare by Jaccard similarity; a comparison with a threshold is pruned by the set sizes, whose
partitions are spaced so that only the same and the next one can reach the threshold.

Edge cases: a text that has words but no chain gets one chain of all its words; a text without words, an empty or a
null text gets the empty fingerprint; two empty fingerprints have similarity 1, an empty and a full one 0; equal texts
have equal fingerprints. Rows with the same id are ordered by their text. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Very common words of English, German, French and Spanish.
ANCHORS = frozenset(
    b"a an and are as at be by for from in is it of on or that the this to was with "
    b"das dem den der des die ein eine in ist mit und von zu "
    b"dans de des du en est et la le les par pas pour que qui un une "
    b"al con de del el en es la las lo los para por que se un una y".split()
)
#: Bytes of a word, A-Z lower-cased; every other byte is a space.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spots(text: bytes, chain: int = 2) -> frozenset[int]:
    """Hashes of the chains of a text."""
    words = text.translate(WORD).split()
    if not words:
        return frozenset()
    is_anchor = [w in ANCHORS for w in words]
    content = list(compress(words, [not x for x in is_anchor]))
    out, seen, crc, last = set(), 0, zlib.crc32, len(content) - chain
    for w, anchor in zip(words, is_anchor, strict=True):
        if anchor:
            if seen > last:
                break
            out.add(crc(b" ".join(content[seen : seen + chain]), crc(w)))
        else:
            seen += 1
    return frozenset(out or {crc(b" ".join(words))})


def fingerprint(found: frozenset[int]) -> str:
    return "".join(["%08x" % x for x in sorted(found)])


def length_partition(n: int, threshold: float) -> int:
    """Sets whose partitions differ by more than 1 can't reach the threshold."""
    return 0 if n == 0 else 1 + int(math.log(n) / -math.log(threshold))


def likeness(a: frozenset[int], b: frozenset[int], threshold: float = 0.0) -> float:
    """Jaccard similarity; 0 where the sizes alone show that it is below the threshold."""
    if not a or not b:
        return float(len(a) == len(b))
    if threshold > 0 and (abs(length_partition(len(a), threshold) - length_partition(len(b), threshold)) > 1 or min(len(a), len(b)) < threshold * max(len(a), len(b))):
        return 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def cell_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the value, by binary search."""
    steps = F.lit(np.array([1 << b for b in reversed(range(len(bounds).bit_length()))], dtype=np.int64))
    held = F.lit(np.array(bounds, dtype=np.int64))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda lo, step: F.when(F.get(held, (lo + step - 1).cast("int")) <= column, lo + step).otherwise(lo)).cast("int") if bounds else F.lit(0)


#: Bytes of text that a range of ids is to hold in 100 MB of text; 16 times the text makes ranges twice as large.
RANGE_BYTES = 4_000_000
#: Ids that a range's bounds are read from.
IDS_A_RANGE = 200


def compare_with_next(docs: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id; after the smallest comes the largest. A row whose doc_id is
    null is ordered last. The edited text has the last floor(n_chars / 2) code points replaced by the first as many of
    the next document, or all of them. The texts are shuffled once: ids are cut into ranges, as many as the text needs,
    each is sorted by id, and the largest row of a range is also sent to the range above, where it follows the smallest.
    Bounds come from the ids of some rows: they only even out the tasks, no result depends on them. The driver holds
    three numbers a range.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long")
    head = base.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("size")).first()
    size = head["size"] or 0
    n = max(1, math.ceil(size / (RANGE_BYTES * max(size / 100e6, 1e-9) ** 0.25)))
    thin = max(1, head["rows"] // (IDS_A_RANGE * n))
    some = base.select(key.alias("_key")).filter(F.pmod(F.xxhash64("_key"), F.lit(thin)) == 0)
    cuts = some.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] if n > 1 else None
    bounds = sorted(set(cuts or []))
    top = {r["_cell"]: r["top"] for r in base.select(cell_of(key, bounds).alias("_cell"), key.alias("_key")).groupBy("_cell").agg(F.max("_key").alias("top")).collect()}
    cells = sorted(top)
    # The largest id of each range goes to the range above, that of the highest to the lowest.
    above = dict(zip(cells, cells[1:] + cells[:1], strict=True))
    per_cell = lambda of: F.get(F.lit(np.array([of.get(c, 0) for c in range(len(bounds) + 1)], dtype=np.int64)), F.col("_cell"))
    to = lambda cell, copy: F.struct(cell.cast("int").alias("cell"), F.lit(copy).alias("copy"))
    dealt = base.withColumn("_key", key).withColumn("_cell", cell_of(F.col("_key"), bounds))
    both = F.array(to(F.col("_cell"), 0), to(per_cell(above), 1))
    dealt = dealt.withColumn("_to", F.explode(F.when(per_cell(top) == F.col("_key"), both).otherwise(F.array(to(F.col("_cell"), 0)))))
    ordered = (
        dealt.select(F.col("_to.cell").alias("cell"), F.col("_to.copy").alias("copy"), "_key", "doc_id", "text")
        .repartitionById(len(bounds) + 1, F.col("cell"))
        .sortWithinPartitions("cell", "copy", F.desc("_key"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple] = []

        def pair(a: tuple, b: tuple) -> None:
            half = len(a[2]) // 2
            edited = (a[2][: len(a[2]) - half] + b[2][:half]).encode()
            own = spots(edited, chain)
            rows.append((a[1], len(a[2]), hashlib.sha256(edited).hexdigest(), fingerprint(a[3]), fingerprint(own), likeness(a[3], own), likeness(a[3], b[3])))

        def made() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        over = None
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                for cell, copy, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if cell == over:  # this range's last row has been paired
                        continue
                    row = (cell, doc, text, spots(text.encode(), chain))
                    if held is not None:
                        pair(held, row)
                    held = row
                    if copy:
                        held, over = None, cell
                if rows:
                    yield made()
                    rows.clear()

    return ordered.select("cell", "copy", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
