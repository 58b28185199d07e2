"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by pseudo-rotations (three rounds of random signs and a fast Hadamard transform each) and
assigns it to the nearest signed axis of each: these axes are its bucket, the key of a join. A query probes the buckets
of the axes nearest to it, PROBES of them a table, in the order of the sum of its coordinates. Few axes are taken for
small tables of vectors and more for large ones, so that a bucket holds about FILL vectors, and the number of tables
follows from a simulation of the cosine that the k-th of so many random vectors has: all but MISS of them are met. Up to
EXACT vectors have one bucket without axes, which is exact.

Inner products favour long vectors: vectors are dealt to bands by powers of two of their length, each has its own
buckets, and queries probe all of them (and those of their own number of components only).

Buckets hold sketches, a byte a component, with the length and the sketch's own error. They bound an inner product from
below and above, so a candidate goes only if k others are surely nearer. A quarter of the tables is looked at first: the
k-th best lower bound there is the bar that candidates of all tables must reach, so that what comes out of the buckets
doesn't grow with what they hold (a bar for that quarter comes from SAMPLE vectors). What is left is ranked by the exact inner product of the original vectors, in double
precision. Where more than MANY * k vectors of a bucket reach a query's bar (near copies that sketches can't tell apart),
nothing comes out but the query: such queries go through the same buckets again with the vectors themselves.

Equal vectors are one vector with its smallest ids, so that a vector that a third of all rows share costs as much as any
other. A bucket's queries are held while its vectors stream by.

Edge cases: vectors that are null or zero, hold a null, a NaN or an infinity take no part, nor do rows with a null
vec_id; ties go to the smaller vec_id; of rows with one vec_id each is a candidate (but not of queries with that vec_id),
equal rows as often as they are there; queries that share a vec_id but not a vector have rankings of their own; fewer
than k other vectors give as many rows as there are; scores are what double arithmetic gives, infinite or NaN beyond it; empty tables give empty tables; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise

#: Probes a table, vectors a bucket, share that all tables may miss of the k-th nearest, vectors that need no axes.
PROBES, FILL, MISS, EXACT = 16, 20, 0.04, 1024
#: Vectors that give a first bar.
SAMPLE = 1024
#: One in so many tables is looked at first.
FIRST = 4
#: Times k that may come out of one place for a query by its sketch.
MANY = 5
#: Rows of buckets and pairs that are looked at together.
ROWS, PAIRS = 100_000, 200_000
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Each row, filled up with zeros, after pseudo-rotation `number`."""
    width = width_of(x.shape[1])
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    rng = np.random.default_rng((SEED, width, number))
    for _ in range(3):
        out = hadamard(out * rng.choice((-1.0, 1.0), width))
    return out


class Rotations:
    """Pseudo-rotations of vectors of one dimension. For few components each is worked out once, as what it does to the
    unit vectors, and blocks of vectors are multiplied by that."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def __call__(self, x: np.ndarray, number: int, axes: int) -> np.ndarray:
        """Signed axes as coordinates: the first `axes`, then their opposites."""
        if self.dim <= 256:
            if number not in self.known:
                self.known[number] = rotated(np.eye(self.dim), number).astype(np.float32)
            out = x.astype(np.float32) @ self.known[number][:, :axes]
        else:
            out = rotated(x, number)[:, :axes].astype(np.float32)
        return np.concatenate([out, -out], axis=1)


def best_sums(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Of one column from each part, for each row, the n combinations with the largest sums, as mixed-radix numbers."""
    sums, codes = np.zeros((len(parts[0]), 1), np.float32), np.zeros((len(parts[0]), 1), np.int64)
    for p in parts:
        m = min(n, p.shape[1])
        at = np.argpartition(-p, m - 1, axis=1)[:, :m]
        all_sums = (sums[:, :, None] + np.take_along_axis(p, at, 1)[:, None, :]).reshape(len(p), -1)
        all_codes = (codes[:, :, None] * p.shape[1] + at[:, None, :]).reshape(len(p), -1)
        m = min(n, all_sums.shape[1])
        pick = np.argpartition(-all_sums, m - 1, axis=1)[:, :m]
        sums, codes = np.take_along_axis(all_sums, pick, 1), np.take_along_axis(all_codes, pick, 1)
    return codes


def axes_of(n: int, dim: int) -> list[int]:
    """How many axes each rotation of a table has, for n vectors: whole ones, and a last one of as many as are still needed."""
    if n <= EXACT:
        return []
    width, out, buckets = width_of(dim), [], n / FILL
    while buckets > 2 * width:
        out.append(width)
        buckets /= 2 * width
    last = round(buckets / 2)
    return out + [min(width, last)] if last >= 1 else out or [1]


def tables_for(n: int, dim: int, k: int) -> int:
    """Tables at which all but MISS of the k-th nearest of n random vectors are met, by simulation."""
    axes = axes_of(n, dim)
    if not axes:
        return 1
    cosine = min(0.99, NormalDist().inv_cdf(1 - min(0.5, k / n)) / math.sqrt(dim))
    rng = np.random.default_rng((SEED, dim, n))
    asked, met = [], np.zeros(4000, np.int64)
    for a in axes:
        q, noise = rng.standard_normal((2, 4000, width_of(dim)), dtype=np.float32)[:, :, :a]
        x = cosine * q + math.sqrt(1 - cosine**2) * noise
        asked.append(np.concatenate([q, -q], axis=1))
        met = met * 2 * a + np.concatenate([x, -x], axis=1).argmax(1)
    hit = (best_sums(asked, PROBES) == met[:, None]).any(1).mean()
    return max(1, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - min(hit, 1 - 1e-9)))))


def sketched(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, bytes of their sketches, and mantissas and exponents of lengths; no length is too large or small."""
    most = np.abs(x).max(1)
    _, power = np.frexp(most)
    scaled = np.ldexp(x, -power[:, None])
    length = np.sqrt((scaled**2).sum(1))
    unit = scaled / length[:, None]
    step = np.abs(unit).max(1) / 127
    marks = np.rint(unit / step[:, None]).astype(np.int8)
    off = np.sqrt(((marks * step[:, None] - unit) ** 2).sum(1)) + 1e-6
    mantissa, more = np.frexp(length)
    head = np.stack([step.astype(np.float32), off.astype(np.float32), mantissa.astype(np.float32), (power + more).astype(np.float32)], 1)
    return unit, np.concatenate([head.view(np.uint8).reshape(len(x), -1), marks.view(np.uint8)], 1), power + more


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, rows and vectors of a batch of (id, v), a part at a time."""
    size = b.column(1).value_lengths().to_numpy()
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        for i in range(0, len(at), 2000):
            yield int(dim), at[i : i + 2000], matrix(b.column(1).take(pa.array(at[i : i + 2000])))


def keyed(rows: DataFrame, shape: dict[int, tuple[list[int], int]], bands: dict[int, list[int]], asks: bool, part: int = 1, whole: bool = False) -> DataFrame:
    """dim, bucket, member, id, sketch, bar: the buckets of vectors (asks: those that queries probe) in one of `part` tables.

    rows: id, v, bar (of vectors: null). whole: without sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, Rotations] = {}
        for b in batches:
            ids, bars = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for dim, at, x in by_dimension(b):
                unit, sketch, power = sketched(x)
                axes, tables = shape[dim]
                tables = -(-tables // part)
                own = turn.setdefault(dim, Rotations(dim))
                cells = math.prod(2 * a for a in axes)
                flat = pa.array([b"" if whole else r.tobytes() for r in sketch], pa.binary())
                for t in range(tables):
                    parts = [own(unit, t * len(axes) + j, a) for j, a in enumerate(axes)]
                    if not axes:
                        code = np.zeros((len(at), 1), np.int64)
                    elif asks:
                        code = best_sums(parts, PROBES)
                    else:
                        code = np.zeros((len(at), 1), np.int64)
                        for p in parts:
                            code = code * p.shape[1] + p.argmax(1)[:, None]
                    code = code + t * cells
                    if asks:  # each band
                        code = np.concatenate([code * 4096 + (2048 + band) for band in bands[dim]], 1)
                    else:
                        code = code * 4096 + (2048 + power)[:, None]
                    who = np.repeat(np.arange(len(at)), code.shape[1])
                    n = len(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(code.ravel()), pa.array(np.full(n, not asks)), pa.array(ids[at][who]), flat.take(pa.array(who)), pa.array(bars[at][who])],
                        names=["dim", "bucket", "member", "id", "sketch", "bar"],
                    )

    return rows.select("id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar")).mapInArrow(run, "dim int, bucket long, member boolean, id long, sketch binary, bar double")


def nearer(q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which pairs can be among the k best of their query: those that no k others are surely above."""
    if not q.size:
        return q
    order = np.lexsort((-low, q))
    first = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]]))
    size = np.diff(np.append(first, len(q)))
    bar = np.where(size >= k, low[order][np.minimum(first + k - 1, len(q) - 1)], -np.inf)
    return order[high[order] >= np.repeat(bar, size)]


def met(rows: DataFrame, k: int, tops: dict[int, int], only_best: bool = False, crowd: int = 0, exact: bool = False) -> DataFrame:
    """q, x, low, high: queries and vectors that share a bucket, with bounds of the inner product divided by the query's
    length and by two to the power of the highest band (tops, a dimension), less what k others surely beat and what doesn't reach the query's bar. only_best: the k with the
    best lower bounds. crowd: of a query for which more than so many would come out of one place only (q, -1, 0, 0)
    does. Sketches may be vectors themselves (eight bytes a component): bounds are then exact."""

    def pairs(top: int, bucket: np.ndarray, member: np.ndarray, ids: np.ndarray, bar: np.ndarray, sketch: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        run_of = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]).astype(np.int64)]))
        members = np.add.reduceat(member.astype(np.int64), starts)
        ends = np.append(starts[1:], len(bucket))
        asking = np.flatnonzero(~member)
        n = members[run_of[asking]]
        begin = ends[run_of[asking]] - n  # members come last
        if exact:
            vectors = np.ascontiguousarray(sketch).view(np.float64)
        else:
            head, marks = np.ascontiguousarray(sketch[:, :16]).view(np.float32), sketch[:, 16:].view(np.int8)
        upto, out = np.concatenate([[0], np.cumsum(n)]), []
        i = 0
        while i < len(asking):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, side="right")) - 1)
            for lo in range(0, int(n[i:j].max(initial=0)) if j == i + 1 else 1, PAIRS):
                size = np.minimum(n[i:j] - lo, PAIRS) if j == i + 1 else n[i:j]
                a = np.repeat(asking[i:j], size)
                b = np.repeat(begin[i:j] + lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                if not a.size:
                    continue
                if exact:
                    score = (vectors[a] * vectors[b]).sum(1)
                    out.append((ids[a], ids[b], score, score))
                    continue
                dot = np.einsum("ij,ij->i", marks[a].astype(np.float32), marks[b].astype(np.float32)).astype(np.float64)
                cosine = dot * head[a, 0] * head[b, 0]
                off = head[a, 1].astype(np.float64) + head[b, 1] * (1.0 + head[a, 1]) + 1e-5
                scale = np.ldexp(head[b, 2].astype(np.float64), head[b, 3].astype(np.int64) - top)
                low, high = (cosine - off) * scale, (cosine + off) * scale
                reach = np.flatnonzero(high >= bar[a])
                out.append((ids[a][reach], ids[b][reach], low[reach], high[reach]))
            i = j
        if not out:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
        q, x, low, high = (np.concatenate(c) for c in zip(*out, strict=True))
        once = first_of(q, x)
        q, x, low, high = q[once], x[once], low[once], high[once]
        keep = nearer(q, low, low if only_best else high, k)
        q, x, low, high = q[keep], x[keep], low[keep], high[keep]
        if crowd:
            who, n = np.unique(q, return_counts=True)
            full = who[n > crowd]
            rest = ~np.isin(q, full)
            more = lambda c, fill: np.concatenate([c[rest], np.full(len(full), fill, c.dtype)])
            q, x, low, high = np.concatenate([q[rest], full]), more(x, -1), more(low, 0), more(high, 0)
        return q, x, low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if not held:
                return
            dim, bucket, member, ids, bar = (np.concatenate([h[i] for h in held]) for i in range(5))
            sketches = [s for h in held for s in h[5]]
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                sketch = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(tops[int(d)], bucket[at], member[at], ids[at], bar[at], sketch)], names=["q", "x", "low", "high"])
            # The queries of the bucket that may go on stay.
            stay = np.flatnonzero((dim == dim[-1]) & (bucket == bucket[-1]) & ~member) if not last else np.empty(0, np.int64)
            held = [(dim[stay], bucket[stay], member[stay], ids[stay], bar[stay], [sketches[i] for i in stay])] if stay.size else []
            n = 0

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), b.column(5).to_numpy(), b.column(4).to_pylist()))
            n += b.num_rows
            if n >= ROWS:
                yield from flush(False)
        yield from flush(True)

    return rows.repartition("dim", "bucket").sortWithinPartitions("dim", "bucket", "member").mapInArrow(run, "q long, x long, low double, high double")


def first_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of distinct pairs."""
    order = np.lexsort((x, q))
    return order[np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (x[order][1:] != x[order][:-1])])] if order.size else order


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.coalesce(good, F.lit(False)).alias("good")).filter("good")
    # Of equal vectors the k + 1 smallest ids are enough: one of them may be the query's own.
    each = base.groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
    few = each.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)
    vectors = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    vectors = materialise(vectors.select(F.monotonically_increasing_id().alias("x"), "v", "ids"))
    asked = materialise(base.filter("q").select("id", "v").distinct().select(F.monotonically_increasing_id().alias("q"), "id", "v"))

    sizes: dict[int, int] = {}
    bands: dict[int, list[int]] = {}

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, _, x in by_dimension(b):
                found, n = np.unique(sketched(x)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim, np.int32)), pa.array(found.astype(np.int32)), pa.array(n)], names=["dim", "band", "n"])

    # Bands are powers of two of doubles: 2,100 a dimension at most.
    for r in vectors.select(F.col("x").alias("id"), "v").mapInArrow(powers, "dim int, band int, n long").groupBy("dim", "band").agg(F.sum("n").alias("n")).collect():
        sizes[r["dim"]] = sizes.get(r["dim"], 0) + r["n"]
        bands.setdefault(r["dim"], []).append(r["band"])
    shape = {d: (axes_of(n, d), tables_for(n, d, k)) for d, n in sizes.items()}
    if not shape:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # Of a query's nearest vectors, those of its own id don't count.
    more = k + (asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    tops = {d: max(x) for d, x in bands.items()}
    best = Window.partitionBy("q").orderBy(F.desc("low"), "x")
    held, none = vectors.select(F.col("x").alias("id"), "v", F.lit(None).cast("double").alias("bar")), F.lit(None).cast("double")

    def candidates(queries: DataFrame, part: int) -> DataFrame:
        both = keyed(held, shape, bands, False, part).unionByName(keyed(queries, shape, bands, True, part))
        return met(both, more, tops, part > 1, 0 if part > 1 else MANY * k).groupBy("q", "x").agg(F.max("low").alias("low"), F.max("high").alias("high"))

    some = vectors.select("x", "v").orderBy(F.xxhash64("v"), "x").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    first = candidates(barred(asked.select(F.col("q").alias("id"), "v"), some, more, tops), FIRST)
    bars = first.withColumn("place", F.row_number().over(best)).filter(F.col("place") == more).select("q", F.col("low").alias("bar"))
    asking = materialise(asked.join(bars.hint("merge"), "q", "left").select(F.col("q").alias("id"), "v", "bar"))
    found = materialise(candidates(asking, 1))
    crowded = materialise(found.filter("x < 0").select("q"))
    if crowded.isEmpty():
        return ranked(found, vectors, asked, more, k)
    found = found.join(crowded.hint("merge"), "q", "left_anti")
    again = asked.join(crowded.hint("merge"), "q", "left_semi")
    places = keyed(again.select(F.col("q").alias("id"), "v", none.alias("bar")), shape, bands, True, 1, True)
    wanted = places.select("dim", "bucket").distinct()
    there = keyed(held, shape, bands, False, 1, True).join(wanted.hint("merge"), ["dim", "bucket"], "left_semi")
    raw = lambda df, key: df.select(F.col(key).alias("id"), bytes_of(F.col("v")).alias("sketch"))
    rows_of = [side.drop("sketch").join(raw(of, key).hint("merge"), "id") for side, of, key in ((there, vectors, "x"), (places, again, "q"))]
    both = rows_of[0].unionByName(rows_of[1]).select("dim", "bucket", "member", "id", "sketch", "bar")
    close = met(both, more, tops, True, 0, True).groupBy("q", "x").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return ranked(found.unionByName(close), vectors, asked, more, k)


def barred(queries: DataFrame, sample: pa.Array, k: int, tops: dict[int, int]) -> DataFrame:
    """id, v, bar: below the k-th best inner product with the sample's vectors, in the units of met(); null for smaller samples."""
    sent = queries.sparkSession.sparkContext.broadcast(sample)  # SAMPLE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sent.value))), sent.value], names=["id", "v"])
        known: dict[int, list] = {}
        for dim, _, x in by_dimension(some):
            known.setdefault(dim, []).append(np.ldexp(x, -tops[dim]))
        for b in batches:
            bars = np.full(b.num_rows, -np.inf)
            for dim, at, x in by_dimension(b):
                of = np.concatenate(known[dim]) if dim in known else np.empty((0, dim))
                if len(of) >= k:
                    s = sketched(x)[0] @ of.T
                    bars[at] = np.partition(s, len(of) - k, axis=1)[:, len(of) - k] - 1e-6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bars)], names=["id", "v", "bar"])

    return queries.mapInArrow(run, "id long, v array<double>, bar double")


def bytes_of(v: Column) -> Column:
    """The components as doubles, end to end."""

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, np.float64).tobytes())

    return packed(v)


def ranked(found: DataFrame, vectors: DataFrame, asked: DataFrame, more: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the candidates found, by the exact inner product."""
    best = Window.partitionBy("q").orderBy(F.desc("low"), "x")
    of_query = Window.partitionBy("q")
    placed = found.withColumn("place", F.row_number().over(best))
    bar = F.max(F.when(F.col("place") == more, F.col("low"))).over(of_query)
    left = placed.withColumn("bar", bar).filter("bar is null or high >= bar").select("q", "x")

    whole = left.join(vectors.hint("merge"), "x").select("q", F.col("v").alias("w"), "ids").join(asked.hint("merge"), "q")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows_of = whole.select("q", F.col("id").alias("query_id"), score.alias("score"), F.explode("ids").alias("i")).filter("i.id <> query_id")
    rows_of = rows_of.select("q", "query_id", "score", F.col("i.id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("i.n"))).alias("copy"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows_of.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
