"""MinHash near-duplicates by an LSH forest, with exact links.

A text is the set of its shingles of `words` words, with a signature of 128 minima. A forest sorts all signatures in
several orders: order t reads the minima from 4t on. Neighbours in an order with the longest common prefixes are candidates:
a region is a run of neighbours that share a prefix, at first of FLOOR minima. A region of more than REGION texts is too
shallow and is split where the next minimum differs, and so on, so that depth follows the region; what shares all LENGTH
minima of an order is one group as it stands. Texts of regions that were split go through a second forest besides, of 128
orders with a floor of eight, as deep prefixes are shared less often. A pair of similarity 0.8 shares the floor of no order
of the first forest with a chance of 5 * 10^-8, of none of the second with one of about 2 * 10^-5 (its orders read the same
128 minima). Orders are sorted by ranges; a region that is cut by the end of a range is two in that order.
Within a region, sketches of one byte a minimum find groups at an estimate of ROUGH or more, far under the threshold. Groups
only bring candidates together: in each, links are found on the full sets, by a breadth-first search that compares only texts not yet
connected. A group too large for one task is cut into chunks, searched each; then a hub and all texts outside the
largest part are compared with every chunk, so no link between parts is lost.

Equal sets are one node throughout, so that copies cost nothing. No pairs of a group are listed.

Edge cases: null and empty texts, and texts without words, have the empty set and are linked with nothing; texts with
fewer words than a shingle have one shingle of them all; rows that share a doc_id but not a text are documents of their
own; a null doc_id counts as larger than all others and links like them (a component of such rows only has a null
component_id); empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import mapped, materialise, texts
from palimpsest.llm.components import components

#: Minima of a signature, minima that an order sorts by, orders and floors of both forests.
MINIMA, LENGTH, ORDERS, FLOOR, DEEP_ORDERS, DEEP_FLOOR = 128, 12, 32, 4, 128, 8
#: Most texts of a region that are compared by sketches, and rows of an order that a task holds at once.
REGION, ROWS = 2000, 400_000
#: Similarity by sketches (standard error 0.035 at 0.8) from which texts are in one group.
ROUGH = 0.62
#: Shingles of the sets that one task may hold.
CHUNK = 4_000_000

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 2**32, MINIMA, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
_DEEP_PICKS = np.stack([_rng.permutation(MINIMA)[:LENGTH] for _ in range(DEEP_ORDERS)])
_PICKS = np.stack([(MINIMA // ORDERS * t + np.arange(LENGTH)) % MINIMA for t in range(ORDERS)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles. Hashes of seen words are kept, for up to keep words."""

    def __init__(self, words: int, keep: int = 200_000):
        self.words, self.keep, self.seen = words, keep, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, seen = text.lower().split(), self.seen
        if not words:
            return np.empty(0, np.uint64)
        try:
            h = np.array([seen[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(seen) > self.keep:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([seen[w] for w in words], dtype=np.uint64)
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out = mixed(out * _MIX + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (_MUL[:, None] * low[None, i : i + 4096] + _ADD[:, None]).min(1), out=out)
    return out


def identity() -> Column:
    """What tells documents apart: doc_id (null last) and a hash of the text, in the order of representatives."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"))


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, node (a digest of the set, null if empty), sig, sketch (the low byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingles(words)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sets = [own(t) for t in texts(part.column(1))]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if x is None else x.tobytes() for x in sigs], pa.binary()),
                        pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in sigs], pa.binary()),
                    ],
                    names=["doc_id", "h", "n_shingles", "node", "sig", "sketch"],
                )

    text = F.col("text").cast("string")
    return mapped(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n_shingles long, node binary, sig binary, sketch binary")


def prefixed(nodes: DataFrame, deep: bool) -> DataFrame:
    """tree, p0, p1, p2, node: the prefix of each text in each order, four minima of 16 bits a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = _DEEP_PICKS if deep else _PICKS
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, MINIMA).astype(np.uint16)
                got = np.ascontiguousarray(sig[:, picks].astype(">u2")).view(">i8").astype(np.int64).reshape(-1, LENGTH // 4)
                n = len(picks)
                tree = np.tile(np.arange(n, dtype=np.int16), len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(tree), *[pa.array(np.ascontiguousarray(got[:, j])) for j in range(3)], part.column(0).take(pa.array(np.repeat(np.arange(len(sig)), n)))], names=["tree", "p0", "p1", "p2", "node"])

    return mapped(nodes.select("node", "sig"), run, "tree short, p0 long, p1 long, p2 long, node binary")


def shared(p: np.ndarray) -> np.ndarray:
    """How many leading minima each row of prefixes (tree, p0, p1, p2) shares with the row before; none with another tree."""
    out = np.zeros(len(p), np.int64)
    same = np.ones(len(p) - 1, bool) if len(p) else np.empty(0, bool)
    same &= p[1:, 0] == p[:-1, 0]
    for j in range(1, p.shape[1]):
        differ = (p[1:, j] ^ p[:-1, j]).view(np.uint64)
        equal = (differ >> np.uint64(48) == 0).astype(np.int64)
        for k in (32, 16, 0):
            equal += (equal == (48 - k) // 16) & (differ >> np.uint64(k) == 0)
        out[1:] += np.where(same, equal, 0)
        same &= differ == 0
    return out


def regions(trees: DataFrame, floor: int) -> DataFrame:
    """region, node, hub, split: regions of two texts or more in each order, equal ones under one number.

    hub: of texts that share the whole prefix and are too many, the first, with which each belongs; region is null then.
    split: the text's region at the floor was too large (region is null if nothing is left beside the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_p, held_n = np.empty((0, 4), np.int64), np.empty((0, 2), np.uint64)

        def closed(p: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(p):
                return
            lcp = shared(p)
            depth = np.full(len(p), floor)
            hub = np.full(len(p), -1)
            while True:
                first = np.flatnonzero(lcp < depth)
                size = np.diff(np.append(first, len(p)))
                large = np.repeat(size > REGION, size)
                if not (large & (depth < LENGTH)).any():
                    break
                depth = np.where(large & (depth < LENGTH), depth + 1, depth)
            own = np.repeat(np.arange(len(first)), size)
            hub = np.where(large, first[own], -1)
            split = depth > floor
            number = np.add.reduceat(mixed(names[:, 0] ^ names[:, 1]), first)[own].view(np.int64)
            several = (size > 1)[own]
            use = np.flatnonzero(several | split)
            raw = names.tobytes()
            name = [raw[16 * i : 16 * i + 16] for i in use]
            no_region = ~several[use] | (hub[use] >= 0)
            hubs = [raw[16 * h : 16 * h + 16] if h >= 0 else None for h in hub[use].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(number[use], mask=no_region), pa.array(name, pa.binary()), pa.array(hubs, pa.binary()), pa.array(split[use])], names=["region", "node", "hub", "split"])

        for b in batches:
            p = np.stack([b.column(j).to_numpy().astype(np.int64) for j in range(4)], 1)
            held_p = np.concatenate([held_p, p])
            held_n = np.concatenate([held_n, np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, 2)])
            if len(held_p) >= ROWS:
                # What may go on stays; a region of more than half of ROWS is cut here.
                open_ = np.flatnonzero(shared(held_p) < floor)[-1]
                at = open_ if open_ > len(held_p) // 2 else len(held_p)
                yield from closed(held_p[:at], held_n[:at])
                held_p, held_n = held_p[at:], held_n[at:]
        yield from closed(held_p, held_n)

    order = ["tree", "p0", "p1", "p2", "node"]
    return mapped(trees.repartitionByRange(*order).sortWithinPartitions(*order), run, "region long, node binary, hub binary, split boolean")


def search(n: int, pivot_hits: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span each component of 0..n-1; pivot_hits(x, others) are those of others linked with x."""
    left, out = np.arange(n), []
    while left.size:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            x = queue.pop()
            hits = pivot_hits(x, left)
            if hits.size:
                out += [(x, int(y)) for y in hits]
                queue += hits.tolist()
                left = np.setdiff1d(left, hits, assume_unique=True)
    return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of sorted batches by their first column."""
    at, held, none = None, [], True
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if none or row[0] != at:
                if held:
                    yield at, held
                at, held, none = row[0], [], False
            held.append(row)
    if held:
        yield at, held


def edge_batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])


def rough_edges(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: within each region, edges that span its groups by sketches. members: region, node."""
    # A region that several orders have is looked at once; a text has one region an order at most.
    of = members.groupBy("node").agg(F.collect_set("region").alias("regions"))
    rows = of.join(nodes.select("node", "sketch").hint("merge"), "node").select(F.explode("regions").alias("region"), "node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for _, held in runs(batches):
            own = [r[1] for r in held]
            m = np.frombuffer(b"".join([r[2] for r in held]), np.uint8).reshape(-1, MINIMA)
            least = int(np.ceil(ROUGH * MINIMA))
            out += [(own[x], own[y]) for x, y in search(len(own), lambda x, o, m=m: o[(m[o] == m[x]).sum(1) >= least])]
            if len(out) > 20_000:
                yield edge_batch(out)
                out = []
        if out:
            yield edge_batch(out)

    return mapped(rows.repartition("region").sortWithinPartitions("region"), run, "a binary, b binary")


def groups(nodes: DataFrame) -> DataFrame:
    """node, root: groups that hold every link; nodes of no group are absent."""
    found = []
    for deep in (False, True):
        members = materialise(regions(prefixed(nodes, deep), DEEP_FLOOR if deep else FLOOR))
        found.append(rough_edges(members.filter("region is not null").select("region", "node"), nodes))
        found.append(members.filter("hub is not null and hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        split = members.filter("split").select("node").distinct()
        if deep or split.isEmpty():
            break
        nodes = nodes.join(split.hint("merge"), "node", "left_semi")
    edges = found[0]
    for x in found[1:]:
        edges = edges.union(x)
    return components(edges)


class Sets:
    """Full sets of one task and their intersections."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.start[i] : self.start[i + 1]]

    def hits(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others with 100 * common >= percent * union; sizes alone rule most out."""
        a, b = self.size[x], self.size[others]
        others = others[(100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        if not others.size:
            return others
        self.mark[self.of(x)] = 1
        size = self.size[others]
        at = np.repeat(self.start[others] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        common = np.add.reduceat(self.mark[self.ids[at]], np.concatenate([[0], np.cumsum(size)[:-1]]))
        self.mark[self.of(x)] = 0
        return others[100 * common >= percent * (a + size - common)]


def exact_edges(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links that span the components of each run. rows: run, side, part, node, text.

    side null: all of the run are compared. Else only side 0 with side 1, where their parts differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingles(words)
        out: list[tuple[bytes, bytes]] = []
        for _, held in runs(batches):
            named: dict[tuple, tuple] = {}
            for _, side, part, node, text in held:
                if (side, node) not in named:
                    named[side, node] = (part, own((text or "").encode()))
            ids = [k for k, (_, s) in named.items() if len(s)]
            if len(ids) < 2:
                continue
            sets = Sets([named[k][1] for k in ids])
            if ids[0][0] is None:
                got = search(len(ids), lambda x, o, s=sets: s.hits(x, o, percent))
            else:
                got, part = [], [named[k][0] for k in ids]
                code = {p: i for i, p in enumerate(dict.fromkeys(part))}
                label = np.array([code[p] for p in part])
                right = np.array([i for i, k in enumerate(ids) if k[0] == 1], dtype=np.int64)
                for x in [i for i, k in enumerate(ids) if k[0] == 0]:
                    hits = sets.hits(x, right[label[right] != label[x]], percent)
                    got += [(x, int(y)) for y in hits]
                    if hits.size:
                        label[np.isin(label, label[hits])] = label[x]
            out += [(ids[x][1], ids[y][1]) for x, y in got]
            if len(out) > 20_000:
                yield edge_batch(out)
                out = []
        if out:
            yield edge_batch(out)

    return mapped(rows.select("run", "side", "part", "node", "text").repartition("run").sortWithinPartitions("run"), run, "a binary, b binary")


def linked(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = 0) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept, node, stays: components of the links with similarity of percent or more.

    kept is doc_id = component_id; stays also tells rows of a component apart that share its smallest doc_id but not the text.
    """
    chunk = chunk or CHUNK
    rows = materialise(described(docs, words))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h"))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(own).alias("first"), F.max("n_shingles").alias("size"), F.max("sig").alias("sig"), F.max("sketch").alias("sketch"))
    nodes = materialise(nodes)
    grouped = materialise(groups(nodes).join(nodes.select("node", "first", "size"), "node"))
    weights = grouped.groupBy("root").agg(F.sum("size").alias("weight"))
    dealt = grouped.join(weights, "root").withColumn("chunks", F.ceil(F.col("weight") / chunk)).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    held = dealt.hint("merge").join(docs.select(identity().alias("first"), F.col("text").cast("string").alias("text")), "first")
    none = F.lit(None).cast("int")
    alone = held.select(F.struct("root", "chunk").alias("run"), none.alias("side"), F.lit(None).cast("binary").alias("part"), "node", "text", "chunks")
    large = weights.filter(F.col("weight") > chunk)
    if large.isEmpty():
        links = materialise(exact_edges(alone, words, percent))
    else:
        kept = materialise(held.select("root", "chunk", "chunks", "node", "text").filter("chunks > 1"))
        links = materialise(exact_edges(alone, words, percent))
        for hub in (True, False):
            part = components(links)
            placed = materialise(kept.join(part.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")))
            counts = placed.groupBy("root", "part").count()
            most = counts.groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("_most"))
            marked = placed.join(most, "root")
            # First the texts of one chunk, then all outside the largest part, meet every chunk.
            left = marked.filter(F.col("chunk") == 0) if hub else marked.filter(F.col("part") != F.col("_most"))
            slices = left.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")) if not hub else F.lit(0))
            left = slices.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(F.struct("root", F.col("to").alias("chunk"), F.col("slice").cast("long").alias("slice")).alias("run"), F.lit(0).alias("side"), "part", "node", "text")
            used = slices.select("root", F.col("slice").cast("long").alias("slice")).distinct()
            right = marked.join(used, "root").select(F.struct("root", F.col("chunk"), "slice").alias("run"), F.lit(1).alias("side"), "part", "node", "text")
            links = materialise(links.union(exact_edges(left.union(right), words, percent)))
    part = components(links)
    least = part.join(nodes.select("node", "first"), "node")
    roots = least.groupBy("root").agg(F.min("first").alias("keeper"))
    of = least.join(roots, "root").select("node", "keeper")
    named = nodes.select("node", "first").join(of, "node", "left").select("node", F.coalesce("keeper", "first").alias("keeper"))
    out = rows.select("doc_id", "h", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("keeper.id"))
    stays = F.col("node").isNull() | (F.col("keeper.id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.h") == F.col("h")))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "node", stays.alias("stays"))
