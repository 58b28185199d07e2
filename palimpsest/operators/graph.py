"""Graphs: generations, order, ancestors, cycles, typed closures."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans import cut


def generations(nodes: DataFrame, edges: DataFrame, rounds: int = 100_000, strict: bool = True) -> DataFrame:
    """node, generation: the longest path from a root. edges: node, parent.

    Kahn's rounds: a node is placed one round after the last of its parents, so its round is its generation. Each round
    joins what was placed with the edges out of it and counts parents placed. Nodes on or behind cycles, or behind
    missing parents, are an error, or absent if not strict.
    """
    edges = cut(edges.select("node", "parent").distinct().repartition("parent"))  # every round joins by parent
    waiting = cut(edges.groupBy("node").agg(F.count(F.lit(1)).alias("left")))
    placed = nodes.select("node").distinct().join(waiting, "node", "left_anti").select("node", F.lit(0).cast("long").alias("generation"))
    out = layer = cut(placed)
    n = 0
    while n < rounds:
        n += 1
        met = edges.join(layer.select(F.col("node").alias("parent")), "parent").groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        waiting = cut(waiting.join(met, "node", "left").select("node", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")))
        layer = waiting.filter("left = 0").select("node", F.lit(n).cast("long").alias("generation"))
        if layer.isEmpty():
            if strict and not waiting.isEmpty():
                raise ValueError("a cycle or a missing parent")
            return out
        waiting = waiting.filter("left > 0")
        out = out.unionByName(layer)
    raise ValueError("the graph is deeper than the rounds allow")


def reach(edges: DataFrame, start: str = "node", to: str = "parent", rounds: int = 100_000) -> DataFrame:
    """start, to: the transitive closure by doubling paths: after n rounds it holds paths of up to 2^n edges."""
    one = edges.select(F.col(start).alias("a"), F.col(to).alias("b")).distinct()
    out, size = cut(one), -1
    for _ in range(rounds):
        longer = out.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        out = cut(out.union(longer).distinct())
        n = out.count()
        if n == size:
            break
        size = n
    return out.select(F.col("a").alias(start), F.col("b").alias(to))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, position: by generation, then node."""
    g = generations(nodes, edges)
    # Positions without one global window: rows before each generation, and ranks within it.
    sizes = g.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("generation").orderBy("node"))
    return g.join(before, "generation").select("node", (F.col("before") + rank - 1).cast("long").alias("position"))


def topological_exact(nodes: DataFrame, edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node, position: the lexicographically smallest order of each graph. nodes: graph, node; edges: graph, node, parent.

    The order is sequential, so each graph is ordered by one task.
    """

    def run(n: pa.Table, e: pa.Table) -> pa.Table:
        ids = sorted(set(n.column("node").to_pylist()))
        parents: dict = {x: set() for x in ids}
        children: dict = {x: [] for x in ids}
        for a, p in set(zip(e.column("node").to_pylist(), e.column("parent").to_pylist(), strict=True)):
            parents[a].add(p)
            children.setdefault(p, []).append(a)
        ready, out = [x for x in ids if not parents[x]], []
        heapq.heapify(ready)
        while ready:
            x = heapq.heappop(ready)
            out.append(x)
            for c in children[x]:
                parents[c].discard(x)
                if not parents[c]:
                    heapq.heappush(ready, c)
        if len(out) != len(ids):
            raise ValueError("a cycle or a missing parent")
        g = n.column("graph")[0].as_py() if n.num_rows else 0
        return pa.table({"graph": pa.array([g] * len(out), pa.int64()), "node": pa.array(out, pa.int64()), "position": pa.array(range(len(out)), pa.int64())})

    a = nodes.select(F.col(graph).cast("long").alias("graph"), F.col("node").cast("long").alias("node"))
    b = edges.select(F.col(graph).cast("long").alias("graph"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
    return a.groupBy("graph").cogroup(b.groupBy("graph")).applyInArrow(run, "graph long, node long, position long")


def cycle_members(edges: DataFrame) -> DataFrame:
    """node: those that reach themselves."""
    return reach(edges).filter("node = parent").select("node").distinct()


def missing_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, parent of edges to no node."""
    return edges.select("node", "parent").distinct().join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", "parent")


def parent_positions(edges: DataFrame, source: str, ordinal: str, target: str) -> DataFrame:
    """source, position, target: dense positions from 0 in ordinal order."""
    w = Window.partitionBy(source).orderBy(ordinal)
    return edges.select(F.col(source).alias("source"), (F.row_number().over(w) - 1).cast("long").alias("position"), F.col(target).alias("target"))


def closure(roots: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """root, object: what each root reaches, itself included. edges: source, target."""
    out = roots.select(F.col("object").alias("root"), "object").distinct()
    layer = out
    links = cut(edges.select(F.col("source").alias("object"), "target").distinct().repartition("object"))  # every round joins by it
    for _ in range(rounds):
        step = layer.join(links, "object").select("root", F.col("target").alias("object")).distinct()
        layer = cut(step.join(out, ["root", "object"], "left_anti"))
        if layer.isEmpty():
            return out
        out = out.unionByName(layer)
    raise ValueError("the closure is deeper than the rounds allow")


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, problem: what keeps a graph from having an order: duplicate nodes, missing parents, members of cycles."""
    twice = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", F.lit("duplicate").alias("problem"))
    lost = missing_parents(nodes, edges).select("node", F.lit("missing_parent").alias("problem")).distinct()
    return twice.unionByName(lost).unionByName(cycle_members(edges).withColumn("problem", F.lit("cycle")))


def checked_closure(roots: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """root, status: ok if all that a root reaches is present and of the kind expected, else the worst of missing,
    quarantined, promised and wrong_kind. Nothing is followed behind what fails."""
    met = cut(edge_status(edges, objects))
    status = F.create_map(*[F.lit(x) for kv in {"missing": 0, "quarantined": 1, "promised": 2, "wrong_kind": 3}.items() for x in kv])
    live = closure(roots, met.filter("status = 'ok'").select("source", "target"))
    bad = live.join(met.filter("status <> 'ok'").select(F.col("source").alias("object"), "status"), "object").groupBy("root").agg(F.min_by("status", status[F.col("status")]).alias("status"))
    return roots.select(F.col("object").alias("root")).distinct().join(bad, "root", "left").select("root", F.coalesce("status", F.lit("ok")).alias("status"))


def edge_status(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """source, target, status: ok, missing, promised, quarantined or wrong_kind.

    edges: source, target, expected_kind (nullable). objects: object, kind, presence (1 present, 2 promised, 3 quarantined).
    """
    o = objects.select(F.col("object").alias("target"), "kind", "presence")
    status = (
        F.when(F.col("presence").isNull(), "missing").when(F.col("presence") == 3, "quarantined").when(F.col("presence") == 2, "promised")
        .when(F.col("expected_kind").isNotNull() & (F.col("expected_kind") != F.col("kind")), "wrong_kind").otherwise("ok")
    )
    return edges.join(o, "target", "left").select("source", "target", status.alias("status"))


def dead(objects: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """object: those that no root reaches."""
    return objects.select("object").distinct().join(closure(roots, edges).select("object"), "object", "left_anti")
