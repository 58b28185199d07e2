"""The object store as relations: content-keyed writes, indexing, edges, quarantine, reconciliation, checks on opening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import graph
from palimpsest.operators.order import positions

#: Presence of an object.
PRESENT, PROMISED, QUARANTINED, TOMBSTONED = 1, 2, 3, 4


def put_outcomes(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """object, outcome: stored, already_present, or quarantined (known under the same identity with other bytes).

    stored, arriving: object, payload. Of several arriving rows of an identity all must have the same bytes.
    """
    old = stored.select("object", F.sha2("payload", 256).alias("_old"))
    new = arriving.groupBy("object").agg(F.min(F.sha2("payload", 256)).alias("_low"), F.max(F.sha2("payload", 256)).alias("_high"))
    differs = (F.col("_low") != F.col("_high")) | (F.col("_old") != F.col("_low"))
    return new.join(old, "object", "left").select("object", F.when(F.coalesce(differs, F.col("_low") != F.col("_high")), "quarantined").when(F.col("_old").isNotNull(), "already_present").otherwise("stored").alias("outcome"))


def extracted_edges(objects: DataFrame, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """source, ordinal, role, expected_kind, target from nested identities.

    objects: object and a column for each field, an identity or an array of them. fields: column to (role, expected kind),
    in the order of edges. A repeated (role, expected kind, target) keeps its first place; ordinals are dense from 0.
    """

    def items(name: str, role: str, kind: str | None) -> Column:
        many = objects.schema[name].dataType.typeName() == "array"
        values = F.col(name) if many else F.array(F.col(name))
        found = F.transform(values, lambda x: F.struct(F.lit(role).alias("role"), F.lit(kind).cast("string").alias("expected_kind"), x.alias("target")))
        return F.filter(F.coalesce(found, F.array().cast("array<struct<role:string,expected_kind:string,target:string>>")), lambda e: e["target"].isNotNull())

    edges = F.array_distinct(F.concat(*[items(name, *rule) for name, rule in fields.items()]))
    return objects.select(F.col("object").alias("source"), F.posexplode(edges).alias("ordinal", "e")).select("source", F.col("ordinal").cast("long").alias("ordinal"), "e.role", "e.expected_kind", "e.target")


def indexed(stored: DataFrame, arriving: DataFrame, edges: DataFrame) -> DataFrame:
    """object, kind, presence after arriving objects and their edges are indexed: what edges point to is promised unless
    known, and keeps the kind that it was first known by. stored: object, kind, presence; arriving: object, kind."""
    rows = (
        stored.select("object", "kind", "presence", F.lit(0).alias("_rank"))
        .unionByName(arriving.select("object", "kind", F.lit(PRESENT).alias("presence"), F.lit(1).alias("_rank")))
        .unionByName(edges.select(F.col("target").alias("object"), F.col("expected_kind").alias("kind"), F.lit(PROMISED).alias("presence"), F.lit(2).alias("_rank")))
    )
    # Quarantine stays; else what is present wins over what is promised.
    strength = F.when(F.col("presence") == QUARANTINED, 0).otherwise(F.col("presence"))
    first_kind = F.min(F.when(F.col("kind").isNotNull(), F.struct("_rank", "kind")))["kind"]
    return rows.groupBy("object").agg(first_kind.alias("kind"), F.min_by("presence", strength).alias("presence"))


def rebuilt(edges: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """The derived tables: parents with dense positions and generations of snapshots and of operations.

    edges: source, ordinal, role, target; objects: object, kind.
    """
    out = {}
    for kind in ("snapshot", "operation"):
        nodes = objects.filter(F.col("kind") == kind).select(F.col("object").alias("node"))
        own = edges.filter(F.col("role") == f"{kind}_parent")
        out[f"{kind}_parents"] = graph.parent_positions(own, "source", "ordinal", "target")
        out[f"{kind}_generations"] = graph.generations(nodes, own.select(F.col("source").alias("node"), F.col("target").alias("parent")))
    return out


def promised(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """object, presence: known ones as they are, wanted ones that aren't known as promised."""
    new = wanted.select("object").distinct().join(known.select("object"), "object", "left_anti")
    return known.select("object", "presence").unionByName(new.select("object", F.lit(PROMISED).alias("presence")))


def quarantined(objects: DataFrame, edges: DataFrame, bad: DataFrame) -> dict[str, DataFrame]:
    """objects, edges, incidents and refused after quarantining bad (object, reason): only known identities can be; their
    edges go, an open incident that fails closed is recorded for each."""
    hit = bad.groupBy("object").agg(F.min("reason").alias("reason"))
    known = hit.join(objects.select("object"), "object", "left_semi")
    marked = objects.join(known.select("object", F.lit(True).alias("_hit")), "object", "left")
    return {
        "objects": marked.withColumn("presence", F.when(F.col("_hit"), QUARANTINED).otherwise(F.col("presence"))).drop("_hit"),
        "edges": edges.join(known.select(F.col("object").alias("source")), "source", "left_anti"),
        "incidents": known.select("object", "reason", F.lit(True).alias("open"), F.lit(True).alias("fail_closed")),
        "refused": hit.join(objects.select("object"), "object", "left_anti"),
    }


def reconciled(evidence: DataFrame, incidents: DataFrame) -> DataFrame:
    """object, path of evidence files that no incident names: each becomes an incident."""
    return evidence.select("object", "path").join(incidents.select("path"), "path", "left_anti").select("object", "path")


def inventory_class(path: Column) -> Column:
    """stale_temporary, quarantined, unindexed_orphan or unexpected, by a record file's place."""
    return (
        F.when(path.rlike(r"^objects/tmp/[^/]+$"), "stale_temporary")
        .when(path.rlike(r"^objects/quarantine/[^/]+$"), "quarantined")
        .when(path.startswith("objects/loose/"), "unindexed_orphan")
        .otherwise("unexpected")
    )


# Kinds of reference keys and the kind of object that each points to.
TARGET_KINDS = {"line": "line_state", "change": "change_revision", "operation_head": "operation", "release": "release", "marker": "marker"}


def reference_problems(references: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """key, problem: the first rule that a reference breaks.

    references: key, ref_kind, target, operation. objects: object, kind, identity. edges: source, target.
    """
    t = objects.select(F.col("object").alias("target"), F.col("kind").alias("_kind"), F.col("identity").alias("_identity"))
    o = objects.select(F.col("object").alias("operation"), F.col("kind").alias("_op"))
    named = edges.select(F.col("source").alias("operation"), "target", F.lit(True).alias("_named")).distinct()
    rows = references.join(t, "target", "left").join(o, "operation", "left").join(named, ["operation", "target"], "left")
    want = F.element_at(F.create_map(*[F.lit(x) for kv in TARGET_KINDS.items() for x in kv]), F.col("ref_kind"))
    head = F.col("ref_kind") == "operation_head"
    problem = (
        F.when(F.col("_kind").isNull() | F.col("_op").isNull(), "missing")
        .when(want.isNull() | (F.col("_kind") != want), "target_kind")
        .when(F.col("_op") != "operation", "operation_kind")
        .when(F.col("ref_kind").isin("line", "release", "change") & ~F.col("_identity").eqNullSafe(F.col("key")), "identity")
        .when(head & (F.col("target") != F.col("operation")), "head")
        .when(~head & F.col("_named").isNull(), "unnamed")
    )
    return rows.select("key", problem.alias("problem")).filter("problem is not null")


def location_problems(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """object, n of present objects without exactly one active loose location. locations: object, active, loose."""
    n = locations.filter(F.col("active") & F.col("loose")).groupBy("object").agg(F.count(F.lit(1)).alias("n"))
    rows = objects.filter(F.col("presence") == PRESENT).select("object").join(n, "object", "left").select("object", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.filter("n <> 1")


def value_problems(values: DataFrame, shapes: DataFrame) -> DataFrame:
    """object, field, problem: of each object the first field, by number, whose value has not the shape of its kind's rule.

    values: object, kind, field (number), type, size (bytes of a string or text, items of an array, else the number).
    shapes: kind, field, type, least, most (null: any).
    """
    rows = values.join(shapes.select("kind", "field", F.col("type").alias("_type"), "least", "most"), ["kind", "field"])
    problem = (
        F.when(F.col("type") != F.col("_type"), "type").when(F.col("size") < F.col("least"), "too_small").when(F.col("size") > F.col("most"), "too_large")
    )
    bad = rows.withColumn("problem", problem).filter("problem is not null")
    return bad.groupBy("object").agg(F.min(F.struct("field", "problem")).alias("p")).select("object", "p.field", "p.problem")


def load_problems(checks: dict[str, DataFrame]) -> DataFrame:
    """check, n: how many rows each check of an opening store finds; a check that holds has none."""
    parts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def grant_problems(policies: DataFrame) -> DataFrame:
    """policy, problem: grants that name no listed principal, or whose capabilities aren't sorted and distinct.

    policies: policy, principals (array), grants (array of struct principal: place in principals, capabilities: array).
    """
    g = policies.select("policy", F.size("principals").alias("n"), F.explode("grants").alias("g"))
    bad = F.when((F.col("g.principal") < 0) | (F.col("g.principal") >= F.col("n")), "principal").when(F.col("g.capabilities") != F.array_sort(F.array_distinct("g.capabilities")), "capabilities")
    return g.select("policy", bad.alias("problem")).filter("problem is not null").distinct()


def key_problems(identities: DataFrame) -> DataFrame:
    """identity, key, problem: keys that occur more than once over all arrays of an identity, or whose algorithm isn't one of their use.

    identities: identity, keys (array of struct use, key, algorithm).
    """
    k = identities.select("identity", F.explode("keys").alias("k")).select("identity", "k.key", "k.use", "k.algorithm")
    twice = k.groupBy("identity", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("identity", "key", F.lit("repeated").alias("problem"))
    wrong = k.filter((F.col("use") == "sign") != F.col("algorithm").startswith("ed")).select("identity", "key", F.lit("algorithm").alias("problem")).distinct()
    return twice.unionByName(wrong)


def artifact_ok(digest: Column, locator: Column, blob: Column) -> Column:
    """A digest of 32 bytes, and a locator or a blob."""
    return F.coalesce((F.octet_length(digest) == 32) & (locator.isNotNull() | blob.isNotNull()), F.lit(False))


def evidence_kinds_ok(kinds: Column) -> Column:
    """Evidence kinds 20 to 23, sorted and distinct."""
    return F.forall(kinds, lambda k: k.between(20, 23)) & (kinds == F.array_sort(F.array_distinct(kinds)))


def chunk_sums(chunks: DataFrame, whole: DataFrame) -> DataFrame:
    """object, stated, found where chunk lengths don't add up. chunks: object, length; whole: object, length."""
    s = chunks.groupBy("object").agg(F.sum("length").alias("found"))
    return whole.select("object", F.col("length").alias("stated")).join(s, "object", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("stated <> found")


def restricted(asked: dict[str, Column], most: dict[str, int]) -> dict[str, Column]:
    """Limits of a caller, who may tighten a profile but not relax it."""
    return {name: F.least(c, F.lit(most[name])) for name, c in asked.items()}


def ancestry(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (node, parent) between objects of one kind, and those (node, parent, problem) that join others or lead nowhere."""
    k = lambda name, as_: objects.select(F.col("object").alias(name), F.col("kind").alias(as_))
    rows = edges.select("node", "parent").distinct().join(k("node", "_own"), "node").join(k("parent", "_of"), "parent", "left")
    problem = F.when(F.col("_of").isNull(), "missing").when(~F.col("_own").isin("snapshot", "operation"), "invalid_graph").when(F.col("_own") != F.col("_of"), "wrong_kind")
    rows = rows.withColumn("problem", problem)
    return rows.filter("problem is null").select("node", "parent"), rows.filter("problem is not null").select("node", "parent", "problem")


def pinned_roots(roots: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """object: roots and what unexpired leases pin. leases: object, expires."""
    return roots.select("object").union(leases.filter(F.col("expires") > now).select("object")).distinct()


def backup_manifest(roots: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """position, object, kind of all that the roots reach, in the order of identities."""
    live = graph.closure(roots, edges).select("object").distinct().join(objects.select("object", "kind"), "object")
    return positions(live, F.col("object")).select("position", "object", "kind")
