"""Relations that the registered queries derive from the test tables; all are deterministic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.access import with_policy
from palimpsest.operators.manifest import fingerprinted
from palimpsest.sources import table

POLICIES = [("src1", ["team/security"]), ("src1/en", ["admin"]), ("src2", ["customer/acme"])]
ACTORS = [("public", ["public"]), ("admin", ["admin"]), ("alice", ["public"]), ("bob", ["public", "team/security"])]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "prefix string, domains array<string>")


def actors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTORS, "actor string, domains array<string>")


def domains_of(actor: str):
    return F.array(*[F.lit(d) for d in dict(ACTORS)[actor]])


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, hash, bytes, doc_id, source."""
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"), "doc_id", "source")


def secured(spark: SparkSession, df: DataFrame) -> DataFrame:
    return with_policy(df, policies(spark))


def three_manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, line and incoming manifests (path, hash, bytes): the latter two lack, change and add files by rules on doc_id."""
    base = files(spark, d)
    n = F.col("doc_id")
    changed = lambda when, tag: F.when(when, F.sha2(F.concat("hash", F.lit(tag)), 256)).otherwise(F.col("hash"))
    added = base.filter(n % 29 == 0).withColumn("path", F.concat("path", F.lit(".new")))
    new = F.sha2(F.concat("hash", F.lit("new")), 256)
    line = base.filter((n % 11 != 0) & (n % 23 != 0)).withColumn("hash", changed(n % 7 == 0, "line")).unionByName(added.withColumn("hash", new))
    other = F.when(n % 2 == 0, new).otherwise(F.sha2(F.concat("hash", F.lit("new2")), 256))
    incoming = base.filter(n % 13 != 0).withColumn("hash", changed(n % 3 == 0, "incoming")).unionByName(added.withColumn("hash", other))
    return tuple(x.select("path", "hash", "bytes") for x in (base, line, incoming))


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, conv_id, turn) and edges (node, parent, conv_id): each turn after the first has the one before as parent, and
    every third also the one before that."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100_000 + F.col("turn")).alias("node")).distinct()
    parents = F.array_compact(F.array(F.when(F.col("turn") >= 1, F.col("node") - 1), F.when((F.col("turn") >= 2) & (F.col("turn") % 3 == 2), F.col("node") - 2)))
    return c, c.select("conv_id", "node", F.explode(parents).alias("parent"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, actor, kind, domains, private_message, public_message from events."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "integrate_line").when(F.col("event_type") == "signup", "create_change").when(F.col("event_type") == "error", "set_policy").otherwise("snapshot")
    domains = F.when(F.col("event_type") == "error", F.array(F.lit("admin"))).when(F.col("event_type") == "purchase", F.array(F.lit("team/security"))).otherwise(F.array(F.lit("public")))
    private = F.concat_ws(" ", F.col("event_type"), F.lit("by"), F.col("user_id").cast("string"))
    shown = F.when(F.col("event_type") == "purchase", "an integration")
    return e.select("event_id", "ts", F.col("user_id"), kind.alias("kind"), domains.alias("domains"), private.alias("private_message"), shown.alias("public_message"))


def typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Objects (object, kind) and edges (source, target, expected_kind) of orders, customers, nations and regions."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    parts = {
        "order": ("orders", "o_orderkey", ("customer", "o_custkey")),
        "customer": ("customer", "c_custkey", ("nation", "c_nationkey")),
        "nation": ("nation", "n_nationkey", ("region", "n_regionkey")),
        "region": ("region", "r_regionkey", None),
    }
    objects, edges = [], []
    for kind, (t, key, to) in parts.items():
        df = table(spark, d, t)
        objects.append(df.select(name(kind, key).alias("object"), F.lit(kind).alias("kind")))
        if to:
            edges.append(df.select(name(kind, key).alias("source"), name(*to).alias("target"), F.lit(to[0]).alias("expected_kind")))
    return reduce(DataFrame.unionByName, objects), reduce(DataFrame.unionByName, edges)


def reference_log(spark: SparkSession, d: str) -> DataFrame:
    """key (customer), seq, attempt (order), expected: each order expects the generation of the one before it, but every
    seventh order that isn't a key's first expects one less (a stale attempt)."""
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    seq = F.row_number().over(w) - 1
    r = o.select(F.col("o_custkey").alias("key"), seq.cast("long").alias("seq"), F.col("o_orderkey").alias("attempt"))
    r = r.withColumn("stale", ((F.col("attempt") % 7 == 0) & (F.col("seq") > 0)).cast("int"))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    won = F.coalesce(F.sum(1 - F.col("stale")).over(before), F.lit(0))
    expected = F.when(won - 1 - F.col("stale") >= 0, won - 1 - F.col("stale"))
    return r.select("key", "seq", "attempt", expected.cast("long").alias("expected"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


__all__ = ["fingerprinted", "files", "secured", "three_manifests", "turns", "operations", "typed", "reference_log", "urls", "policies", "actors", "domains_of"]
