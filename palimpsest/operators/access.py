"""Row-level security by policy domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import reach
from palimpsest.operators.manifest import prefixes


def public() -> Column:
    return F.array(F.lit("public"))


def can_access(actor: Column, policy: Column) -> Column:
    """The actor is an admin or shares a domain with the policy; an empty policy is for admins only."""
    return F.array_contains(actor, "admin") | F.coalesce(F.arrays_overlap(policy, actor), F.lit(False))


def can_access_all(actor: Column, policies: Column) -> Column:
    """Access to every policy of an array of policies."""
    return F.forall(policies, lambda p: can_access(actor, p))


def visible(df: DataFrame, actor: Column, policy: str = "domains") -> DataFrame:
    """Rows that the actor may see: put below outer joins, where no optimizer would move it."""
    return df.filter(can_access(actor, F.col(policy)))


def with_policy(df: DataFrame, policies: DataFrame, path: str = "path") -> DataFrame:
    """Adds domains: the policy of the longest prefix by whole segments, public without one.

    An equi-join on the exploded prefixes of each distinct folder, not a scan of all policies for each path: paths share
    folders, so the join runs over folders. policies: prefix (unique), domains.
    """
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    split = df.withColumn("_folder", folder)
    folders = split.select("_folder").distinct().withColumn("_prefix", F.explode(prefixes(F.col("_folder"))))
    best = folders.join(policies.select(F.col("prefix").alias("_prefix"), "domains"), "_prefix").groupBy("_folder").agg(F.max_by("domains", F.length("_prefix")).alias("_by_folder"))
    own = policies.select(F.col("prefix").alias("_own"), F.col("domains").alias("_by_path"))
    out = split.join(best, "_folder", "left").join(own, F.col(path) == F.col("_own"), "left")
    return out.withColumn("domains", F.coalesce("_by_path", "_by_folder", public())).drop("_folder", "_own", "_by_path", "_by_folder")


def with_policy_theta(df: DataFrame, policies: DataFrame, path: str = "path") -> DataFrame:
    """The same by comparing each path with every policy (for few policies)."""
    p = policies.select(F.col("prefix").alias("_prefix"), F.col("domains").alias("_domains"))
    each = df.select(F.col(path).alias("_path")).distinct()  # rows of df that repeat stay
    on = (F.col("_path") == F.col("_prefix")) | F.col("_path").startswith(F.concat("_prefix", F.lit("/")))
    best = each.join(p, on).groupBy("_path").agg(F.max_by("_domains", F.length("_prefix")).alias("_best"))
    return df.join(best, F.col(path) == F.col("_path"), "left").withColumn("domains", F.coalesce("_best", public())).drop("_path", "_best")


def counts_by_actor(df: DataFrame, actors: DataFrame, policy: str = "domains") -> DataFrame:
    """actor, visible, hidden: rows are first counted by policy, so actors meet policies, not rows."""
    by = df.groupBy(policy).agg(F.count(F.lit(1)).alias("_n"))
    ok = can_access(F.col("_actor_domains"), F.col(policy))
    met = by.join(actors.select("actor", F.col("domains").alias("_actor_domains")), F.lit(True), "inner")
    return met.groupBy("actor").agg(F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0)).alias("visible"), F.coalesce(F.sum(F.when(~ok, F.col("_n"))), F.lit(0)).alias("hidden"))


def redacted(actor: Column, policy: Column, private: Column, shown: Column) -> Column:
    """The private text for those with access, else the public one, which may be null: the row is then dropped."""
    return F.when(can_access(actor, policy), private).otherwise(shown)


def union_domains(policies: Column) -> Column:
    """Sorted union of an array of policies; none means public."""
    u = F.array_sort(F.array_distinct(F.flatten(policies)))
    return F.when(F.size(u) == 0, public()).otherwise(u)


def integration_policy(policies: Column) -> Column:
    """Public only if all inputs are exactly public, else admin."""
    return F.when(F.forall(policies, lambda p: p == public()), public()).otherwise(F.array(F.lit("admin")))


def snapshot_policy(requested: Column, of_change: Column) -> Column:
    """A snapshot that asks for public inherits its change's policy."""
    return F.when(requested == public(), of_change).otherwise(requested)


def allowed_principals(grants: DataFrame, denials: DataFrame) -> DataFrame:
    """principal, capability: granted and not denied; absence denies."""
    return grants.select("principal", "capability").distinct().join(denials.select("principal", "capability"), ["principal", "capability"], "left_anti")


def members(direct: DataFrame) -> DataFrame:
    """group, principal: memberships through nested groups, however deep. direct: group, member."""
    return reach(direct, "group", "member").select("group", F.col("member").alias("principal"))


def present_policies(line: Column, incoming: Column, base: Column) -> Column:
    """The distinct policies of the sides that are there, in this order."""
    return F.array_distinct(F.array_compact(F.array(line, incoming, base)))


#: What a merge preview checks, in order; a refusal tells nothing else.
PREVIEW = ("refused", "no_snapshot", "other_line", "unavailable")


def preview_answer(line_and_change: Column, has_snapshot: Column, same_line: Column, sources: Column, conflicts: Column) -> Column:
    """refused, no_snapshot, other_line or unavailable, by the first check that fails, else clean or conflicts."""
    out = F.when(conflicts == 0, "clean").otherwise("conflicts")
    for name, ok in reversed(list(zip(PREVIEW, (line_and_change, has_snapshot, same_line, sources), strict=True))):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def unless_refused(answer: Column, detail: Column) -> Column:
    """A detail, which a refused request must not see."""
    return F.when(answer != "refused", detail)
