"""Registered queries of the engine itself and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import relations as R
from palimpsest.functions import codecs
from palimpsest.operators import access, checks, diff, graph, manifest, refs
from palimpsest.plans import differing, upsert
from palimpsest.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Relations of the oracle queries, as common table expressions.
POL = "pol(prefix, domain) AS (VALUES ('src1','team/security'),('src1/en','admin'),('src2','customer/acme'))"
ACT = "act(actor, domains) AS (VALUES ('public',['public']),('admin',['admin']),('alice',['public']),('bob',['public','team/security']))"
FILES = "files AS (SELECT source||'/'||lang||'/'||doc_id AS path, sha256(text) AS hash, octet_length(encode(text)) AS bytes, doc_id, source, lang FROM documents)"
MANIFESTS = f"""{FILES},
added AS (SELECT path||'.new' AS path, hash, bytes, doc_id FROM files WHERE doc_id % 29 = 0),
base AS (SELECT path, hash, bytes FROM files),
line AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(hash||'line') ELSE hash END AS hash, bytes FROM files WHERE doc_id % 11 <> 0 AND doc_id % 23 <> 0
  UNION ALL SELECT path, sha256(hash||'new'), bytes FROM added),
incoming AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN sha256(hash||'incoming') ELSE hash END AS hash, bytes FROM files WHERE doc_id % 13 <> 0
  UNION ALL SELECT path, CASE WHEN doc_id % 2 = 0 THEN sha256(hash||'new') ELSE sha256(hash||'new2') END, bytes FROM added)"""
DOMAIN = "coalesce((SELECT arg_max(p.domain, length(p.prefix)) FROM pol p WHERE {0}.path = p.prefix OR starts_with({0}.path, p.prefix||'/')), 'public')"
MERGED = """plan AS (SELECT k.path, b.hash AS b, l.hash AS l, i.hash AS i,
  CASE WHEN l.hash IS NOT DISTINCT FROM i.hash THEN CASE WHEN l.hash IS NULL THEN 'delete' ELSE 'keep_line' END
       WHEN b.hash IS NOT DISTINCT FROM l.hash THEN CASE WHEN i.hash IS NULL THEN 'delete' ELSE 'take_incoming' END
       WHEN b.hash IS NOT DISTINCT FROM i.hash THEN CASE WHEN l.hash IS NULL THEN 'delete' ELSE 'keep_line' END
       ELSE 'conflict' END AS outcome,
  CASE WHEN b.hash IS NULL THEN 'add_add' WHEN l.hash IS NULL OR i.hash IS NULL THEN 'delete_modify' ELSE 'both_modified' END AS kind
  FROM (SELECT path FROM base UNION SELECT path FROM line UNION SELECT path FROM incoming) k
  LEFT JOIN base b USING (path) LEFT JOIN line l USING (path) LEFT JOIN incoming i USING (path))"""
TURNS = """nodes AS (SELECT DISTINCT conv_id, turn, conv_id*100000+turn AS node FROM conversations),
edges AS (SELECT conv_id, node, node-1 AS parent FROM nodes WHERE turn >= 1 UNION ALL SELECT conv_id, node, node-2 FROM nodes WHERE turn >= 2 AND turn % 3 = 2)"""
WALK = f"""RECURSIVE {TURNS}, walk(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT node FROM edges)
  UNION SELECT e.node, w.level+1 FROM walk w JOIN edges e ON e.parent = w.node),
gen AS (SELECT node, CAST(max(level) AS BIGINT) AS generation FROM walk GROUP BY node)"""
REACH = f"RECURSIVE {TURNS}, r(node, ancestor) AS (SELECT node, parent FROM edges UNION SELECT r.node, e.parent FROM r JOIN edges e ON e.node = r.ancestor)"
OPS = """ops AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'integrate_line' WHEN 'signup' THEN 'create_change' WHEN 'error' THEN 'set_policy' ELSE 'snapshot' END AS kind,
  CASE event_type WHEN 'error' THEN 'admin' WHEN 'purchase' THEN 'team/security' ELSE 'public' END AS domain,
  event_type||' by '||user_id AS private_message, CASE event_type WHEN 'purchase' THEN 'an integration' END AS public_message FROM events)"""
TYPED = """objects AS (SELECT 'order:'||o_orderkey AS object, 'order' AS kind FROM orders UNION ALL SELECT 'customer:'||c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'nation:'||n_nationkey, 'nation' FROM nation UNION ALL SELECT 'region:'||r_regionkey, 'region' FROM region)"""
REFLOG = """n AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey AS attempt FROM orders),
o AS (SELECT *, CASE WHEN attempt % 7 = 0 AND seq > 0 THEN 1 ELSE 0 END AS stale FROM n),
log AS (SELECT key, seq, attempt, stale, coalesce(sum(1-stale) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM o)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# Manifests


@query("manifest_scan", f"WITH {FILES} SELECT path, hash, bytes FROM files")
def _(spark, d):
    return R.files(spark, d).select("path", "hash", "bytes")


@query("manifest_scan_pruned", "SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE NOT list_has_any(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), ['.git','target','node_modules'])")
def _(spark, d):
    return R.urls(spark, d).filter(manifest.should_scan(F.col("path"))).select("path")


@query("key_file_names", "SELECT DISTINCT source||'/'||lang AS line, source||'__'||lang AS file FROM documents")
def _(spark, d):
    from palimpsest.sources import key_file

    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("line")).distinct().withColumn("file", key_file(F.col("line")))


@query("blob_dedup", f"WITH {FILES} SELECT hash, count(*) AS n_refs, min(doc_id) AS min_doc_id FROM files GROUP BY hash")
def _(spark, d):
    return manifest.blobs(R.files(spark, d))


@query("blob_new_only", f"WITH {FILES} SELECT DISTINCT hash FROM files WHERE lang <> 'en' AND hash NOT IN (SELECT hash FROM files WHERE lang = 'en')")
def _(spark, d):
    f = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("hash"))
    return manifest.new_blobs(f.filter("lang <> 'en'"), f.filter("lang = 'en'"))


@query("blob_representation", "SELECT CASE WHEN n <= 65536 THEN 'inline' ELSE 'chunked' END AS representation, count(*) AS n, CAST(sum(n) AS BIGINT) AS total_bytes FROM (SELECT octet_length(encode(text)) AS n FROM documents UNION ALL SELECT octet_length(encode(html)) FROM pages) GROUP BY 1")
def _(spark, d):
    sizes = table(spark, d, "documents").select(F.octet_length("text").alias("b")).union(table(spark, d, "pages").select(F.octet_length("html")))
    return sizes.groupBy(manifest.representation(F.col("b")).alias("representation")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("total_bytes"))


@query("manifest_hash_by_source", f"WITH {FILES} SELECT source, count(*) AS n_files, sha256(string_agg(path||'='||hash, chr(10) ORDER BY path||'='||hash)) AS list_hash FROM files GROUP BY source")
def _(spark, d):
    return manifest.list_hashes(R.files(spark, d), "source")


@query("loose_paths", f"WITH {FILES} SELECT DISTINCT hash, 'objects/loose/0/12/'||substr(hash,1,2)||'/'||substr(hash,3)||'.rgl' AS path FROM files")
def _(spark, d):
    return R.files(spark, d).select("hash", F.concat(F.lit("objects/loose/0/12/"), F.substring("hash", 1, 2), F.lit("/"), F.substring("hash", 3, 62), F.lit(".rgl")).alias("path")).distinct()


# Policies and access


@query("path_policy_longest_prefix", f"WITH {POL}, {FILES} SELECT path, {DOMAIN.format('f')} AS domain FROM files f")
def _(spark, d):
    return access.with_policy_theta(R.files(spark, d).select("path"), R.policies(spark)).select("path", F.col("domains")[0].alias("domain"))


@query("path_policy_exploded", f"WITH {POL}, {FILES} SELECT path, {DOMAIN.format('f')} AS domain FROM files f")
def _(spark, d):
    return R.secured(spark, R.files(spark, d)).select("path", F.col("domains")[0].alias("domain"))


@query("policy_replace_by_prefix", "SELECT * FROM (VALUES ('src1','admin,team/red'),('src1/en','admin'),('src2','customer/acme'),('src9/de','public')) t(prefix, domains)")
def _(spark, d):
    new = spark.createDataFrame([(" ./src1", [" team/red", "admin", "", "admin"]), ("src9\\de", [" "])], "prefix string, domains array<string>")
    new = new.select(manifest.normalized_path(F.col("prefix")).alias("prefix"), manifest.normalized_domains(F.col("domains")).alias("domains"))
    return upsert(R.policies(spark), new, ["prefix"]).select("prefix", F.array_join("domains", ",").alias("domains"))


@query("actor_visible_files", f"WITH {POL}, {ACT}, {FILES}, s AS (SELECT {DOMAIN.format('f')} AS domain FROM files f) SELECT actor, count(*) FILTER (WHERE list_contains(domains,'admin') OR list_contains(domains,domain)) AS visible, count(*) FILTER (WHERE NOT (list_contains(domains,'admin') OR list_contains(domains,domain))) AS hidden FROM s, act GROUP BY actor")
def _(spark, d):
    return access.counts_by_actor(R.secured(spark, R.files(spark, d)), R.actors(spark))


@query("actor_row_filter", f"WITH {POL}, {FILES}, s AS (SELECT path, {DOMAIN.format('f')} AS domain FROM files f) SELECT 'bob' AS actor, path FROM s WHERE domain IN ('public','team/security')")
def _(spark, d):
    return access.visible(R.secured(spark, R.files(spark, d)), R.domains_of("bob")).select(F.lit("bob").alias("actor"), "path")


@query("line_view_redacted", "SELECT o_orderstatus AS line, CASE WHEN o_orderstatus = 'P' THEN 'restricted' ELSE 'snapshot-'||max(o_orderkey) END AS snapshot_label, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS visible, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS hidden FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("domains", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("admin"))).otherwise(F.array(F.lit("public"))))
    ok = access.can_access(R.domains_of("alice"), F.col("domains"))
    head = F.when(access.can_access(R.domains_of("alice"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("admin"))).otherwise(access.public())), F.concat(F.lit("snapshot-"), F.col("head").cast("string"))).otherwise("restricted")
    return o.groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("head"), F.count_if(ok).alias("visible"), F.count_if(~ok).alias("hidden")).select(F.col("o_orderstatus").alias("line"), head.alias("snapshot_label"), "visible", "hidden")


@query("policy_union", f"WITH {POL}, {FILES}, s AS (SELECT source, {DOMAIN.format('f')} AS domain FROM files f) SELECT source, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM s GROUP BY source")
def _(spark, d):
    by = R.secured(spark, R.files(spark, d)).groupBy("source").agg(F.collect_set("domains").alias("all"))
    return by.select("source", F.array_join(access.union_domains(F.col("all")), ",").alias("domains"))


@query("integration_policy", "SELECT o_orderkey AS key, CASE WHEN o_orderstatus <> 'P' AND c_mktsegment <> 'BUILDING' THEN 'public' ELSE 'admin' END AS policy FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    p = lambda secret: F.when(secret, F.array(F.lit("team/security"))).otherwise(access.public())
    both = o.join(c, o["o_custkey"] == c["c_custkey"])
    five = F.array(p(F.col("o_orderstatus") == "P"), p(F.col("c_mktsegment") == "BUILDING"), access.public(), access.public(), access.public())
    return both.select(F.col("o_orderkey").alias("key"), access.integration_policy(five)[0].alias("policy"))


@query("merge_sources_allowed", f"WITH {POL}, {ACT}, {MANIFESTS}, a AS (SELECT path FROM base UNION SELECT path FROM line UNION SELECT path FROM incoming), s AS (SELECT DISTINCT {DOMAIN.format('a')} AS domain FROM a) SELECT actor, bool_and(list_contains(domains,'admin') OR list_contains(domains,domain)) AS allowed FROM act, s GROUP BY actor")
def _(spark, d):
    b, l, i = R.three_manifests(spark, d)  # noqa: E741
    seen = R.secured(spark, b.union(l).union(i).select("path")).select("domains").distinct()
    met = seen.join(R.actors(spark).select("actor", F.col("domains").alias("mine")), F.lit(True), "inner")
    return met.groupBy("actor").agg(F.bool_and(access.can_access(F.col("mine"), F.col("domains"))).alias("allowed"))


@query("conflict_access_all", f"WITH {POL}, {ACT}, {MANIFESTS}, {MERGED}, s AS (SELECT path, {DOMAIN.format('plan')} AS domain FROM plan WHERE outcome = 'conflict') SELECT actor, path, list_contains(domains,'admin') OR (list_contains(domains,domain) AND list_contains(domains,'public')) AS allowed FROM s, act")
def _(spark, d):
    plan = diff.merge(*R.three_manifests(spark, d)).filter("outcome = 'conflict'")
    sides = R.secured(spark, plan.select("path")).withColumn("sides", F.array(F.col("domains"), access.public()))
    # Actors meet the distinct policies, and these their conflicts.
    met = sides.select("sides").distinct().join(R.actors(spark).select("actor", F.col("domains").alias("mine")), F.lit(True), "inner")
    ruled = met.select("actor", "sides", access.can_access_all(F.col("mine"), F.col("sides")).alias("allowed"))
    return sides.select("path", "sides").join(ruled, "sides").select("actor", "path", "allowed")


@query("policy_evaluation", "WITH g AS (SELECT DISTINCT user_id AS principal, event_type AS capability FROM events WHERE value >= 0), x AS (SELECT DISTINCT user_id AS principal, event_type AS capability FROM events WHERE event_id % 97 = 0) SELECT principal, capability FROM g EXCEPT SELECT principal, capability FROM x")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("principal"), F.col("event_type").alias("capability"), "value", "event_id")
    return access.allowed_principals(e.filter("value >= 0"), e.filter("event_id % 97 = 0"))


@query("group_members", "SELECT 'region:'||n_regionkey AS \"group\", 'nation:'||n_nationkey AS principal FROM nation UNION ALL SELECT 'nation:'||s_nationkey, 'supplier:'||s_suppkey FROM supplier UNION ALL SELECT 'region:'||n_regionkey, 'supplier:'||s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    n = table(spark, d, "nation").select(name("region", "n_regionkey").alias("group"), name("nation", "n_nationkey").alias("member"))
    s = table(spark, d, "supplier").select(name("nation", "s_nationkey").alias("group"), name("supplier", "s_suppkey").alias("member"))
    return access.members(n.unionByName(s))


@query("redaction_modes", f"WITH {OPS} SELECT event_id, CASE WHEN domain = 'admin' THEN NULL WHEN domain = 'team/security' THEN sha256(private_message) ELSE private_message END AS shown FROM ops WHERE domain <> 'admin'")
def _(spark, d):
    ops = R.operations(spark, d)
    mode = F.when(F.array_contains("domains", "admin"), "omit").when(F.array_contains("domains", "team/security"), "hash").otherwise("show")
    shown = F.when(F.col("mode") == "hash", F.sha2("private_message", 256)).otherwise(F.col("private_message"))
    return ops.withColumn("mode", mode).filter("mode <> 'omit'").select("event_id", shown.alias("shown"))


# Diffs


@query("diff_plain", f"WITH {MANIFESTS} SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN l.hash IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM base b FULL JOIN line l USING (path) WHERE b.hash IS DISTINCT FROM l.hash")
def _(spark, d):
    b, l, _i = R.three_manifests(spark, d)  # noqa: E741
    return diff.diff(b, l)


def _permissioned(actor_sql: str) -> str:
    return f"""WITH {POL}, {MANIFESTS}, x AS (SELECT path, hash, {DOMAIN.format("base")} AS domain FROM base), y AS (SELECT path, hash, {DOMAIN.format("line")} AS domain FROM line),
xv AS (SELECT * FROM x WHERE domain IN ({actor_sql})), yv AS (SELECT * FROM y WHERE domain IN ({actor_sql})), xh AS (SELECT * FROM x WHERE domain NOT IN ({actor_sql})), yh AS (SELECT * FROM y WHERE domain NOT IN ({actor_sql}))"""


@query("diff_permissioned", _permissioned("'public','team/security'") + " SELECT CASE WHEN xv.hash IS NULL THEN 'added' WHEN yv.hash IS NULL THEN 'deleted' ELSE 'modified' END AS status, path FROM xv FULL JOIN yv USING (path) WHERE xv.hash IS DISTINCT FROM yv.hash UNION ALL SELECT 'hidden', CAST(count(*) AS VARCHAR) FROM xh FULL JOIN yh USING (path) WHERE xh.hash IS DISTINCT FROM yh.hash")
def _(spark, d):
    b, l, _i = (R.secured(spark, x) for x in R.three_manifests(spark, d))  # noqa: E741
    return diff.permissioned_diff(b, l, R.domains_of("bob"))


@query("diff_hidden_count", _permissioned("'public'") + " SELECT 'alice' AS actor, count(*) AS hidden FROM xh FULL JOIN yh USING (path) WHERE xh.hash IS DISTINCT FROM yh.hash")
def _(spark, d):
    b, l, _i = (R.secured(spark, x) for x in R.three_manifests(spark, d))  # noqa: E741
    return diff.hidden_changes(b, l, R.domains_of("alice")).select(F.lit("alice").alias("actor"), "hidden")


@query("diff_whole_entry", f"WITH {MANIFESTS}, y AS (SELECT path, hash, CASE WHEN length(path) % 5 = 0 THEN bytes + 1 ELSE bytes END AS bytes FROM line) SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN y.hash IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM base b FULL JOIN y USING (path) WHERE b.hash IS DISTINCT FROM y.hash OR b.bytes IS DISTINCT FROM y.bytes")
def _(spark, d):
    b, l, _i = R.three_manifests(spark, d)  # noqa: E741
    l = l.withColumn("bytes", F.when(F.length("path") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))  # noqa: E741
    return diff.diff(b, l, same=["hash", "bytes"])


@query("diff_opaque", f"WITH {MANIFESTS} SELECT count(*) AS opaque_changed FROM base b FULL JOIN incoming i USING (path) WHERE b.hash IS DISTINCT FROM i.hash OR b.bytes IS DISTINCT FROM i.bytes")
def _(spark, d):
    b, _l, i = R.three_manifests(spark, d)
    return diff.opaque_changes(b, i, "key")


@query("diff_clean", f"WITH {MANIFESTS} SELECT NOT EXISTS (SELECT 1 FROM base b FULL JOIN line l USING (path) WHERE b.hash IS DISTINCT FROM l.hash) AS clean")
def _(spark, d):
    b, l, _i = R.three_manifests(spark, d)  # noqa: E741
    return diff.diff(b, l).agg((F.count(F.lit(1)) == 0).alias("clean"))


@query("duplicate_paths", "SELECT source||'/'||lang AS path, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return diff.duplicates(table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path")))


# Merges


@query("merge_plan_rows", f"WITH {MANIFESTS}, {MERGED} SELECT path, CASE outcome WHEN 'keep_line' THEN l ELSE i END AS hash, CASE outcome WHEN 'keep_line' THEN 'line' ELSE 'incoming' END AS origin FROM plan WHERE outcome IN ('keep_line','take_incoming')")
def _(spark, d):
    return diff.merged_rows(diff.merge(*R.three_manifests(spark, d)))


@query("merge_conflicts", f"WITH {MANIFESTS}, {MERGED} SELECT path, kind FROM plan WHERE outcome = 'conflict'")
def _(spark, d):
    return diff.merge(*R.three_manifests(spark, d)).filter("outcome = 'conflict'").select("path", "kind")


@query("merge_outcome_counts", f"WITH {MANIFESTS}, {MERGED} SELECT outcome, count(*) AS n FROM plan GROUP BY outcome")
def _(spark, d):
    return diff.merge(*R.three_manifests(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("merge_whole_entry", f"WITH {MANIFESTS.replace('incoming AS (', 'incoming0 AS (')}, incoming AS (SELECT path, hash||'|'||CASE WHEN length(path) % 4 = 0 THEN bytes + 1 ELSE bytes END AS hash FROM incoming0), base1 AS (SELECT path, hash||'|'||bytes AS hash FROM base), line1 AS (SELECT path, hash||'|'||bytes AS hash FROM line), {MERGED.replace('FROM base', 'FROM base1').replace('JOIN base', 'JOIN base1').replace('FROM line', 'FROM line1').replace('JOIN line', 'JOIN line1')} SELECT path, outcome FROM plan")
def _(spark, d):
    b, l, i = R.three_manifests(spark, d)  # noqa: E741
    i = i.withColumn("bytes", F.when(F.length("path") % 4 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return diff.merge(b, l, i, same=["hash", "bytes"]).select("path", "outcome")


@query("merge_symmetry", "SELECT CAST(0 AS BIGINT) AS violations")
def _(spark, d):
    b, l, i = R.three_manifests(spark, d)  # noqa: E741
    one, two = diff.merge(b, l, i), diff.merge(b, i, l)
    kept = lambda p: diff.merged_rows(p).select("path", "hash").union(p.filter("outcome = 'conflict'").select("path", "kind"))
    return kept(one).exceptAll(kept(two)).union(kept(two).exceptAll(kept(one))).agg(F.count(F.lit(1)).alias("violations"))


@query("conflict_upsert", f"WITH {MANIFESTS}, {MERGED}, c AS (SELECT path FROM plan WHERE outcome = 'conflict'), s AS (SELECT path FROM c WHERE length(path) % 2 = 0 UNION ALL SELECT path||'.old' FROM c WHERE length(path) % 5 = 0) SELECT path, CASE WHEN s.p IS NULL THEN 'insert' WHEN c.p IS NULL THEN 'keep' ELSE 'refresh' END AS action FROM (SELECT path, 1 AS p FROM c) c FULL JOIN (SELECT path, 1 AS p FROM s) s USING (path)")
def _(spark, d):
    found = diff.merge(*R.three_manifests(spark, d)).filter("outcome = 'conflict'").select("path", F.lit(None).cast("string").alias("base_snapshot"))
    stored = found.filter(F.length("path") % 2 == 0).union(found.filter(F.length("path") % 5 == 0).select(F.concat("path", F.lit(".old")), "base_snapshot")).withColumn("status", F.lit("unresolved"))
    return diff.upsert_conflicts(stored, found, ["path", "base_snapshot"]).select("path", "action")


@query("merge_integration_summary", f"WITH {MANIFESTS}, {MERGED} SELECT count(*) FILTER (WHERE outcome IN ('keep_line','take_incoming')) AS merged_files, count(*) FILTER (WHERE outcome = 'conflict') AS conflicts, count(*) FILTER (WHERE outcome = 'conflict') = 0 AS integrates FROM plan")
def _(spark, d):
    p = diff.merge(*R.three_manifests(spark, d))
    bad = F.count_if(F.col("outcome") == "conflict")
    return p.agg(F.count_if(F.col("outcome").isin("keep_line", "take_incoming")).alias("merged_files"), bad.alias("conflicts"), (bad == 0).alias("integrates"))


# Operation log


@query("op_log_redacted", f"WITH {OPS} SELECT event_id, CASE WHEN domain = 'public' THEN private_message ELSE public_message END AS message FROM ops WHERE domain = 'public' OR public_message IS NOT NULL")
def _(spark, d):
    ops = R.operations(spark, d)
    return ops.select("event_id", access.redacted(R.domains_of("alice"), F.col("domains"), F.col("private_message"), F.col("public_message")).alias("message")).filter("message is not null")


@query("line_history", f"WITH {OPS} SELECT event_id, 'integrated '||c_name||' at '||event_id AS message FROM ops JOIN customer ON user_id = c_custkey WHERE kind = 'integrate_line'")
def _(spark, d):
    ops = R.operations(spark, d).filter("kind = 'integrate_line'")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return ops.join(c, F.col("user_id") == F.col("c_custkey")).select("event_id", F.concat(F.lit("integrated "), F.col("c_name"), F.lit(" at "), F.col("event_id").cast("string")).alias("message"))


@query("op_kind_counts", f"WITH {OPS} SELECT kind, count(*) AS n FROM ops GROUP BY kind")
def _(spark, d):
    return R.operations(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("change_listing", "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN '*' ELSE '' END AS marker, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, o_custkey) AS snapshot FROM orders WHERE o_orderpriority <> '1-URGENT'")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey").eqNullSafe(F.lit(7)), "*").otherwise("").alias("marker"), F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.col("o_custkey")).alias("snapshot"))


@query("snapshot_policy_default", f"WITH {OPS} SELECT event_id, CASE WHEN domain = 'public' THEN CASE WHEN user_id % 3 = 0 THEN 'admin' ELSE 'public' END ELSE domain END AS domain FROM ops")
def _(spark, d):
    of_change = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("admin"))).otherwise(access.public())
    return R.operations(spark, d).select("event_id", access.snapshot_policy(F.col("domains"), of_change)[0].alias("domain"))


# Graphs


@query("dag_generation", f"WITH {WALK} SELECT node, generation FROM gen")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    return graph.generations(nodes, edges)


@query("dag_topological", f"WITH {WALK} SELECT node, CAST(row_number() OVER (ORDER BY generation, node) - 1 AS BIGINT) AS position FROM gen")
def _(spark, d):
    return graph.topological(*R.turns(spark, d))


@query("dag_ancestors", f"WITH {REACH} SELECT DISTINCT node, ancestor FROM r")
def _(spark, d):
    return graph.reach(R.turns(spark, d)[1]).select("node", F.col("parent").alias("ancestor"))


@query("dag_reachable_pairs", f"WITH {REACH} SELECT ancestor, node AS descendant FROM r UNION SELECT node, node FROM nodes")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    return graph.reach(edges).select(F.col("parent").alias("ancestor"), F.col("node").alias("descendant")).union(nodes.select("node", "node")).distinct()


@query("dag_cycle_members", "SELECT * FROM (VALUES ('a'),('b'),('self')) t(node)")
def _(spark, d):
    return graph.cycle_members(spark.createDataFrame([("a", "b"), ("b", "a"), ("child", "a"), ("grand", "child"), ("self", "self"), ("free", "root")], "node string, parent string"))


@query("dag_missing_parent", f"WITH {TURNS}, kept AS (SELECT node FROM nodes WHERE node % 5 <> 0) SELECT DISTINCT node, parent FROM edges WHERE node IN (SELECT node FROM kept) AND parent NOT IN (SELECT node FROM kept)")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    kept = nodes.filter("node % 5 <> 0").select("node")
    return graph.missing_parents(kept, edges.join(kept, "node", "left_semi"))


@query("parent_positions", "SELECT l_orderkey AS source, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS position, l_partkey AS target FROM lineitem")
def _(spark, d):
    return graph.parent_positions(table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "o", "l_partkey")


@query("typed_closure", "SELECT 'order:'||o_orderkey AS root, x.object, x.kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey, LATERAL (VALUES ('order:'||o_orderkey,'order'),('customer:'||c_custkey,'customer'),('nation:'||n_nationkey,'nation'),('region:'||n_regionkey,'region')) x(object, kind)")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    roots = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    return graph.closure(roots, edges).join(objects, "object").select("root", "object", "kind")


@query("closure_status", "SELECT 'order:'||o_orderkey AS root, CASE WHEN o_custkey % 11 = 0 THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'quarantined' WHEN o_custkey % 5 = 0 THEN 'promised' WHEN o_custkey % 3 = 0 THEN 'wrong_kind' ELSE 'ok' END AS status FROM orders")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    key = F.substring_index("object", ":", -1).cast("long")
    presence = F.when(key % 7 == 0, 3).when(key % 5 == 0, 2).otherwise(1)
    objects = objects.filter("kind = 'customer'").filter(key % 11 != 0).withColumn("presence", presence).withColumn("kind", F.when(key % 3 == 0, "supplier").otherwise(F.col("kind")))
    return graph.edge_status(edges.filter("expected_kind = 'customer'"), objects).select(F.col("source").alias("root"), "status")


@query("promised_targets", "SELECT DISTINCT l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("target")).distinct().join(table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("target")), "target", "left_anti")


@query("presence_precedence", "SELECT user_id AS object, CASE WHEN bool_or(event_type='error' AND value > 90) THEN 'quarantined' WHEN bool_or(event_type='purchase') THEN 'present' WHEN bool_or(event_type='view') THEN 'promised' ELSE 'unknown' END AS presence FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("q"), F.bool_or(F.col("event_type") == "purchase").alias("p"), F.bool_or(F.col("event_type") == "view").alias("m"))
    return e.select(F.col("user_id").alias("object"), refs.presence(F.col("q"), F.col("p"), F.col("m")).alias("presence"))


@query("gc_dead_objects", "SELECT 'customer:'||c_custkey AS object FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'order:'||o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'nation:'||n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P') UNION ALL SELECT 'region:'||r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P')")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    roots = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    return graph.dead(objects, roots, edges)


@query("projection_rules", f"WITH {FILES} SELECT path, CASE WHEN source = 'src1' AND lang = 'en' THEN 'redact' WHEN source = 'src1' THEN 'include' WHEN source = 'src2' THEN 'exclude' ELSE 'exclude' END AS rule FROM files")
def _(spark, d):
    rules = spark.createDataFrame([("src1", ["include"]), ("src1/en", ["redact"]), ("src2", ["exclude"])], "prefix string, domains array<string>")
    rule = F.when(F.col("domains") == access.public(), "exclude").otherwise(F.col("domains")[0])  # no rule: closed
    return access.with_policy(R.files(spark, d).select("path"), rules).select("path", rule.alias("rule"))


# References


@query("ref_current_state", "SELECT o_custkey AS key, count(*) - 1 AS generation, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS target FROM orders GROUP BY o_custkey")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("generation"), F.col("o_orderkey").alias("target"))
    return refs.current(log)


@query("cas_outcomes", f"WITH {REFLOG} SELECT attempt, CASE WHEN stale = 0 THEN 'accepted' ELSE 'conflict' END AS outcome FROM log")
def _(spark, d):
    return refs.cas_outcomes(R.reference_log(spark, d))


@query("line_predecessor_check", "SELECT count(*) AS violations FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 2)) WHERE turn <> coalesce(before + 1, 0)")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct().filter("turn <> 2")
    log = c.select("conv_id", "turn", F.col("turn").alias("target"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("previous"))
    return refs.broken_chain(log, "conv_id", "turn", "previous", "target").agg(F.count(F.lit(1)).alias("violations"))


@query("action_matching", "WITH u AS (SELECT l_partkey AS k, l_orderkey*10+l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey*10+l_linenumber) AS r FROM lineitem WHERE l_linenumber = 1), a AS (SELECT l_partkey AS k, l_orderkey*10+l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey*10+l_linenumber) AS r FROM lineitem WHERE l_linenumber = 2) SELECT u.id AS \"update\", a.id AS action, r AS rank FROM (SELECT k, r, min(id) AS id FROM u GROUP BY k, r) u FULL JOIN (SELECT k, r, min(id) AS id FROM a GROUP BY k, r) a USING (k, r)")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return refs.matched(li.filter("l_linenumber = 1"), li.filter("l_linenumber = 2"), ["k"], "id", "id")


@query("operation_heads", "SELECT user_id AS operation, count(*) - 1 AS generation FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("operation")).agg((F.count(F.lit(1)) - 1).alias("generation"))


# Checks


@query("derived_index_verify", f"WITH {TURNS} SELECT (SELECT count(*) FROM nodes WHERE node % 50 = 3) AS missing, CAST(0 AS BIGINT) AS extra")
def _(spark, d):
    nodes, _ = R.turns(spark, d)
    index = nodes.select("node", "turn")
    return differing(index, index.filter("node % 50 <> 3"))


@query("edge_integrity", "SELECT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def _(spark, d):
    return checks.dangling(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("object")), "l_orderkey", "l_partkey")


@query("version_chain_check", "SELECT count(*) FILTER (WHERE (turn = 0) <> (CASE WHEN turn % 4 = 3 THEN NULL WHEN turn > 0 THEN turn - 1 END IS NULL)) AS violations FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("previous", F.when(F.col("turn") % 4 == 3, None).when(F.col("turn") > 0, F.col("turn") - 1))
    return c.agg(F.count_if(~checks.version_chain(F.col("turn"), F.col("previous"))).alias("violations"))


@query("sorted_unique_check", "SELECT source, list_sort(list_distinct(l)) = l AS ok FROM (SELECT source, list(lang ORDER BY doc_id) AS l FROM documents GROUP BY source)")
def _(spark, d):
    return checks.unsorted_groups(table(spark, d, "documents"), "source", "doc_id", "lang")


@query("one_to_one_mapping", "SELECT 'right' AS side, CAST(n_regionkey AS VARCHAR) AS value FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_nationkey) > 1")
def _(spark, d):
    return checks.not_one_to_one(table(spark, d, "nation"), "n_nationkey", "n_regionkey")


@query("region_overlap_check", "SELECT count(*) AS violations FROM (SELECT s, e, lead(s) OVER (PARTITION BY k ORDER BY s, e) AS n FROM (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_linenumber AS e FROM lineitem)) WHERE s >= e OR n < e")
def _(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("e"))
    return checks.overlapping(r, "k", "s", "e").agg(F.count(F.lit(1)).alias("violations"))


@query("collision_check", f"WITH {FILES} SELECT hash FROM files GROUP BY hash HAVING count(DISTINCT bytes) > 1")
def _(spark, d):
    return R.files(spark, d).groupBy("hash").agg(F.count_distinct("bytes").alias("n")).filter("n > 1").select("hash")


@query("ledger_gaps", "SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 1)) WHERE turn <> coalesce(b + 1, 0)")
def _(spark, d):
    return checks.gaps(table(spark, d, "conversations").select("conv_id", "turn").distinct().filter("turn <> 1"), "turn", "conv_id")


@query("field_sets", "SELECT event_id AS object, CASE WHEN event_type = 'view' THEN 'value' ELSE 'extra' END AS field, CASE WHEN event_type = 'view' THEN 'missing' ELSE 'unknown' END AS problem FROM events WHERE event_type IN ('view','error')")
def _(spark, d):
    rules = spark.createDataFrame([(k, f, f != "note") for k in ("click", "error", "purchase", "signup", "view") for f in ("id", "value", "note")], "kind string, field string, required boolean")
    fields = F.when(F.col("event_type") == "view", F.array(F.lit("id"))).when(F.col("event_type") == "error", F.array(F.lit("id"), F.lit("value"), F.lit("extra"))).otherwise(F.array(F.lit("id"), F.lit("value")))
    return checks.field_problems(table(spark, d, "events").select(F.col("event_id").alias("object"), F.col("event_type").alias("kind"), fields.alias("fields")), rules)


@query("presence_matrix", "SELECT count(*) AS violations FROM events WHERE event_type = 'view' AND value > 50")
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", 2).otherwise(1).alias("p"), F.col("event_type").alias("k"), F.when((F.col("event_type") != "view") | (F.col("value") > 50), 1).alias("n"))
    return e.agg(F.count_if(~checks.presence_row(F.col("p"), F.col("k"), F.col("n"))).alias("violations"))


@query("incident_rule", "SELECT bool_or(event_type = 'error' AND value > 50) = true AS ok FROM events")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("open"), (F.col("value") > 50).alias("fail_closed"))
    return checks.incident_rule(e, F.lit(True))


# Paths and identities


@query("path_normalize", "SELECT replace(regexp_replace(trim('./'||'./'||regexp_replace(url,'^[a-z]+://','')||' '), '^(\\./)+', ''), chr(92), '/') AS url_path FROM pages")
def _(spark, d):
    return R.urls(spark, d).select(manifest.normalized_path(F.concat(F.lit("././"), F.col("path"), F.lit(" "))).alias("url_path"))


@query("path_validate", "SELECT path, CASE WHEN n % 4 = 1 THEN 'reserved' WHEN n % 4 = 2 THEN 'unsafe' WHEN n % 4 = 3 THEN 'not_portable' END AS reason FROM (SELECT n, CASE n % 4 WHEN 0 THEN p WHEN 1 THEN p||'/con.txt' WHEN 2 THEN p||'/../x' ELSE p||'/a|b' END AS path FROM (SELECT page_id AS n, 'p/'||page_id AS p FROM pages))")
def _(spark, d):
    n, p = F.col("page_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string"))
    path = F.when(n % 4 == 0, p).when(n % 4 == 1, F.concat(p, F.lit("/con.txt"))).when(n % 4 == 2, F.concat(p, F.lit("/../x"))).otherwise(F.concat(p, F.lit("/a|b")))
    return table(spark, d, "pages").select(path.alias("path")).withColumn("reason", manifest.path_problem(F.col("path")))


@query("path_collision", f"WITH {FILES}, p AS (SELECT path FROM files UNION ALL SELECT upper(source)||'/'||lang||'/'||doc_id FROM files WHERE doc_id % 10 = 0), a AS (SELECT DISTINCT string_split(path,'/')[1] AS x FROM p UNION SELECT DISTINCT string_split(path,'/')[1]||'/'||string_split(path,'/')[2] FROM p UNION SELECT path FROM p) SELECT min(x) AS first_path, max(x) AS second_path FROM a GROUP BY lower(x) HAVING min(x) <> max(x)")
def _(spark, d):
    f = R.files(spark, d)
    up = f.filter("doc_id % 10 = 0").select(F.concat(F.upper("source"), F.substring(F.col("path"), F.length("source") + 1, F.length("path"))).alias("path"))
    return manifest.collisions(f.select("path").union(up)).select("first_path", "second_path")


@query("object_id_sha256", "SELECT doc_id, sha256('OBJECT'||chr(9)||chr(2)||chr(0)||text) AS digest_hex FROM documents WHERE doc_id < 0 UNION ALL SELECT doc_id, sha256(encode('OBJECT') || '\\x00\\x02\\x00'::BLOB || encode(text)) FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", codecs.object_digest(F.lit(b"OBJECT\0"), 2, 0, F.encode("text", "UTF-8")).alias("digest_hex"))


# Without SQL: codecs and exact order


@query("fastcdc_chunks")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    return codecs.chunked(docs)


@query("cbor_roundtrip")
def _(spark, d):
    return codecs.cbor_round_trip(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id", "props"))


@query("object_id_text")
def _(spark, d):
    return codecs.object_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest")), prefix="id0_")


@query("topological_exact")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    return graph.topological_exact(nodes, edges, "conv_id")


@query("case_fold_full")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", codecs.case_folded(F.col("text")).alias("folded"))
