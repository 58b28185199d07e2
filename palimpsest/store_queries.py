"""Registered queries of publication, the object store, ordered outputs and checked inputs, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import relations as R
from palimpsest.functions import codecs
from palimpsest.operators import access, checks, diff, graph, manifest, order, publish, store
from palimpsest.plans import differing
from palimpsest.registry import ACT, DOMAIN, FILES, MANIFESTS, MERGED, OPS, POL, TURNS, TYPED, WALK
from palimpsest.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def name_of(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


# Compare-and-swap and publication

_ATTEMPTS = """a AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey AS attempt FROM orders),
n AS (SELECT key, seq, attempt, CASE WHEN attempt % 5 = 0 THEN NULL ELSE (seq * 2) // 3 - attempt % 2 END AS expected FROM a)"""


def _attempts(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("o_orderkey").alias("attempt"))
    return a.withColumn("expected", F.when(F.col("attempt") % 5 != 0, F.floor(F.col("seq") * 2 / 3) - F.col("attempt") % 2))


@query("cas_fold", f"""WITH RECURSIVE {_ATTEMPTS}, f(key, seq, attempt, won, gen) AS (
  SELECT key, seq, attempt, expected IS NULL, CASE WHEN expected IS NULL THEN 0 END FROM n WHERE seq = 0
  UNION ALL SELECT n.key, n.seq, n.attempt, n.expected IS NOT DISTINCT FROM f.gen, CASE WHEN n.expected IS NOT DISTINCT FROM f.gen THEN coalesce(f.gen + 1, 0) ELSE f.gen END FROM f JOIN n ON n.key = f.key AND n.seq = f.seq + 1)
SELECT attempt, CASE WHEN won THEN 'accepted' ELSE 'conflict' END AS outcome, CAST(gen AS BIGINT) AS generation FROM f""")  # fmt: skip
def _(spark, d):
    """Early, stale and repeated attempts."""
    return publish.fold(_attempts(spark, d))


_UPDATES = """u AS (SELECT o_custkey AS batch, o_custkey * 10 + o_orderkey % 7 AS key, CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN (o_custkey * 10 + o_orderkey % 7) % 3 END AS expected,
  o_orderkey AS target, o_orderkey % 23 = 0 AS unknown, o_orderkey % 29 = 0 AS other_kind, o_orderkey % 31 = 0 AS other_id, o_orderkey % 37 AS act, o_orderkey % 41 = 0 AS broken FROM orders),
r AS (SELECT *, CASE WHEN batch % 43 = 0 THEN 'operation_unknown' WHEN batch % 47 = 0 THEN 'operation_kind' WHEN count(*) OVER (PARTITION BY batch, key) > 1 THEN 'duplicate_key'
  WHEN expected IS DISTINCT FROM CASE WHEN batch % 2 = 0 THEN key % 3 END THEN 'expected' WHEN unknown THEN 'target_unknown' WHEN other_kind THEN 'target_kind' WHEN other_id THEN 'identity'
  WHEN act < 2 THEN 'action' WHEN broken THEN 'closure' END AS reason FROM u)"""


def _checked(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    key = F.col("o_custkey") * 10 + n % 7
    operation = name_of("operation", "o_custkey")
    target = name_of("line", "o_orderkey")
    u = o.select(F.col("o_custkey").alias("batch"), key.alias("key"), F.lit("line_state").alias("kind"), F.when(n % 19 == 0, None).when(F.col("o_custkey") % 2 == 0, key % 3).alias("expected"), target.alias("target"), operation.alias("operation"))
    states = o.filter("o_custkey % 2 = 0").select(key.alias("key"), (key % 3).cast("long").alias("generation")).distinct()
    lines = o.filter(n % 23 != 0).select(target.alias("object"), F.when(n % 29 == 0, "blob").otherwise("line_state").alias("kind"), F.when(n % 31 != 0, key).alias("identity"))
    ops = table(spark, d, "customer").filter("c_custkey % 43 <> 0").select(name_of("operation", "c_custkey").alias("object"), F.when(F.col("c_custkey") % 47 == 0, "blob").otherwise("operation").alias("kind"), F.lit(None).cast("long").alias("identity"))
    actions = o.filter(n % 37 != 0).select(operation.alias("operation"), key.alias("key"), target.alias("target"))
    actions = actions.union(o.filter(n % 37 == 1).select(operation, key, target))
    return publish.staged(u, states, lines.unionByName(ops), actions, o.filter(n % 41 == 0).select(target.alias("object"))), states


@query("publish_outcomes", f"WITH {_UPDATES} SELECT batch, key, 'line:'||target AS target, reason FROM r")
def _(spark, d):
    return _checked(spark, d)[0]


@query("published_batches", f"""WITH {_UPDATES}, w AS (SELECT *, list_position(['operation_unknown','operation_kind','duplicate_key','expected','target_unknown','target_kind','identity','action','closure'], reason) AS p FROM r)
SELECT batch, key, arg_min(reason, p) OVER (PARTITION BY batch) AS reason, CASE WHEN min(p) OVER (PARTITION BY batch) IS NULL THEN CAST(CASE WHEN batch % 2 = 0 THEN key % 3 + 1 ELSE 0 END AS BIGINT) END AS generation FROM w""")  # fmt: skip
def _(spark, d):
    checked, states = _checked(spark, d)
    return publish.published(checked, states)


def _operations(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    acts = F.transform("l", lambda x: F.struct((x["l_linenumber"] % 3).cast("int").alias("kind"), x["l_partkey"].alias("key"), x["l_suppkey"].alias("target")))
    return li.select(F.col("l_orderkey").alias("operation"), acts.alias("actions"))


@query("bound_transitions", "SELECT l_orderkey AS operation, CAST(p AS BIGINT) AS position, l_partkey AS key, l_suppkey AS target FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS p FROM lineitem) WHERE l_linenumber % 3 = 2")
def _(spark, d):
    return publish.transitions(_operations(spark, d))


@query("declared_once", "SELECT o_orderkey AS operation, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey HAVING count(l_orderkey) <> 1")
def _(spark, d):
    declared = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("operation"))
    return publish.exactly_one(declared, table(spark, d, "orders").select(F.col("o_orderkey").alias("operation")), ["operation"])


@query("action_fields", "SELECT l_orderkey AS operation, l_linenumber AS line, CAST(CASE l_linenumber WHEN 5 THEN 7 ELSE l_linenumber + 2 + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END - CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END END AS INTEGER) AS field FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("operation"), F.col("l_linenumber").alias("line"), publish.field_of(F.col("l_linenumber").cast("int")).alias("field"))


@query("revision_lock", "SELECT o_orderkey AS \"commit\", CASE WHEN o_orderkey % 6 = 0 THEN s - 1 ELSE s END = s AS ok FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS s FROM orders)")
def _(spark, d):
    from pyspark.sql import Window

    s = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("store"), s.alias("seq"), F.col("o_orderkey").alias("commit"))
    return publish.stale_revisions(c.withColumn("read", F.when(F.col("commit") % 6 == 0, F.col("seq") - 1).otherwise(F.col("seq"))))


@query("unique_action_keys", "SELECT l_orderkey AS operation, l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("operation"), F.col("l_suppkey").alias("key"))
    return li.groupBy("operation", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Checked inputs of diffs and merges

_CLASHING = f"{MANIFESTS}, line2 AS (SELECT path FROM line UNION ALL SELECT path FROM files WHERE doc_id % 97 = 0 AND doc_id % 11 <> 0 AND doc_id % 23 <> 0 UNION ALL SELECT upper(source)||'/'||lang||'/'||doc_id FROM files WHERE doc_id % 89 = 5)"


def _clashing(spark, d):
    b, l, i = R.three_manifests(spark, d)  # noqa: E741
    f = R.files(spark, d)
    n = F.col("doc_id")
    twice = f.filter((n % 97 == 0) & (n % 11 != 0) & (n % 23 != 0)).select("path", "hash", "bytes")
    up = f.filter(n % 89 == 5).select(F.concat(F.upper("source"), F.substring(F.col("path"), F.length("source") + 1, F.length("path"))).alias("path"), "hash", "bytes")
    return b, l.unionByName(twice).unionByName(up), i


@query("merge_rejections", f"""WITH {_CLASHING}, a AS (SELECT DISTINCT string_split(path,'/')[1] AS x FROM line2 UNION SELECT DISTINCT string_split(path,'/')[1]||'/'||string_split(path,'/')[2] FROM line2 UNION SELECT path FROM line2)
SELECT 'line' AS side, 'duplicate' AS problem, path FROM line2 GROUP BY path HAVING count(*) > 1 UNION ALL SELECT 'line', 'collision', min(x) FROM a GROUP BY lower(x) HAVING min(x) <> max(x)""")  # fmt: skip
def _(spark, d):
    b, l, i = _clashing(spark, d)  # noqa: E741
    return diff.input_problems({"base": b, "line": l, "incoming": i})


@query("merge_policies", f"WITH {POL}, {MANIFESTS}, {MERGED}, s AS (SELECT path, l, i, b, {DOMAIN.format('plan')} AS domain FROM plan WHERE outcome = 'conflict') SELECT path, concat_ws(',', CASE WHEN l IS NOT NULL THEN domain END, CASE WHEN i IS NOT NULL AND (l IS NULL OR domain <> 'public') THEN 'public' END, CASE WHEN b IS NOT NULL AND l IS NULL AND (i IS NULL OR domain <> 'public') THEN domain END) AS policies FROM s")
def _(spark, d):
    """The incoming side of every conflict is public, the others have the policy of their path."""
    plan = diff.merge(*R.three_manifests(spark, d)).filter("outcome = 'conflict'")
    s = R.secured(spark, plan)
    own = F.col("domains")[0]
    sides = access.present_policies(F.when(F.col("line").isNotNull(), own), F.when(F.col("incoming").isNotNull(), "public"), F.when(F.col("base").isNotNull(), own))
    return s.select("path", F.array_join(sides, ",").alias("policies"))


@query("merge_identity", f"WITH {MANIFESTS}, k AS (SELECT path FROM base UNION SELECT path FROM line) SELECT CAST(0 AS BIGINT) AS violations, (SELECT count(*) FROM k) AS paths, (SELECT count(*) FROM line) AS kept")
def _(spark, d):
    """merge(b, b, x) is x, and every path is accounted for."""
    b, l, _i = R.three_manifests(spark, d)  # noqa: E741
    plan = diff.merge(b, b, l)
    out = diff.merged_rows(plan).select("path", "hash")
    lost = differing(out, l.select("path", "hash")).select((F.col("missing") + F.col("extra")).alias("violations"))
    n = plan.agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("outcome").isin("keep_line", "take_incoming")).alias("kept"))
    return lost.crossJoin(n)


@query("merge_checked", f"WITH {MANIFESTS}, {MERGED} SELECT path, outcome FROM plan")
def _(spark, d):
    return diff.checked_merge(*R.three_manifests(spark, d)).select("path", "outcome")


@query("merge_preview", f"""WITH {ACT}, r AS (SELECT o_orderkey, actor, domains, CASE WHEN o_orderpriority = '1-URGENT' THEN 'admin' WHEN o_orderpriority = '2-HIGH' THEN 'team/security' ELSE 'public' END AS p,
  o_orderkey % 9 = 0 AS none, o_orderstatus = 'O' AS same, o_orderkey % 4 = 1 AS secret, o_orderkey % 3 AS n FROM orders, act)
SELECT o_orderkey AS change, actor, CASE WHEN NOT (list_contains(domains,'admin') OR list_contains(domains,p)) THEN 'refused' WHEN none THEN 'no_snapshot' WHEN NOT same THEN 'other_line' WHEN secret AND NOT list_contains(domains,'admin') THEN 'unavailable' WHEN n = 0 THEN 'clean' ELSE 'conflicts' END AS answer,
  CASE WHEN list_contains(domains,'admin') OR list_contains(domains,p) THEN CAST(n AS BIGINT) END AS n FROM r""")  # fmt: skip
def _(spark, d):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", "admin").when(F.col("o_orderpriority") == "2-HIGH", "team/security").otherwise("public")
    r = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.array(p).alias("policy")).join(F.broadcast(R.actors(spark)), F.lit(True), "inner")
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 1, F.array(F.lit("admin"))).otherwise(access.public())
    answer = access.preview_answer(access.can_access(F.col("domains"), F.col("policy")), k % 9 != 0, F.col("o_orderstatus") == "O", access.can_access(F.col("domains"), source) | (k % 4 != 1), k % 3)
    return r.withColumn("answer", answer).select(k.alias("change"), "actor", "answer", access.unless_refused(F.col("answer"), (k % 3).cast("long")).alias("n"))


@query("merge_effects", f"WITH {MANIFESTS}, {MERGED} SELECT CASE outcome WHEN 'conflict' THEN 'conflicts' ELSE 'snapshot_files' END AS written, count(*) AS n FROM plan WHERE outcome <> 'delete' AND (outcome = 'conflict' OR (SELECT count(*) FROM plan WHERE outcome = 'conflict') = 0) GROUP BY 1")
def _(spark, d):
    """What an integration writes: conflicts if there are any, else the files of a new snapshot."""
    plan = diff.merge(*R.three_manifests(spark, d))
    stops = plan.filter("outcome = 'conflict'").limit(1).select(F.lit(True).alias("stops"))
    conflicts = plan.filter("outcome = 'conflict'").select(F.lit("conflicts").alias("written"))
    files = diff.merged_rows(plan).join(stops, F.lit(True), "left_anti").select(F.lit("snapshot_files").alias("written"))
    return conflicts.unionByName(files).groupBy("written").agg(F.count(F.lit(1)).alias("n"))


@query("conflict_refresh", f"""WITH {MANIFESTS}, {MERGED}, c AS (SELECT path, kind FROM plan WHERE outcome = 'conflict'), s AS (SELECT path, 'old-'||path AS id, CASE WHEN length(path) % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM c WHERE length(path) % 2 = 0)
SELECT coalesce(s.path, c.path) AS path, coalesce(s.id, 'new-'||c.path) AS id, CASE WHEN c.path IS NULL THEN 'stale' ELSE c.kind END AS kind, CASE WHEN s.path IS NULL THEN 'insert' WHEN c.path IS NULL THEN 'keep' ELSE 'refresh' END AS action
FROM s FULL JOIN c ON s.path = c.path AND s.status = 'unresolved'""")  # fmt: skip
def _(spark, d):
    c = diff.merge(*R.three_manifests(spark, d)).filter("outcome = 'conflict'")
    found = c.select("path", F.lit(None).cast("string").alias("base_snapshot"), F.concat(F.lit("new-"), "path").alias("id"), "kind")
    stored = c.filter(F.length("path") % 2 == 0).select("path", F.lit(None).cast("string").alias("base_snapshot"), F.concat(F.lit("old-"), "path").alias("id"), F.lit("stale").alias("kind"), F.when(F.length("path") % 3 == 0, "resolved").otherwise("unresolved").alias("status"))
    return diff.refreshed_conflicts(stored, found, ["path", "base_snapshot"], ["id"], ["kind"]).select("path", "id", "kind", "action")


@query("diff_line_head", f"WITH {MANIFESTS}, h AS (SELECT split_part(path,'/',1) AS line, path, hash FROM line), p AS (SELECT split_part(path,'/',1) AS line, path, hash FROM base WHERE split_part(path,'/',1) <> 'src3') SELECT coalesce(h.line, p.line) AS line, CASE WHEN p.hash IS NULL THEN 'added' WHEN h.hash IS NULL THEN 'deleted' ELSE 'modified' END AS status, count(*) AS n FROM h FULL JOIN p USING (path) WHERE h.hash IS DISTINCT FROM p.hash GROUP BY 1, 2")
def _(spark, d):
    """Each line's head against its parent; src3's head has none, so all of its files are added."""
    b, l, _i = R.three_manifests(spark, d)  # noqa: E741
    line = F.substring_index("path", "/", 1)
    return diff.diff(b.filter(line != "src3"), l).groupBy(line.alias("line"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("optional_snapshot", "SELECT o_orderkey AS change, c_name AS snapshot, coalesce(c_mktsegment, 'public') AS policy FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("base", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")))
    return o.join(table(spark, d, "customer"), F.col("base") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("change"), F.col("c_name").alias("snapshot"), F.coalesce("c_mktsegment", F.lit("public")).alias("policy"))


# Graphs


@query("dag_problems", f"WITH {TURNS}, n AS (SELECT node FROM nodes WHERE node % 5 <> 0 UNION ALL SELECT node FROM nodes WHERE node % 35 = 1), x AS (SELECT node FROM n GROUP BY node HAVING count(*) > 1) SELECT node, 'duplicate' AS problem FROM x UNION ALL SELECT DISTINCT node, 'missing_parent' FROM edges WHERE node IN (SELECT node FROM n) AND parent NOT IN (SELECT node FROM n) UNION ALL SELECT DISTINCT node, 'cycle' FROM n WHERE node % 7 = 3")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    kept = nodes.filter("node % 5 <> 0").select("node")
    twice = nodes.filter("node % 35 = 1").select("node")
    loops = kept.filter("node % 7 = 3").select("node", F.col("node").alias("parent"))
    own = edges.join(kept.union(twice).distinct(), "node", "left_semi").select("node", "parent")
    return graph.problems(kept.union(twice), own.union(loops))


@query("closure_errors", "SELECT 'order:'||o_orderkey AS root, CASE WHEN o_custkey % 11 = 0 THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'quarantined' WHEN n_nationkey % 5 = 0 THEN 'promised' WHEN n_regionkey = 3 THEN 'wrong_kind' ELSE 'ok' END AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    key, kind = F.substring_index("object", ":", -1).cast("long"), F.col("kind")
    presence = F.when((kind == "customer") & (key % 7 == 0), 3).when((kind == "nation") & (key % 5 == 0), 2).otherwise(1)
    objects = objects.filter(~((kind == "customer") & (key % 11 == 0))).withColumn("presence", presence).withColumn("kind", F.when((kind == "region") & (key == 3), "blob").otherwise(kind))
    roots = table(spark, d, "orders").select(name_of("order", "o_orderkey").alias("object"))
    return graph.checked_closure(roots, edges, objects)


@query("ancestry_generation", f"WITH {WALK.replace('edges AS (SELECT conv_id, node, node-1', 'edges0 AS (SELECT conv_id, node, node-1').replace(', walk(', ', edges AS (SELECT * FROM edges0 WHERE (node % 5 = 2) = (parent % 5 = 2)), walk(')} SELECT node, generation FROM gen")
def _(spark, d):
    """Generations along parents of the same kind only."""
    nodes, edges = R.turns(spark, d)
    objects = nodes.select(F.col("node").alias("object"), F.when(F.col("node") % 5 == 2, "operation").otherwise("snapshot").alias("kind"))
    return graph.generations(nodes, store.ancestry(objects, edges)[0])


@query("ancestry_errors", f"WITH {TURNS} SELECT DISTINCT node, parent, 'wrong_kind' AS problem FROM edges WHERE (node % 5 = 2) <> (parent % 5 = 2)")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    objects = nodes.select(F.col("node").alias("object"), F.when(F.col("node") % 5 == 2, "operation").otherwise("snapshot").alias("kind"))
    return store.ancestry(objects, edges)[1]


_EXTRACTED = """x AS (SELECT 'order:'||o_orderkey AS source, 0 AS a, 0 AS b, 'owner' AS role, 'customer' AS expected_kind, 'customer:'||o_custkey AS target FROM orders
  UNION ALL SELECT 'order:'||l_orderkey, 1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey), 'supplier', NULL, 'supplier:'||l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
y AS (SELECT source, role, expected_kind, target, min((a, b)) AS p FROM x GROUP BY ALL),
extracted AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY p) - 1 AS BIGINT) AS ordinal, role, expected_kind, target FROM y)"""


def _extracted(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    suppliers = F.transform("l", lambda x: F.concat(F.lit("supplier:"), x["l_suppkey"].cast("string")))
    objects = o.select(name_of("order", "o_orderkey").alias("object"), name_of("customer", "o_custkey").alias("owner"), suppliers.alias("suppliers"))
    return store.extracted_edges(objects, {"owner": ("owner", "customer"), "suppliers": ("supplier", None)})


@query("edge_extraction", f"WITH {_EXTRACTED} SELECT * FROM extracted")
def _(spark, d):
    return _extracted(spark, d)


@query("edge_index_check", f"WITH {_EXTRACTED} SELECT (SELECT count(*) FROM extracted WHERE ordinal % 4 = 1) AS missing, (SELECT count(*) FROM extracted WHERE ordinal % 4 = 1 AND ordinal % 8 = 1) AS extra")
def _(spark, d):
    """Stored edges against those extracted: every fourth is lost, half of these under another role."""
    edges = _extracted(spark, d)
    stored = edges.filter("ordinal % 4 <> 1").unionByName(edges.filter("ordinal % 8 = 1").withColumn("role", F.lit("other")))
    return differing(edges, stored)


@query("derived_index_recomputed", f"WITH {WALK}, p AS (SELECT node, parent, row_number() OVER (PARTITION BY node ORDER BY parent DESC) - 1 AS position FROM edges) SELECT 'generations' AS \"index\", (SELECT count(*) FROM gen WHERE node % 50 = 3) AS missing, (SELECT count(*) FROM gen WHERE node % 50 = 3 AND node % 100 = 3) AS extra UNION ALL SELECT 'parents', (SELECT count(*) FROM p WHERE node % 20 = 2 AND position = 0), CAST(0 AS BIGINT)")
def _(spark, d):
    """Stored generations and positions, with rows lost and changed, against their recomputation."""
    nodes, edges = R.turns(spark, d)
    g = graph.generations(nodes, edges).select("node", "generation")
    stored = g.filter("node % 50 <> 3").unionByName(g.filter("node % 100 = 3").withColumn("generation", F.col("generation") + 1))
    p = graph.parent_positions(edges.withColumn("o", -F.col("parent")), "node", "o", "parent")
    parts = [("generations", differing(g, stored)), ("parents", differing(p, p.filter("NOT (source % 20 = 2 AND position = 0)")))]
    return parts[0][1].select(F.lit("generations").alias("index"), "missing", "extra").unionByName(parts[1][1].select(F.lit("parents").alias("index"), "missing", "extra"))


@query("rebuilt_indexes", f"WITH {WALK}, p AS (SELECT node, parent FROM edges) SELECT t AS \"table\", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'snapshot_generations' AS t, generation AS v FROM gen UNION ALL SELECT 'snapshot_parents', row_number() OVER (PARTITION BY node ORDER BY parent) - 1 FROM p) GROUP BY t")
def _(spark, d):
    nodes, edges = R.turns(spark, d)
    objects = nodes.select(F.col("node").alias("object"), F.lit("snapshot").alias("kind"))
    links = edges.select(F.col("node").alias("source"), F.col("parent").alias("ordinal"), F.lit("snapshot_parent").alias("role"), F.col("parent").alias("target"))
    out = store.rebuilt(links, objects)
    total = lambda name, c: out[name].agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).select(F.lit(name).alias("table"), "n", "total")
    return total("snapshot_generations", "generation").unionByName(total("snapshot_parents", "position"))


@query("operation_head_view", f"WITH {OPS} SELECT user_id AS operation, max(event_id) AS target FROM ops WHERE kind = 'integrate_line' GROUP BY user_id")
def _(spark, d):
    """The rows of references whose kind is the operation head's, under the names that the view gives them."""
    refs = R.operations(spark, d).groupBy("kind", "user_id").agg(F.max("event_id").alias("target"))
    return refs.filter("kind = 'integrate_line'").select(F.col("user_id").alias("operation"), "target")


# The store


@query("put_outcomes", "SELECT 'doc:'||doc_id AS object, CASE WHEN doc_id % 7 = 0 THEN 'quarantined' WHEN doc_id % 2 = 0 THEN 'already_present' ELSE 'stored' END AS outcome FROM (SELECT DISTINCT doc_id FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents").select(name_of("doc", "doc_id").alias("object"), F.encode("text", "UTF-8").alias("payload"), "doc_id")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    stored = docs.filter("doc_id % 2 = 0 OR doc_id % 7 = 0").select("object", "payload")
    return store.put_outcomes(stored, docs.select("object", changed.alias("payload")))


@query("indexed_objects", "SELECT 'order:'||o_orderkey AS object, 'order' AS kind, 1 AS presence FROM orders UNION ALL SELECT 'customer:'||c_custkey, 'customer', CASE WHEN c_custkey % 9 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 9 = 0 OR c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), name_of("customer", "c_custkey").alias("object"), F.lit("customer").alias("kind"))
    stored = c.filter("k % 2 = 0 OR k % 9 = 0").select("object", "kind", F.when(F.col("k") % 9 == 0, 3).otherwise(1).alias("presence"))
    o = table(spark, d, "orders")
    edges = o.select(name_of("order", "o_orderkey").alias("source"), name_of("customer", "o_custkey").alias("target"), F.lit("customer").alias("expected_kind"))
    return store.indexed(stored, o.select(name_of("order", "o_orderkey").alias("object"), F.lit("order").alias("kind")), edges)


@query("mark_promised", "SELECT p_partkey AS object, 1 AS presence FROM part WHERE p_size > 10 UNION ALL SELECT DISTINCT l_partkey, 2 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(spark, d):
    known = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("object"), F.lit(1).alias("presence"))
    return store.promised(known, table(spark, d, "lineitem").select(F.col("l_partkey").alias("object")))


_BAD = "bad AS (SELECT 'customer:'||user_id AS object FROM events WHERE event_type = 'error' GROUP BY user_id)"


def _quarantine(spark, d):
    objects, edges = R.typed(spark, d)
    bad = table(spark, d, "events").filter("event_type = 'error'").select(name_of("customer", "user_id").alias("object"), F.lit("digest").alias("reason"))
    return store.quarantined(objects.withColumn("presence", F.lit(1)), edges, bad)


@query("quarantined_objects", f"WITH {TYPED}, {_BAD} SELECT object, kind, CASE WHEN object IN (SELECT object FROM bad) THEN 3 ELSE 1 END AS presence FROM objects")
def _(spark, d):
    return _quarantine(spark, d)["objects"].select("object", "kind", "presence")


@query("quarantine_effects", f"WITH {TYPED}, {_BAD} SELECT 'edges' AS part, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer WHERE 'customer:'||c_custkey NOT IN (SELECT object FROM bad)) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'incidents', (SELECT count(*) FROM bad WHERE object IN (SELECT object FROM objects)) UNION ALL SELECT 'refused', (SELECT count(*) FROM bad WHERE object NOT IN (SELECT object FROM objects))")
def _(spark, d):
    out = _quarantine(spark, d)
    return store.load_problems({k: out[k] for k in ("edges", "incidents", "refused")}).withColumnRenamed("check", "part")


@query("orphan_evidence", f"WITH {FILES} SELECT DISTINCT 'doc:'||doc_id AS object, 'objects/quarantine/'||hash AS path FROM files WHERE hash NOT IN (SELECT hash FROM files WHERE lang = 'en')")
def _(spark, d):
    f = R.files(spark, d).withColumn("path", F.concat(F.lit("objects/quarantine/"), "hash")).withColumn("lang", F.split("path", "/")[1])
    en = table(spark, d, "documents").filter("lang = 'en'").select(F.concat(F.lit("objects/quarantine/"), F.sha2("text", 256)).alias("path"))
    return store.reconciled(f.select(name_of("doc", "doc_id").alias("object"), "path"), en).distinct()


_PLACES = "SELECT CASE doc_id % 4 WHEN 0 THEN 'objects/tmp/'||doc_id WHEN 1 THEN 'objects/quarantine/'||doc_id WHEN 2 THEN 'objects/loose/0/12/ab/'||doc_id||'.rgl' ELSE 'objects/'||doc_id END AS path, doc_id FROM (SELECT DISTINCT doc_id FROM documents)"


@query("inventory_classes", f"SELECT path, ['stale_temporary','quarantined','unindexed_orphan','unexpected'][doc_id % 4 + 1] AS class, row_number() OVER (ORDER BY encode(path)) - 1 AS position FROM ({_PLACES})")
def _(spark, d):
    n = F.col("doc_id")
    s = n.cast("string")
    path = F.when(n % 4 == 0, F.concat(F.lit("objects/tmp/"), s)).when(n % 4 == 1, F.concat(F.lit("objects/quarantine/"), s)).when(n % 4 == 2, F.concat(F.lit("objects/loose/0/12/ab/"), s, F.lit(".rgl"))).otherwise(F.concat(F.lit("objects/"), s))
    rows = table(spark, d, "documents").select("doc_id").distinct().select(path.alias("path"))
    return order.positions(rows.withColumn("class", store.inventory_class(F.col("path"))), F.col("path"))


def _records(spark, d, audited):
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = codecs.framed(docs.select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")), b"RECORD\0", 2, 0)
    n, size = F.col("path").cast("long"), F.octet_length("content")
    broken = F.when(n % 5 == 0, F.concat(F.expr("substring(content, 1, octet_length(content) - 4)"), F.lit(b"\0\0\0\0"))).when(n % 5 == 1, F.expr("substring(content, 1, octet_length(content) - 3)")).otherwise(F.col("content"))
    return codecs.records(rows.select("path", F.when(size > 0, broken).alias("content")), b"RECORD\0", audited)


@query("record_read_audited", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 5 WHEN 0 THEN 'the checksum differs' WHEN 1 THEN 'another length' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 > 1 THEN CAST(octet_length(encode(min(text))) AS BIGINT) END AS bytes FROM documents GROUP BY doc_id")
def _(spark, d):
    return _records(spark, d, True).select("path", "status", F.octet_length("payload").cast("long").alias("bytes"))


@query("record_read", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 > 1 THEN 'ok' ELSE 'unavailable' END AS status, CASE WHEN doc_id % 5 > 1 THEN sha256(min(text)) END AS payload_sha256 FROM documents GROUP BY doc_id")
def _(spark, d):
    return _records(spark, d, False).select("path", "status", F.sha2("payload", 256).alias("payload_sha256"))


@query("reference_invariants", """SELECT o_custkey * 100000 + o_orderkey AS key, CASE WHEN o_orderkey % 23 = 0 THEN 'missing' WHEN o_orderkey % 29 = 0 THEN 'target_kind' WHEN o_orderkey % 31 = 0 THEN 'operation_kind' WHEN o_orderkey % 37 = 0 THEN 'identity' WHEN o_orderkey % 41 = 0 THEN 'unnamed' END AS problem
FROM orders WHERE o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 OR o_orderkey % 41 = 0""")  # fmt: skip
def _(spark, d):
    n = F.col("o_orderkey")
    o = table(spark, d, "orders").select(n, (F.col("o_custkey") * 100_000 + n).alias("key"), name_of("line", "o_orderkey").alias("target"), name_of("operation", "o_orderkey").alias("operation"))
    lines = o.filter(n % 23 != 0).select(F.col("target").alias("object"), F.when(n % 29 == 0, "blob").otherwise("line_state").alias("kind"), F.when(n % 37 != 0, F.col("key")).alias("identity"))
    ops = o.select(F.col("operation").alias("object"), F.when(n % 31 == 0, "blob").otherwise("operation").alias("kind"), F.lit(None).cast("long").alias("identity"))
    edges = o.filter(n % 41 != 0).select(F.col("operation").alias("source"), "target")
    return store.reference_problems(o.select("key", F.lit("line").alias("ref_kind"), "target", "operation"), lines.unionByName(ops), edges)


@query("reference_kind_matrix", "SELECT event_id AS key, 'target_kind' AS problem FROM events WHERE event_type IN ('error','signup')")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), "event_type")
    kind = F.when(F.col("event_type").isin("view", "click"), "marker").when(F.col("event_type") == "purchase", "release").when(F.col("event_type") == "signup", "change").otherwise("unheard_of")
    of = F.when(F.col("event_type") == "purchase", "release").otherwise("marker")
    name = F.col("key").cast("string")
    objects = e.select(F.concat(F.lit("t"), name).alias("object"), of.alias("kind"), F.col("key").alias("identity")).unionByName(e.select(F.concat(F.lit("o"), name).alias("object"), F.lit("operation").alias("kind"), F.lit(None).cast("long").alias("identity")))
    refs = e.select("key", kind.alias("ref_kind"), F.concat(F.lit("t"), name).alias("target"), F.concat(F.lit("o"), name).alias("operation"))
    return store.reference_problems(refs, objects, refs.select(F.col("operation").alias("source"), "target"))


@query("active_locations", "SELECT o_orderkey AS object, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 2 AND l_returnflag = 'N' WHERE o_orderstatus <> 'P' GROUP BY o_orderkey HAVING count(l_orderkey) <> 1")
def _(spark, d):
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("object"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("presence"))
    places = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object"), (F.col("l_linenumber") <= 2).alias("active"), (F.col("l_returnflag") == "N").alias("loose"))
    return store.location_problems(objects, places)


@query("value_shapes", "SELECT event_id AS object, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS INTEGER) AS field, CASE WHEN event_type = 'error' THEN 'type' WHEN value < 20 THEN 'too_small' ELSE 'too_large' END AS problem FROM events WHERE event_type = 'error' OR value < 20 OR value > 80")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("object"), "event_type", "value")
    text = F.struct(F.lit(1).alias("field"), F.when(F.col("event_type") == "error", "bytes").otherwise("text").alias("type"), F.octet_length("event_type").cast("double").alias("size"))
    number = F.struct(F.lit(2).alias("field"), F.lit("unsigned").alias("type"), F.col("value").cast("double").alias("size"))
    values = e.select("object", F.col("event_type").alias("kind"), F.explode(F.array(text, number)).alias("v")).select("object", "kind", "v.*")
    shapes = spark.createDataFrame([(k, f, t, a, b) for k in ("click", "error", "purchase", "signup", "view") for f, t, a, b in ((1, "text", 1.0, 64.0), (2, "unsigned", 20.0, 80.0))], "kind string, field int, type string, least double, most double")
    return store.value_problems(values, shapes)


@query("load_checks", "SELECT 'dangling_edges' AS \"check\", (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)) AS n UNION ALL SELECT 'repositories', CAST(CASE WHEN (SELECT count(*) FROM region) = 1 THEN 0 ELSE 1 END AS BIGINT) UNION ALL SELECT 'ledger_gaps', (SELECT count(*) FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 1)) WHERE turn <> coalesce(b + 1, 0))")
def _(spark, d):
    parts = {
        "dangling_edges": checks.dangling(table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("object")), "l_orderkey", "l_partkey"),
        "repositories": table(spark, d, "region").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1"),
        "ledger_gaps": checks.gaps(table(spark, d, "conversations").select("conv_id", "turn").distinct().filter("turn <> 1"), "turn", "conv_id"),
    }
    return store.load_problems(parts)


@query("grant_check", "SELECT DISTINCT l_orderkey AS policy, CASE WHEN l_linenumber > 4 THEN 'principal' ELSE 'capabilities' END AS problem FROM lineitem WHERE l_linenumber > 4 OR l_returnflag = 'R'")
def _(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("l"))
    caps = lambda x: F.when(x["l_returnflag"] == "R", F.array(F.lit("write"), F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write")))
    grants = F.transform("l", lambda x: F.struct((x["l_linenumber"] - 1).alias("principal"), caps(x).alias("capabilities")))
    return store.grant_problems(li.select(F.col("l_orderkey").alias("policy"), F.array(*[F.lit(x) for x in "abcd"]).alias("principals"), grants.alias("grants")))


@query("identity_keys", "SELECT l_orderkey AS identity, l_suppkey AS key, 'repeated' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 'algorithm' FROM lineitem WHERE (l_returnflag = 'N') <> (l_linestatus = 'O')")
def _(spark, d):
    k = F.struct(F.when(F.col("l_returnflag") == "N", "sign").otherwise("agree").alias("use"), F.col("l_suppkey").alias("key"), F.when(F.col("l_linestatus") == "O", "ed25519").otherwise("x25519").alias("algorithm"))
    return store.key_problems(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("identity")).agg(F.collect_list(k).alias("keys")))


@query("artifact_check", "SELECT doc_id, doc_id % 3 <> 0 AND (doc_id % 2 = 0 OR doc_id % 5 = 0) AS ok FROM documents")
def _(spark, d):
    n = F.col("doc_id")
    digest = F.when(n % 3 == 0, F.unhex(F.substring(F.sha2("text", 256), 1, 32))).otherwise(F.unhex(F.sha2("text", 256)))
    return table(spark, d, "documents").select("doc_id", store.artifact_ok(digest, F.when(n % 2 == 0, "at"), F.when(n % 5 == 0, "blob")).alias("ok"))


@query("evidence_kinds", "SELECT o_orderkey AS ruleset, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS ok FROM orders")
def _(spark, d):
    n = F.col("o_orderkey")
    kinds = F.when(n % 3 == 0, F.array(F.lit(20), F.lit(24))).when(n % 5 == 0, F.array(F.lit(22), F.lit(21))).otherwise(F.array(F.lit(20), F.lit(23)))
    return table(spark, d, "orders").select(n.alias("ruleset"), store.evidence_kinds_ok(kinds).alias("ok"))


@query("chunk_sum_check", "SELECT o_orderkey AS object, CAST(s + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stated, CAST(s AS BIGINT) AS found FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 6 = 0")
def _(spark, d):
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_quantity").cast("long").alias("length"))
    whole = chunks.groupBy("object").agg(F.sum("length").alias("length")).withColumn("length", F.col("length") + (F.col("object") % 6 == 0).cast("long"))
    return store.chunk_sums(chunks, whole.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("object")), "object", "left_semi"))


@query("bootstrap_links", "SELECT n_name AS root, CASE WHEN r_name IS NULL THEN 'missing' WHEN n_nationkey % 5 <> r_regionkey THEN 'other' ELSE 'ok' END AS status FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 4")
def _(spark, d):
    """Each root names the object that it was bootstrapped with, and that object must be there and say the same."""
    n, r = table(spark, d, "nation"), table(spark, d, "region").filter("r_regionkey <> 4")
    status = F.when(F.col("r_name").isNull(), "missing").when(F.col("n_nationkey") % 5 != F.col("r_regionkey"), "other").otherwise("ok")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_name").alias("root"), status.alias("status"))


@query("restricted_limits", "SELECT o_orderkey AS caller, least(o_custkey * 1000, 1048576) AS bytes, least(o_orderkey, 65536) AS items, least(o_orderkey % 100, 64) AS depth FROM orders")
def _(spark, d):
    asked = {"bytes": F.col("o_custkey") * 1000, "items": F.col("o_orderkey"), "depth": F.col("o_orderkey") % 100}
    out = store.restricted(asked, {"bytes": 1_048_576, "items": 65_536, "depth": 64})
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("caller"), *[c.alias(k) for k, c in out.items()])


@query("gc_with_leases", "WITH live AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50) SELECT 'customer:'||c_custkey AS object FROM customer WHERE c_custkey NOT IN (SELECT k FROM live)")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    roots = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(name_of("order", "o_orderkey").alias("object"))
    leases = table(spark, d, "events").filter("event_type = 'purchase'").select(name_of("customer", "user_id").alias("object"), F.col("value").alias("expires"))
    return graph.dead(objects, store.pinned_roots(roots, leases, F.lit(50)), edges).filter("object LIKE 'customer:%'")


@query("backup_manifest", "WITH p AS (SELECT o_orderkey, c_custkey, n_nationkey, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'), x AS (SELECT 'order:'||o_orderkey AS object, 'order' AS kind FROM p UNION SELECT 'customer:'||c_custkey, 'customer' FROM p UNION SELECT 'nation:'||n_nationkey, 'nation' FROM p UNION SELECT 'region:'||n_regionkey, 'region' FROM p) SELECT row_number() OVER (ORDER BY encode(object)) - 1 AS position, object, kind FROM x")
def _(spark, d):
    objects, edges = R.typed(spark, d)
    roots = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(name_of("order", "o_orderkey").alias("object"))
    return store.backup_manifest(roots, edges, objects)


@query("audience_view", f"WITH {POL}, {FILES}, s AS (SELECT path, hash, {DOMAIN.format('f')} AS domain FROM files f) SELECT path, CASE WHEN domain IN ('public','team/security') THEN hash END AS hash FROM s WHERE domain <> 'admin'")
def _(spark, d):
    """What a view shows bob: files of his domains with content, others by name only, those for admins not at all."""
    s = R.secured(spark, R.files(spark, d)).filter(~F.array_contains("domains", "admin"))
    return s.select("path", F.when(access.can_access(R.domains_of("bob"), F.col("domains")), F.col("hash")).alias("hash"))


# Orders, names, identities


@query("op_log_ordered", f"WITH {OPS} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM ops")
def _(spark, d):
    return order.positions(R.operations(spark, d).select("event_id", "ts"), F.col("ts"), F.col("event_id")).select("event_id", "position")


@query("paths_by_bytes", f"WITH {FILES}, p AS (SELECT DISTINCT replace(path, 'src1/', 'src1-') AS path FROM files) SELECT path, row_number() OVER (ORDER BY encode(path)) - 1 AS position FROM p")
def _(spark, d):
    p = R.files(spark, d).select(F.replace("path", F.lit("src1/"), F.lit("src1-")).alias("path")).distinct()
    return order.positions(p, F.col("path"))


@query("paths_by_segments", f"WITH {FILES}, p AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN replace(path, 'src1/', 'src1-') ELSE path END AS path FROM files) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS position FROM p")
def _(spark, d):
    f = R.files(spark, d)
    p = f.select(F.when(F.col("doc_id") % 3 == 0, F.replace("path", F.lit("src1/"), F.lit("src1-"))).otherwise(F.col("path")).alias("path")).distinct()
    return order.positions(p, order.by_segments(F.col("path")))


@query("names_encoded_order", "SELECT p_name AS name, row_number() OVER (ORDER BY octet_length(encode(p_name)), encode(p_name)) - 1 AS position FROM (SELECT DISTINCT p_name FROM part)")
def _(spark, d):
    return order.positions(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), order.by_encoded_name(F.col("name")))


@query("path_validate_full", "WITH p AS (SELECT page_id AS n, 'p/'||page_id AS p FROM pages), q AS (SELECT n, CASE n % 6 WHEN 0 THEN p WHEN 1 THEN p||'/caf'||chr(233) WHEN 2 THEN p||'/cafe'||chr(769) WHEN 3 THEN p||'/AUX' WHEN 4 THEN p||'/'||chr(223)||'|' ELSE p||'//'||chr(233) END AS path FROM p) SELECT path, CASE WHEN nfc_normalize(path) <> path THEN 'not_composed' WHEN n % 6 = 3 THEN 'reserved' WHEN n % 6 = 4 THEN 'not_portable' WHEN n % 6 = 5 THEN 'empty' END AS reason FROM q")
def _(spark, d):
    n, p = F.col("page_id"), F.concat(F.lit("p/"), F.col("page_id").cast("string"))
    tails = {1: "/café", 2: "/café", 3: "/AUX", 4: "/ß|", 5: "//é"}
    path = p
    for k, tail in tails.items():
        path = F.when(n % 6 == k, F.concat(p, F.lit(tail))).otherwise(path)
    return manifest.path_problems(table(spark, d, "pages").select(path.alias("path")))


@query("path_collision_full", "SELECT 'g'||doc_id||'/STRASSE' AS first_path, 'g'||doc_id||'/stra'||chr(223)||'e' AS second_path FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id % 2 = 0 UNION ALL SELECT 'g'||doc_id||'/'||chr(196), 'g'||doc_id||'/'||chr(228) FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id % 2 = 1")
def _(spark, d):
    g = F.concat(F.lit("g"), F.col("doc_id").cast("string"), F.lit("/"))
    even = F.col("doc_id") % 2 == 0
    names = F.when(even, F.array(F.lit("STRASSE"), F.lit("straße"), F.lit("plain"))).otherwise(F.array(F.lit("Ä"), F.lit("ä"), F.lit("plain")))
    rows = table(spark, d, "documents").select("doc_id").distinct().select(g.alias("g"), F.explode(names).alias("n"))
    return manifest.collisions(rows.select(F.concat("g", "n").alias("path"))).select("first_path", "second_path")


@query("files_under_files", f"WITH {FILES} SELECT source||'/'||lang AS ancestor, path FROM files WHERE source||'/'||lang IN (SELECT DISTINCT source||'/'||lang FROM files WHERE lang = 'en')")
def _(spark, d):
    f = R.files(spark, d).select("path")
    folders = table(spark, d, "documents").filter("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    return manifest.files_under_files(f.unionByName(folders))


@query("manifest_names", "WITH n AS (SELECT l_orderkey AS g, CASE WHEN l_linenumber % 2 = 0 THEN 'Name'||(l_linenumber // 2) ELSE 'name'||(l_linenumber // 3) END AS name FROM lineitem), x AS (SELECT g, name, count(*) AS c FROM n GROUP BY 1, 2) SELECT g AS manifest, 'repeated' AS problem, name FROM x WHERE c > 1 UNION ALL SELECT g, 'folds_alike', min(name) FROM x GROUP BY g, lower(name) HAVING count(*) > 1")
def _(spark, d):
    k = F.col("l_linenumber")
    name = F.when(k % 2 == 0, F.concat(F.lit("Name"), F.floor(k / 2).cast("string"))).otherwise(F.concat(F.lit("name"), F.floor(k / 3).cast("string")))
    return manifest.name_problems(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("manifest"), name.alias("name")), "manifest", "name")


@query("content_ids", "SELECT DISTINCT 'snap-'||substr(sha256(text), 1, 12) AS id, sha256(text) AS hash FROM documents")
def _(spark, d):
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select(F.concat(F.lit("snap-"), F.substring(h, 1, 12)).alias("id"), h.alias("hash")).distinct()


@query("op_times", "SELECT event_id, epoch_us(ts) // 1000 AS created_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS shown FROM events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return table(spark, d, "events").select("event_id", millis.alias("created_at"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("shown"))


@query("field_lookup", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS actor, CASE WHEN event_type = 'purchase' THEN 'integrate_line' END AS kind FROM events")
def _(spark, d):
    """Fields of an object by number, absent ones null."""
    fields = F.map_from_arrays(F.array(F.lit(1), F.when(F.col("event_type") != "error", 3).otherwise(4)), F.array(F.when(F.col("event_type") == "purchase", "integrate_line"), F.col("user_id").cast("string")))
    e = table(spark, d, "events").withColumn("fields", fields)
    return e.select("event_id", F.try_element_at("fields", F.lit(3)).cast("long").alias("actor"), F.try_element_at("fields", F.lit(1)).alias("kind"))


@query("blake3_props")
def _(spark, d):
    return table(spark, d, "events").select("event_type").distinct().select("event_type", codecs.blake3_hex(F.encode("event_type", "UTF-8")).alias("digest"))


@query("diagnostic_json")
def _(spark, d):
    """Texts, their lengths and bytes as an encoded value, decoded and shown."""
    return table(spark, d, "benchmark").select("item_id", codecs.diagnostic_json(F.col("text")).alias("shown"))


@query("signing_preimages")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2(codecs.preimages(F.col("text")), 256).alias("digest"))
