"""Graph and dependency queries over the key graph of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

_E = """e AS (
    SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'DEFINED_IN' AS rel FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'CALLS' FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'IMPORTS' FROM nation
    UNION ALL SELECT 'r:' || r_regionkey, 's:' || (r_regionkey + 1), 'CALLED_BY' FROM region),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
nodes AS (SELECT 'c:' || c_custkey AS id, 'FUNCTION' AS type FROM customer UNION ALL SELECT 's:' || s_suppkey, 'CLASS' FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'FILE' FROM nation UNION ALL SELECT 'r:' || r_regionkey, 'CONCEPT' FROM region UNION ALL SELECT 'p:' || p_partkey, 'CONCEPT' FROM part)"""


def _edges(spark, d):
    pick = lambda t, a, x, b, y, rel: table(spark, d, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(rel).alias("rel"))
    one = F.col("r_regionkey") + 1
    return (
        pick("customer", "c:", "c_custkey", "n:", "c_nationkey", "DEFINED_IN")
        .unionByName(pick("supplier", "s:", "s_suppkey", "n:", "s_nationkey", "CALLS"))
        .unionByName(pick("nation", "n:", "n_nationkey", "r:", "n_regionkey", "IMPORTS"))
        .unionByName(pick("region", "r:", "r_regionkey", "s:", one, "CALLED_BY"))
    )


def _nodes(spark, d):
    pick = lambda t, a, x, kind: table(spark, d, t).select(F.concat(F.lit(a), x).alias("id"), F.lit(kind).alias("type"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit("CONCEPT").alias("type"))
    return pick("customer", "c:", "c_custkey", "FUNCTION").unionByName(pick("supplier", "s:", "s_suppkey", "CLASS")).unionByName(pick("nation", "n:", "n_nationkey", "FILE")).unionByName(pick("region", "r:", "r_regionkey", "CONCEPT")).unionByName(parts)


def _bfs_sql(start: str, depth: int, edges: str = "e", where: str = "") -> str:
    return f"WITH RECURSIVE {_E}, b(node, hops) AS (SELECT '{start}', 0 UNION SELECT x.dst, b.hops + 1 FROM b JOIN {edges} x ON x.src = b.node {where} WHERE b.hops < {depth}), m AS (SELECT node, min(hops) AS hops FROM b GROUP BY node)"


@query(f"{_bfs_sql('c:1', 5)} SELECT node, hops FROM m WHERE hops > 0")
def bfs_hops(spark, d):
    return graph.neighbours(_edges(spark, d), "c:1", 5)


@query(f"{_bfs_sql('n:3', 4, 'e', 'AND x.rel = ' + chr(39) + 'IMPORTS' + chr(39))} SELECT node, hops FROM m WHERE hops > 0")
def bfs_by_relation(spark, d):
    return graph.neighbours(_edges(spark, d), "n:3", 4, "IMPORTS")


@query(f"{_bfs_sql('c:2', 6)} SELECT 'c:2' AS src, 's:3' AS dst, (SELECT hops FROM m WHERE node = 's:3') AS hops")
def hop_distance(spark, d):
    return graph.hop_distance(_edges(spark, d), "c:2", "s:3", 6)


@query(f"""WITH RECURSIVE {_E}, b(node, path) AS (SELECT 'c:1', ['c:1'] UNION SELECT x.dst, list_append(b.path, x.dst) FROM b JOIN e x ON x.src = b.node WHERE len(b.path) < 5 AND NOT list_contains(b.path, x.dst))
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM b WHERE node LIKE 'r:%' ORDER BY len(path), path LIMIT 1""")
def shortest_path(spark, d):
    edges = _edges(spark, d)
    region = graph.neighbours(edges, "c:1", 2).where("node like 'r:%'").first()["node"]
    return graph.shortest_path(edges, "c:1", region).select(F.array_join("path", ">").alias("path"), "hops")


@query(f"{_bfs_sql('r:0', 2, 'u')} SELECT m.node, m.hops, nodes.type FROM m LEFT JOIN nodes ON nodes.id = m.node")
def ego_subgraph(spark, d):
    return graph.ego(_nodes(spark, d), _edges(spark, d), "r:0", 2)[0].select("node", "hops", "type")


@query(f"{_bfs_sql('r:0', 2, 'u')} SELECT src, dst, rel FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def ego_edges(spark, d):
    return graph.ego(_nodes(spark, d), _edges(spark, d), "r:0", 2)[1].select("src", "dst", "rel")


@query(f"WITH {_E}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT id AS node, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN g ON g.node = id WHERE type = 'FILE' ORDER BY degree DESC, node LIMIT 5")
def degree_topk(spark, d):
    return graph.top_degree(_nodes(spark, d), _edges(spark, d), 5, "FILE").select("node", "degree")


@query(f"WITH {_E} SELECT dst AS node, count(*) AS in_degree FROM e WHERE dst NOT LIKE 'concept::%' GROUP BY dst ORDER BY in_degree DESC, node LIMIT 5")
def entry_nodes(spark, d):
    return graph.entry_nodes(_edges(spark, d), 5)


@query(f"WITH {_E} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_stats(spark, d):
    return graph.stats(_nodes(spark, d), _edges(spark, d))


@query(f"WITH {_E} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def graph_orphans(spark, d):
    return graph.orphans(_nodes(spark, d), _edges(spark, d)).select("id")


@query(f"WITH {_E}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT id FROM nodes LEFT JOIN g ON g.node = id WHERE type = 'CONCEPT' AND coalesce(degree, 0) <= 1")
def cold_concepts(spark, d):
    return graph.cold_concepts(_nodes(spark, d), _edges(spark, d)).select("id")


@query("SELECT 'o:' || o_custkey AS src, o_orderstatus AS dst, arg_min(o_orderpriority, o_orderkey) AS rel, round(arg_max(o_totalprice, o_orderkey), 2) AS weight FROM orders GROUP BY o_custkey, o_orderstatus")
def edge_upsert(spark, d):
    orders = table(spark, d, "orders")
    edges = orders.select(F.concat(F.lit("o:"), "o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("rel"), F.col("o_totalprice").alias("weight"), F.col("o_orderkey").alias("seq"))
    half = F.col("seq") % 2 == 0
    return graph.upsert_edges(edges.where(half), edges.where(~half)).select("src", "dst", "rel", F.round("weight", 2).alias("weight"))


@query(f"WITH {_E} SELECT src, dst, rel FROM e WHERE src <> 'n:3' AND dst <> 'n:3'")
def delete_node_edges(spark, d):
    gone = spark.createDataFrame([("n:3",)], "id string")
    return graph.without_nodes(_nodes(spark, d), _edges(spark, d), gone)[1].select("src", "dst", "rel")


@query(f"WITH {_E} SELECT caller, min(rel) AS rel FROM (SELECT dst AS caller, rel FROM e WHERE src = 'r:1' AND rel = 'CALLED_BY' UNION ALL SELECT src, rel FROM e WHERE dst = 'r:1' AND rel = 'CALLS') GROUP BY caller")
def who_calls(spark, d):
    edges = _edges(spark, d).withColumn("src", F.when(F.col("src") == "r:1", "symbol::r:1").otherwise(F.col("src")))
    return graph.who_calls(edges, "r:1")


_DEPS = """sym AS (SELECT 'm' || p_size || p_brand AS file, 'f' || p_partkey AS name, 'f' || (p_partkey + 1) AS callee FROM part),
deps AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM sym a JOIN sym b ON a.callee = b.name WHERE a.file <> b.file)"""


def _deps(spark, d):
    part = table(spark, d, "part")
    return graph.imports(part.select(F.concat(F.lit("m"), "p_size", "p_brand").alias("file"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.array(F.concat(F.lit("f"), F.col("p_partkey") + 1)).alias("calls")))


@query(f"WITH {_DEPS} SELECT src, dst FROM deps")
def dependency_imports(spark, d):
    return _deps(spark, d)


@query(f"WITH {_DEPS} SELECT DISTINCT src AS node FROM deps WHERE dst = (SELECT min(dst) FROM deps)")
def dependency_imported_by(spark, d):
    deps = _deps(spark, d)
    first = deps.agg(F.min("dst").alias("dst"))
    return deps.join(F.broadcast(first), "dst").select(F.col("src").alias("node")).distinct()


@query(f"""WITH RECURSIVE {_DEPS}, b(node, hops) AS (SELECT (SELECT min(src) FROM deps), 0 UNION SELECT x.dst, b.hops + 1 FROM b JOIN deps x ON x.src = b.node WHERE b.hops < 3)
SELECT node, min(hops) AS hops FROM b GROUP BY node HAVING min(hops) > 0""")
def dependency_transitive(spark, d):
    deps = graph.written(_deps(spark, d), "deps")
    start = deps.agg(F.min("src")).first()[0]
    return graph.transitive(deps, start or "", "imports", 3)


@query("SELECT 'n' || n_nationkey AS path, n_name AS name FROM nation WHERE n_regionkey = 2")
def org_children(spark, d):
    return graph.children(_repos(spark, d), "r2")


@query("SELECT 'n' || n_nationkey AS path, n_name AS name FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 4) AND n_nationkey <> 4")
def org_siblings(spark, d):
    return graph.siblings(_repos(spark, d), "n4")


@query("SELECT 'r' || r_regionkey AS path, r_name AS name FROM region")
def org_roots(spark, d):
    return graph.roots(_repos(spark, d))


def _repos(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    region = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("path"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    return nation.unionByName(region)


_LINKS = "l AS (SELECT 'n' || s_nationkey AS src, 'n' || (s_suppkey % 25) AS dst FROM supplier)"


@query(f"WITH RECURSIVE {_LINKS}, b(node, hops) AS (SELECT 'n1', 0 UNION SELECT l.src, b.hops + 1 FROM b JOIN l ON l.dst = b.node WHERE b.hops < 2) SELECT node, min(hops) AS hops FROM b GROUP BY node HAVING min(hops) > 0")
def org_dependents(spark, d):
    return graph.dependencies(_org(spark, d), "n1", 2, dependents=True)


@query(f"WITH {_LINKS} SELECT src, dst, 'forward' AS direction FROM l WHERE src <> dst UNION ALL SELECT dst, src, 'reverse' FROM l WHERE src <> dst")
def org_links(spark, d):
    return graph.org_links(_org(spark, d)).select("src", "dst", "direction")


def _org(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("n"), F.col("s_suppkey") % 25).alias("dst"))


@query("""
WITH p AS (SELECT DISTINCT lower(n_name) || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-client' ELSE '_x' END AS package FROM nation),
q AS (SELECT package, regexp_replace(lower(package), '[-_.]+', '-', 'g') AS norm FROM p),
r AS (SELECT 'n' || n_nationkey AS path, regexp_replace(lower(n_name), '[-_.]+', '-', 'g') AS repo FROM nation),
x AS (SELECT package, min(path) AS path FROM q JOIN r ON norm = repo GROUP BY package)
SELECT * FROM x UNION ALL SELECT package, min(path) FROM q JOIN r ON contains(norm, repo) OR contains(repo, norm) WHERE package NOT IN (SELECT package FROM x) GROUP BY package""")
def package_match(spark, d):
    nation = table(spark, d, "nation")
    tail = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, "-client").otherwise("_x")
    return graph.match_packages(nation.select(F.concat(F.lower("n_name"), tail).alias("package")), nation.select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.col("n_name").alias("name")))


@query(f"""WITH RECURSIVE {_E}, b(node, hops) AS (SELECT 's:1', 0 UNION SELECT x.dst, b.hops + 1 FROM b JOIN e x ON x.src = b.node WHERE b.hops < 20), m AS (SELECT node, min(hops) AS hops FROM b GROUP BY node)
SELECT id AS path, CASE WHEN hops <= 1 THEN 1e0 WHEN hops = 2 THEN 75e-2 ELSE 5e-1 END AS weight FROM nodes LEFT JOIN m ON m.node = id""")
def crawl_weights(spark, d):
    files = _nodes(spark, d).select(F.col("id").alias("path"))
    return graph.crawl_weights(files, _edges(spark, d), spark.createDataFrame([("s:1",)], "path string"), 20)


@query(f"""WITH RECURSIVE {_E}, a(node, hops) AS (SELECT 'c:1', 0 UNION SELECT x.dst, a.hops + 1 FROM a JOIN e x ON x.src = a.node WHERE a.hops < 3),
b(node, hops) AS (SELECT 'c:1', 0 UNION SELECT x.dst, b.hops + 1 FROM b JOIN u x ON x.src = b.node WHERE b.hops < 3)
SELECT b.node, coalesce(min(a.hops), min(b.hops)) AS hops FROM b LEFT JOIN a ON a.node = b.node GROUP BY b.node""")
def graph_score_hops(spark, d):
    return graph.best_hops(_edges(spark, d), spark.createDataFrame([("c:1",)], "node string"), 3)


@query("""SELECT id, CASE type WHEN 'FILE' THEN name WHEN 'FUNCTION' THEN 'a.py::' || name WHEN 'CONCEPT' THEN 'concept::' || lower(name) WHEN 'QUERY' THEN 'q_' || name WHEN 'SESSION' THEN 's_' || name ELSE lower(type) || '::' || name END AS node FROM (
SELECT p_partkey AS id, p_name AS name, ['FILE', 'FUNCTION', 'CONCEPT', 'QUERY', 'SESSION', 'ERROR'][(p_partkey % 6 + 1)::INT] AS type FROM part)""")
def node_ids(spark, d):
    from ..functions.text import node_id

    kinds = F.element_at(F.array(*map(F.lit, ("FILE", "FUNCTION", "CONCEPT", "QUERY", "SESSION", "ERROR"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), kinds.alias("type"), F.col("p_name").alias("name"))
    return rows.select("id", node_id("type", "name", F.when(F.col("type") == "FUNCTION", "a.py")).alias("node"))
