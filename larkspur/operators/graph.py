"""Graph operators over ``edges(src, dst, ...)``: bounded search, paths, ego graphs, degrees, crawl weights, pruning.

Searches keep a frontier and the set of reached nodes apart: each step joins only the frontier with the edges and takes
away what has been reached, so cyclic and dense graphs cost each edge once.  A step's result is a table in the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import node_id
from ..session import written, written_rows
from . import patterns

# Node and edge types.
NODE_TYPES = ("FILE", "FUNCTION", "CLASS", "CONCEPT", "QUERY", "SESSION", "USER_ACTION", "MEMORY", "ERROR")
EDGE_TYPES = ("RELATES_TO", "DEFINED_IN", "CALLED_BY", "CALLS", "QUERIED_WITH", "CO_OCCURS", "IMPORTS", "INHERITS")
# Names that never stand for a concept: functions, common methods, exceptions, special names.
BUILTIN_NAMES = [
    "len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "bytes", "bytearray", "memoryview", "complex", "type", "object", "range",
    "enumerate", "zip", "map", "filter", "reversed", "sorted", "sum", "min", "max", "abs", "round", "pow", "divmod", "open", "print", "input", "repr",
    "hash", "id", "iter", "next", "any", "all", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "callable", "vars", "dir",
    "locals", "globals", "super", "property", "classmethod", "staticmethod", "format", "chr", "ord", "hex", "oct", "bin", "eval", "exec", "append",
    "extend", "insert", "remove", "pop", "clear", "copy", "update", "keys", "values", "items", "get", "setdefault", "join", "split", "rsplit",
    "splitlines", "strip", "lstrip", "rstrip", "replace", "startswith", "endswith", "find", "rfind", "index", "encode", "decode", "upper", "lower",
    "capitalize", "title", "read", "readline", "readlines", "write", "writelines", "close", "seek", "tell", "flush", "fileno", "Exception",
    "BaseException", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "RuntimeError", "StopIteration", "GeneratorExit",
    "OSError", "IOError", "FileNotFoundError", "NotImplementedError", "ImportError", "ModuleNotFoundError", "OverflowError", "ZeroDivisionError",
    "MemoryError", "RecursionError", "NameError", "UnboundLocalError", "PermissionError", "TimeoutError", "__init__", "__new__", "__del__", "__str__",
    "__repr__", "__bytes__", "__len__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__", "__hash__", "__bool__", "__iter__", "__next__",
    "__reversed__", "__contains__", "__getitem__", "__setitem__", "__delitem__", "__enter__", "__exit__", "__call__", "__get__", "__set__", "__add__",
    "__radd__", "__iadd__", "__sub__", "__mul__", "__truediv__", "__class__", "__dict__", "__doc__", "__module__", "__slots__", "__all__", "__name__",
    "__file__", "__spec__", "__path__",
]


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, rel: str | None = None) -> DataFrame:
    """``(node, hops)`` of all nodes within ``depth`` of ``starts(node)``, starts included at 0; ``rel`` limits the edges walked."""
    walk = (edges.where(F.col("rel") == rel) if rel else edges).select("src", "dst")
    reached = written(starts.select("node").distinct().withColumn("hops", F.lit(0)), "bfs")
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(walk, frontier["node"] == walk["src"]).select(F.col("dst").alias("node")).distinct()
        frontier, found = written_rows(step.join(reached, "node", "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        if not found:
            break
        reached = reached.unionByName(frontier)
    return reached


def one(df: DataFrame, node: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(node,)], "node string")


def neighbours(edges: DataFrame, node: str, depth: int = 1, rel: str | None = None) -> DataFrame:
    """Successors within ``depth``, with hops, without the start."""
    return bfs(edges, one(edges, node), depth, rel).where("hops > 0")


def _between(edges: DataFrame, src: str, dst: str, most: int) -> tuple[int, DataFrame] | None:
    """Steps between two nodes and ``(node, ahead, back)``: the nodes halfway with the smallest paths to and from them.

    Both ends search, each time the one with fewer nodes at its edge, by whole steps; the first time that they meet is the
    shortest way, and none is longer than needed to see that.  None where there is no path of up to ``most`` steps.
    """
    ahead = edges.select("src", "dst").distinct()
    walks = (ahead, ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edge = [one(edges, node).select("node", F.array("node").alias("path")) for node in (src, dst)]
    reached, size, steps = [e.select("node") for e in edge], [1, 1], [0, 0]
    if src == dst:
        return 0, edge[0].select("node", F.col("path").alias("ahead"), F.col("path").alias("back"))
    while sum(steps) < most:
        side = int(size[1] < size[0])
        walk, further = walks[side], F.array_append("path", F.col("dst")) if side == 0 else F.array_prepend("path", F.col("dst"))
        step = edge[side].join(walk, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), further.alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(reached[side], "node", "left_anti")
        edge[side], size[side] = written_rows(step, "between")
        if not size[side]:
            return None
        steps[side] += 1
        reached[side] = reached[side].unionByName(edge[side].select("node"))
        met = edge[0].withColumnRenamed("path", "ahead").join(edge[1].withColumnRenamed("path", "back"), "node")
        if not met.isEmpty():
            return sum(steps), met
    return None


def hop_distance(edges: DataFrame, src: str, dst: str, most: int = 10) -> DataFrame:
    """One row ``(src, dst, hops)``; null hops where there is no path of up to ``most`` steps."""
    found = _between(edges, src, dst, most)
    return edges.sparkSession.createDataFrame([(src, dst, found[0] if found else None)], "src string, dst string, hops int")


def shortest_path(edges: DataFrame, src: str, dst: str, most: int = 10) -> DataFrame:
    """One row ``(path, hops)``: the smallest of the shortest paths; none where there is none."""
    found = _between(edges, src, dst, most)
    if found is None:
        return edges.sparkSession.createDataFrame([], "path array<string>, hops int")
    whole = F.concat("ahead", F.slice("back", 2, F.greatest(F.size("back"), F.lit(1))))
    return found[1].agg(F.min(whole).alias("path")).select("path", F.lit(found[0]).alias("hops"))


def ego(nodes: DataFrame, edges: DataFrame, node: str, radius: int = 2, builtins: list[str] = BUILTIN_NAMES, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``radius`` whatever the direction, and the edges among them.

    Concepts named after a builtin are left out of the nodes, their edges stay.  ``max_nodes`` cuts the report to the nearest
    nodes and the edges among them, ``max_edges`` to the edges nearest to the start; without them nothing is left out.
    """
    around = bfs(undirected(edges), one(edges, node), radius)
    inside = edges.join(around.select(F.col("node").alias("src")), "src", "left_semi").join(around.select(F.col("node").alias("dst")), "dst", "left_semi")
    shown = around.join(nodes.withColumnRenamed("id", "node"), "node", "left")
    shown = shown.where(~((F.coalesce(F.col("type"), F.lit("")) == "CONCEPT") & F.regexp_replace("node", "^concept::", "").isin(list(builtins))))
    if max_nodes is not None:
        shown = written(shown.orderBy("hops", "node").limit(max_nodes), "ego")
        for end in ("src", "dst"):
            inside = inside.join(shown.select(F.col("node").alias(end)), end, "left_semi")
    if max_edges is not None:
        hops = lambda end: around.select(F.col("node").alias(end), F.col("hops").alias(f"__{end}"))
        near = inside.join(hops("src"), "src").join(hops("dst"), "dst")
        inside = near.orderBy(F.col("__src") + F.col("__dst"), "src", "dst").limit(max_edges).select(*edges.columns)
    return shown, inside


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``, both directions."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 5, kind: str | None = None) -> DataFrame:
    ranked = nodes.select(F.col("id").alias("node"), "type").join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if kind:
        ranked = ranked.where(F.col("type") == kind)
    return ranked.orderBy(F.desc("degree"), "node").limit(k)


def entry_nodes(edges: DataFrame, k: int = 5) -> DataFrame:
    """Nodes of highest in-degree, concepts aside."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return into.where(~F.col("node").startswith("concept::")).orderBy(F.desc("in_degree"), "node").limit(k)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left_anti")


def cold_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts with one edge at most."""
    known = nodes.where("type = 'CONCEPT'").join(degrees(edges).withColumnRenamed("node", "id"), "id", "left")
    return known.where(F.coalesce("degree", F.lit(0)) <= 1).drop("degree")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id: the first type stays, other attributes take their latest known value by ``seq``."""
    both = old.unionByName(new)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in old.columns if c not in ("id", "type", "seq")]
    return both.groupBy("id").agg(F.min_by("type", "seq").alias("type"), *last, F.max("seq").alias("seq")).select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One edge per ordered pair: the first relation stays, other attributes take their latest known value."""
    both = old.unionByName(new)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in old.columns if c not in ("src", "dst", "rel", "seq")]
    return both.groupBy("src", "dst").agg(F.min_by("rel", "seq").alias("rel"), *last, F.max("seq").alias("seq")).select(*old.columns)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the nodes of ``gone(id)`` are deleted."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def without_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    return without_nodes(nodes, edges, nodes.where((F.col("file") == path) | (F.col("id") == path)).select("id"))


def who_calls(edges: DataFrame, name: str, k: int = 50) -> DataFrame:
    """Callers of a function: what its node is linked to by CALLED_BY, else the sources of CALLS edges into it."""
    target = (F.col("dst") == f"symbol::{name}") | F.col("dst").endswith(f"::{name}")
    source = (F.col("src") == f"symbol::{name}") | F.col("src").endswith(f"::{name}")
    callers = edges.where(source & (F.col("rel") == "CALLED_BY")).select(F.col("dst").alias("caller"), "rel")
    direct = edges.where(target & (F.col("rel") == "CALLS")).select(F.col("src").alias("caller"), "rel")
    return callers.unionByName(direct).groupBy("caller").agg(F.min("rel").alias("rel")).orderBy("caller").limit(k)


def textual_callers(lines: DataFrame, name: str) -> DataFrame:
    """Lines that mention a function other than to define it: the fallback for dynamic calls."""
    import re

    word = rf"\b{re.escape(name)}\b"
    return lines.where(F.col("line").rlike(word) & ~F.col("line").rlike(rf"^\s*(async\s+)?(def|class)\s+{re.escape(name)}\b"))


def imports(symbols: DataFrame) -> DataFrame:
    """File dependencies ``(src, dst)``: a symbol of ``src`` calls a name that ``dst`` defines."""
    calls = symbols.select(F.col("file").alias("src"), F.explode("calls").alias("name")).distinct()
    defined = symbols.select("name", F.col("file").alias("dst")).distinct()
    return calls.join(defined, "name").where("src <> dst").select("src", "dst").distinct()


def transitive(deps: DataFrame, module: str, direction: str = "imports", depth: int = 2) -> DataFrame:
    """``(node, hops)`` of direct and indirect dependencies up to ``depth`` steps; none for a depth of 1 or less."""
    if direction not in ("imports", "imported_by"):
        raise ValueError(f"direction must be imports or imported_by: {direction}")
    walk = deps if direction == "imports" else deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = bfs(walk, one(deps, module), depth if depth > 1 else 0)
    return found.where("hops > 0")


def resolve_module(files: DataFrame, module: str) -> DataFrame:
    """Files that a module name may mean: an exact path, else paths that end in it; one row means it is unique."""
    exact = files.where(F.col("path") == module).select("path")
    return exact if not exact.isEmpty() else files.where(F.col("path").endswith(f"/{module}")).select("path").orderBy("path")


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """Edges that an index run adds: where symbols are defined, what they call and are called by, what they inherit."""
    me = node_id("type", "name", "file")
    defined = symbols.select(me.alias("src"), F.col("file").alias("dst"), F.lit("DEFINED_IN").alias("rel"), F.lit(1.0).alias("weight"))
    to = lambda c: symbols.select(me.alias("src"), F.explode(F.transform(c, lambda n: F.concat(F.lit("symbol::"), n))).alias("dst"))
    calls = to("calls")
    bases = to("bases").withColumn("rel", F.lit("INHERITS")).withColumn("weight", F.lit(1.0))
    called = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CALLED_BY").alias("rel"), F.lit(1.0).alias("weight"))
    return defined.unionByName(calls.withColumn("rel", F.lit("CALLS")).withColumn("weight", F.lit(1.0))).unionByName(called).unionByName(bases).distinct()


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, dst)`` from ``(file, module)``: the module's file, else its package's ``__init__.py``."""
    base = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    wanted = found.select(F.col("file").alias("src"), F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("rank", "path"))
    hit = wanted.join(files.select("path"), "path")
    return hit.groupBy("src", F.regexp_replace("path", r"(/__init__)?\.py$", "").alias("m")).agg(F.min_by("path", "rank").alias("dst")).select("src", "dst")


def crawl_weights(files: DataFrame, deps: DataFrame, entries: DataFrame, depth: int = 50) -> DataFrame:
    """``(path, weight)``: 1 for entry points and their imports, 0.75 one step on, 0.5 beyond and where nothing leads."""
    hops = bfs(deps, entries.select(F.col("path").alias("node")), depth).withColumnRenamed("node", "path")
    weight = F.when(F.col("hops") <= 1, F.lit(1.0)).when(F.col("hops") == 2, F.lit(0.75)).otherwise(F.lit(0.5))
    return files.select("path").join(hops, "path", "left").select("path", weight.alias("weight"))


# File names that start programs.
ENTRY_NAMES = [
    "__main__.py", "main.py", "app.py", "manage.py", "run.py", "server.py", "cli.py", "start.py", "wsgi.py", "asgi.py", "main.go", "main.rs",
    "index.js", "index.ts", "index.mjs", "server.js", "server.ts", "app.js", "app.ts", "main.js", "main.ts", "Main.java", "Application.java",
    "App.java", "main.rb", "app.rb", "config.ru",
]


def entry_points(files: DataFrame) -> DataFrame:
    """Files with an entry name or ``cmd/*/main.go``; without any, the top-level Python files."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(name.isin(ENTRY_NAMES) | F.col("path").rlike(r"^cmd/[^/]+/main\.go$")).select("path")
    return found if not found.isEmpty() else files.where(~F.col("path").contains("/") & F.col("path").endswith(".py")).select("path")


# ── repositories of an organisation ─────────────────────────────────────────────────────────────────────────────────

# Kinds of links between repositories.
ORG_KINDS = ("IMPORTS", "CALLS_API", "SHARES_SCHEMA", "CHILD_OF", "DISCOVERED")


def org_links(links: DataFrame) -> DataFrame:
    """Links with their reverse and direction; links to itself are dropped."""
    forward = links.where("src <> dst").withColumn("direction", F.lit("forward"))
    back = forward.withColumn("s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("s")).drop("s").withColumn("direction", F.lit("reverse"))
    return forward.unionByName(back)


def org_unlink(links: DataFrame, src: str, dst: str) -> DataFrame:
    return links.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def dependencies(links: DataFrame, repo: str, depth: int = 2, dependents: bool = False) -> DataFrame:
    walk = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if dependents else links
    return bfs(walk, one(links, repo), depth).where("hops > 0")


def children(repos: DataFrame, parent: str) -> DataFrame:
    return repos.where(F.col("parent") == parent).select("path", "name").orderBy("path")


def siblings(repos: DataFrame, path: str) -> DataFrame:
    mine = repos.where(F.col("path") == path).select("parent")
    return repos.join(mine, "parent", "left_semi").where(F.col("path") != path).select("path", "name").orderBy("path")


def roots(repos: DataFrame) -> DataFrame:
    known = repos.select(F.col("path").alias("parent")).distinct()
    return repos.join(known, "parent", "left_anti").select("path", "name").orderBy("path")


def match_packages(packages: DataFrame, repos: DataFrame) -> DataFrame:
    """``(package, path)``: the repository of the same normalised name, else the first whose name holds it or is held by it.

    Only names without an equal partner take the substring search, by their grams (``patterns.holding``).
    """
    names = F.regexp_replace(F.lower("package"), "[-_.]+", "-")
    repo = written(repos.select("path", F.regexp_replace(F.lower("name"), "[-_.]+", "-").alias("repo")), "repos")
    left = packages.select("package", names.alias("norm")).distinct()
    equal = left.join(repo, left["norm"] == repo["repo"]).groupBy("package").agg(F.min("path").alias("path"))
    rest = written(left.join(equal, "package", "left_anti"), "packages")
    held = patterns.holding(rest, repo, "package", "norm", "repo").join(repo, F.col("pattern") == F.col("repo")).select(F.col("id").alias("package"), "path")
    holds = patterns.holding(repo, rest, "path", "repo", "norm").join(rest, F.col("pattern") == F.col("norm")).select("package", F.col("id").alias("path"))
    return equal.unionByName(held.unionByName(holds).groupBy("package").agg(F.min("path").alias("path")))


def inferred_links(imported: DataFrame, repos: DataFrame) -> DataFrame:
    """``(src, dst)`` where a module's first part is the name of another repository."""
    first = imported.select(F.col("repo").alias("src"), F.lower(F.split("module", r"\.")[0]).alias("name")).distinct()
    known = repos.select(F.col("path").alias("dst"), F.lower("name").alias("name"))
    return first.join(known, "name").where("src <> dst").select("src", "dst").distinct()


def traverse(links: DataFrame, symbols: DataFrame, repo: str, direction: str = "both", depth: int = 2, k: int = 100) -> DataFrame:
    """Repositories around one, with hops and their symbols of interest."""
    walk = {"forward": links, "reverse": links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": undirected(links)}[direction]
    near = bfs(walk, one(links, repo), depth).where("hops > 0").withColumnRenamed("node", "repo")
    named = symbols.groupBy("repo").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    return near.join(named, "repo", "left").orderBy("hops", "repo").limit(k)


def purge(repos: DataFrame, existing: DataFrame) -> DataFrame:
    return repos.join(existing.select("path"), "path", "left_semi")


def describe(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of text: a bounded subgraph's nodes and relations, line by line."""
    hops = F.when(F.col("hops").isNotNull(), F.concat(F.lit("  ("), F.col("hops"), F.lit(" hop"), F.when(F.col("hops") != 1, "s").otherwise(""), F.lit(" away)"))).otherwise("")
    node = nodes.select(F.lit(0).alias("part"), F.col("node").alias("key"), F.concat(F.lit("  "), "node", F.lit(" ["), F.coalesce("type", F.lit("?")), F.lit("]"), hops).alias("line"))
    edge = edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("key"), F.concat(F.lit("  "), "src", F.lit(" --"), "rel", F.lit("--> "), "dst").alias("line"))
    parts = node.unionByName(edge).groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "key", "line"))).alias("x"))
    pick = lambda p: F.transform(F.filter("x", lambda r: r["part"] == p), lambda r: r["line"])
    block = lambda p, head: F.when(F.size(pick(p)) > 0, F.array_join(F.concat(F.array(F.lit(head)), pick(p)), "\n"))
    text = F.concat_ws("\n", block(0, "Graph nodes:"), block(1, "Relationships:"))
    return parts.select(F.when(text == "", "(empty graph)").otherwise(text).alias("text"))


def memory_links(memories: DataFrame) -> DataFrame:
    """Edges from memories to the concepts that their texts name."""
    from ..functions.text import entities

    return memories.select(F.concat(F.lit("memory::"), "row_id").alias("src"), F.explode(F.transform(entities("text"), lambda e: F.concat(F.lit("concept::"), F.lower(e)))).alias("dst"), F.lit("RELATES_TO").alias("rel"), F.lit(0.8).alias("weight")).distinct()


def best_hops(edges: DataFrame, starts: DataFrame, depth: int = 6) -> DataFrame:
    """``(node, hops)``: along the edges where a path leads there, otherwise whatever the direction."""
    ahead = bfs(edges, starts, depth)
    around = bfs(undirected(edges), starts, depth)
    return around.withColumnRenamed("hops", "any").join(ahead, "node", "left").select("node", F.coalesce("hops", "any").alias("hops"))


def ranked(df: DataFrame, key: str, order: list, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
