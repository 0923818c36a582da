"""Many patterns in many texts, lines in symbols, ways between nodes, equal queries at once."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph, hybrid, memory, patterns, text_search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holding(spark):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choices("abß🙂-", k=n))
    texts = [(i, word(draw.randint(0, 40))) for i in range(200)] + [(500, None), (501, ""), (502, "aaa" * 4000 + "zz"), (502, "aaa" * 4000 + "zz"), (None, "ab-ab")]
    some = [*{word(draw.randint(0, 6)) for _ in range(60)}, None, "aaz", "zz", "never there"]
    got = patterns.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in some] * 2, "pattern string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, {(i, p) for i, t in texts for p in some if t is not None and p is not None and p in t}))
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    none = spark.createDataFrame([], "pattern string")
    assert patterns.holding(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


def test_stale_marks_and_packages_without_nested_loops(spark):
    events = spark.createDataFrame([(str(i), f"edit src/f{i % 7}.py", {"at": f"lib/g{i}.go"}, None, None) for i in range(40)], "id string, event string, metadata map<string,string>, stale boolean, stale_reason string")
    marked = memory.mark_stale_any(events, spark.createDataFrame([("src/f3.py",), ("lib/g5.go",), ("x",)], "path string"))
    assert {r["id"] for r in marked.where("stale").collect()} == {str(i) for i in range(40) if i % 7 == 3 or i == 5}
    assert {r["id"] for r in memory.newly_stale(marked, spark.createDataFrame([("src/f3.py",), ("lib/g6.go",)], "path string")).collect()} == {"6"}
    repos = spark.createDataFrame([("/r/a", "Alpha.Core"), ("/r/b", "beta"), ("/r/c", "gamma-tools")], "path string, name string")
    packages = spark.createDataFrame([("alpha_core",), ("my-beta-x",), ("gamma",), ("delta",)], "package string")
    found = graph.match_packages(packages, repos)
    assert {r["package"]: r["path"] for r in found.collect()} == {"alpha_core": "/r/a", "my-beta-x": "/r/b", "gamma": "/r/c"}
    for df in (marked, found):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_innermost_symbol(spark):
    draw = random.Random(9)
    symbols = [(f"f{draw.randint(0, 3)}", f"s{i}", start, start + draw.choice([-1, 0, 1, 5, 40, 300])) for i in range(120) for start in [draw.randint(0, 300)]]
    lines = [(f"f{i % 5}", line) for i in range(5) for line in range(0, 640, 3)]
    got = text_search.containing_symbol(spark.createDataFrame(lines + lines[:9], "file string, line int"), spark.createDataFrame(symbols, "file string, name string, start_line int, end_line int"))
    want = {}
    for file, line in lines:
        inside = [(-s, e, n) for f, n, s, e in symbols if f == file and s <= line <= e]
        if inside:
            want[file, line] = min(inside)[2]
    assert {(r["file"], r["line"]): r["name"] for r in got.collect()} == want and got.count() == len(want)
    # one file of many symbols, nested within one that spans it
    many = spark.range(100_000).selectExpr("'big' AS file", "concat('s', id) AS name", "cast(id * 10 + 1 AS int) AS start_line", "cast(id * 10 + 8 AS int) AS end_line")
    whole = spark.createDataFrame([("big", "whole", 1, 1_000_000)], many.schema)
    at = spark.range(0, 1_000_000, 7).selectExpr("'big' AS file", "cast(id + 1 AS int) AS line")
    found = text_search.containing_symbol(at, many.unionByName(whole))
    wrong = found.where(F.col("name") != F.when((F.col("line") - 1) % 10 < 8, F.concat(F.lit("s"), F.floor((F.col("line") - 1) / 10))).otherwise("whole"))
    assert wrong.isEmpty() and found.count() == at.count()
    assert text_search.containing_symbol(at, many.limit(0)).count() == 0


def brute_paths(edges, src, most):
    best, layer = {src: [src]}, {src: [src]}
    for _ in range(most):
        step = {}
        for a, b in sorted(edges):
            if a in layer and b not in best:
                path = [*layer[a], b]
                step[b] = min(step.get(b, path), path)
        best |= step
        layer = step
    return best


def test_ways_between_nodes(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(f"n{draw.randint(0, 40):02}", f"n{draw.randint(0, 40):02}") for _ in range(70)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for src, dst in [("n00", "n01"), ("n05", "n09"), ("n10", "n33"), ("n07", "n07"), ("n02", "none"), ("n20", "n04")]:
        want = brute_paths(edges, src, 6).get(dst)
        got = graph.shortest_path(df, src, dst, 6).collect()
        assert [(r["path"], r["hops"]) for r in got] == ([(want, len(want) - 1)] if want else [])
        assert graph.hop_distance(df, src, dst, 6).first()["hops"] == (len(want) - 1 if want else None)
    # a hub with a long tail: the search from the end needs no look at the hub's neighbours
    star = spark.createDataFrame([("hub", f"x{i}") for i in range(500)] + [("hub", "t1"), ("t1", "t2"), ("t2", "t3")], "src string, dst string")
    written = []
    real = graph.written_rows
    monkeypatch.setattr(graph, "written_rows", lambda df, name: (lambda out: (written.append(out[1]), out)[1])(real(df, name)))
    assert graph.hop_distance(star, "hub", "t3").first()["hops"] == 3 and len(written) == 3 and sum(written) <= 504
    written.clear()
    assert graph.hop_distance(star, "t3", "hub").first()["hops"] is None and len(written) == 1


def test_equal_queries_run_once():
    cache, runs, begun = hybrid.ResultCache(10), [], threading.Event()

    class Plan:
        def collect(self):
            runs.append(1)
            begun.set()
            time.sleep(0.3)
            return ["row"]

    class Broken:
        def collect(self):
            raise OSError("lost")

    out = []
    threads = [threading.Thread(target=lambda: out.append(cache.get("q", 1, Plan, 0.0))) for _ in range(6)]
    for t in threads:
        t.start()
    begun.wait(5)
    cache.get("other", 1, Plan, 0.0)
    for t in threads:
        t.join()
    assert out == [["row"]] * 6 and len(runs) == 2
    with pytest.raises(OSError, match="lost"):
        cache.get("bad", 1, Broken, 0.0)
    assert cache.get("bad", 1, Plan, 0.0) == ["row"] and len(runs) == 3


def test_ego_reports_all_or_the_nearest(spark):
    edges = spark.createDataFrame([("hub", f"a{i:03}") for i in range(300)] + [("a000", "b"), ("b", "c")], "src string, dst string")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("type", F.lit("FILE"))
    shown, inside = graph.ego(nodes, edges, "hub", 2)
    assert shown.count() == 302 and inside.count() == 301
    shown, inside = graph.ego(nodes, edges, "hub", 2, max_nodes=10, max_edges=5)
    names = {r["node"] for r in shown.collect()}
    assert len(names) == 10 and "hub" in names and inside.count() == 5 and all(r["src"] in names and r["dst"] in names for r in inside.collect())
