"""Operators on small fixtures: the cases that the tables don't hold."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import rules, scores
from larkspur.functions import text as T
from larkspur.operators import behaviour, chunking, graph, hybrid, indexing, memory, metrics, ordered, packing, text_search, vector
from larkspur.sources import files, git, sinks
from larkspur.sources.commits import Stores

AT = dt.datetime(2024, 1, 10)


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


# ── text search ─────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def herons(spark):
    return spark.createDataFrame([("d1", "nine reeds away a heron waits for the ferry at dawn"), ("d2", "one copper kettle sang"), ("d3", "heron after heron came"), ("d4", None)], "doc_id string, text string")


@pytest.mark.parametrize(("query", "k", "ids"), [("heron", 10, ["d3", "d1"]), ("heron", 1, ["d3"]), ("", 5, []), ("heron", 0, []), ("walrus", 5, []), ("heron HERON", 10, ["d3", "d1"]), ("kettle dawn", 99, ["d2", "d1"])])
def test_bm25(herons, query, k, ids, tmp_path):
    index = text_search.TextIndex.build(herons, str(tmp_path / "index"))
    found = text_search.bm25(herons, query, k).collect()
    assert [tuple(r) for r in index.search(query, k).collect()] == [tuple(r) for r in found]
    assert [r["doc_id"] for r in found] == ids
    assert all(r["score"] > 0 for r in found)


def test_bm25_empty_corpus(herons):
    assert text_search.bm25(herons.limit(0), "heron").collect() == []


def test_bm25_plus_needs_a_known_term(herons):
    assert text_search.bm25_plus(herons, "walrus").collect() == []
    assert text_search.bm25_plus(herons, "heron").first()["doc_id"] == "d3"


@pytest.mark.parametrize("query", ["heron", "heron dawn heron", "walrus", "the walrus waits", ""])
def test_index_ranks_by_bm25_plus_too(herons, query, tmp_path):
    index = text_search.TextIndex.build(herons, str(tmp_path / "index"), unicode_words=True)
    for k in (1, 10):
        assert [tuple(r) for r in index.search_plus(query, k).collect()] == [tuple(r) for r in text_search.bm25_plus(herons, query, k).collect()]


def test_index_reads_the_terms_of_a_query_only(herons, tmp_path):
    found = text_search.TextIndex.build(herons, str(tmp_path / "index")).search("heron dawn")
    plan = herons.sparkSession._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[.*In\(term, \[(dawn,heron|heron,dawn)\]\)", plan)


def test_order_without_one_task(spark):
    rows = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50))).repartition(7)
    got = ordered.numbered(rows, ["v", "id"]).orderBy("place").collect()
    want = sorted((r["v"], r["id"]) for r in rows.collect())
    assert [(r["v"], r["id"]) for r in got] == want and [r["place"] for r in got] == list(range(1, 1001))
    prev = {r["id"]: r["prev"] for r in ordered.previous(rows, ["v", "id"], "id").collect()}
    assert [prev[i] for _, i in want] == [None, *(i for _, i in want[:-1])]
    assert tuple(metrics.percentiles(rows, "id").first()) == (500, 950, 990)
    events = spark.createDataFrame([(i, AT + dt.timedelta(seconds=-i)) for i in range(20)], "id int, time timestamp")
    assert {r["id"]: r["prev"] for r in memory.with_previous(events).collect()} == {i: i + 1 if i < 19 else None for i in range(20)}
    assert ordered.numbered(rows.limit(0), ["id"]).count() == 0


def test_grep_context(spark):
    docs = spark.createDataFrame([(1, "a\nb\nNeedle\nd\ne\nf"), (2, "needle")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in text_search.grep(docs, "needle").collect()}
    assert got[1]["n"] == 3 and got[1]["context"] == "a\nb\nNeedle\nd\ne"
    assert got[2]["context"] == "needle"
    assert docs.select(text_search.window_around(docs, F.lit(3), 1).alias("w")).first()["w"] == "b\nNeedle\nd"


def test_lookups(spark):
    symbols = spark.createDataFrame([("Foo", "a.py", 1), ("bar", "b.py", 2)], "name string, file string, start_line int")
    assert text_search.lookup(symbols, "foo").isEmpty()
    assert text_search.lookup(symbols, "foo", ignore_case=True).count() == 1
    index = spark.createDataFrame([("word", "c.py", 3)], "word string, file string, line int")
    assert text_search.lookup_word(index, symbols, "word").first()["file"] == "c.py"
    assert text_search.lookup_word(index, symbols, "bar").first()["line"] == 2
    docs = spark.createDataFrame([("a.py", "x"), ("z.md", "y")], "file string, text string")
    assert text_search.fast_path(docs, text_search.reverse_index(symbols), "Foo").first()["file"] == "a.py"


def test_text_functions(spark):
    assert one(spark, T.identifier_tokens("n"), n="parseHTTPRequest_fooBar2baz") == ["parse", "httprequest", "foo", "bar", "baz"]
    assert one(spark, T.text_terms("n"), n="The parse_tree (self) returns len of Values 42") == ["parse", "tree", "returns", "values"]
    assert one(spark, T.entities("n"), n="see AuthHandler in auth/core.py, call verify_token.") == ["AuthHandler", "auth", "handler", "auth/core.py", "verify_token"]
    assert one(spark, T.first_sentence("n"), n="'Reads it. Then more") == "Reads it."
    assert one(spark, T.call_purpose("n"), n="fetchAll") == "fetches" and one(spark, T.call_purpose("n"), n="zap") == "calls"
    assert one(spark, T.clean_package("n"), n="My_Pkg[extra]>=1.0") == "my-pkg"
    assert one(spark, T.token_estimate("n"), n="abc") == 1


# ── vectors ─────────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist(), "memory" if i % 2 else None, i == 3, None, 0.5, i / 60) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>, source string, deprecated boolean, suppressed boolean, importance double, behaviour_score double"), v


def test_knn_filters_before_the_cut(vectors):
    df, v = vectors
    got = [r["row_id"] for r in vector.knn(vector.of_source(vector.live(df), "memory"), v[3].tolist(), 60).collect()]
    assert 3 not in got and len(got) == 59
    assert [r["row_id"] for r in vector.knn(df, v[3].tolist(), 1).collect()] == [3]


def test_knn_join_matches_knn(vectors):
    df, v = vectors
    got = vector.knn_join(df.where("row_id < 5").withColumnRenamed("row_id", "query_id"), df, 4, block=16).collect()
    for i in range(5):
        d2 = ((v - v[i]) ** 2).sum(1)
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["place"])] == np.argsort(d2, kind="stable")[:4].tolist()


def test_greedy_novelty_depends_on_order(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, g int, embedding array<double>")
    assert sorted(r[0] for r in vector.greedy_novel(df, "g").collect()) == [1, 3]


def test_near_join_finds_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    vectors = (centres[np.arange(1200) % 40] + 0.08 * rng.normal(size=(1200, 16))).tolist()
    vectors += [vectors[0]] * 60  # copies, more than a block
    monkeypatch.setattr(vector, "NEAR_ROWS", 25)
    monkeypatch.setattr(vector, "NEAR_QUERIES", 10)
    monkeypatch.setattr(vector, "PIVOTS", 60)
    rows = spark.createDataFrame([*enumerate(vectors), (5000, None)], "row_id long, embedding array<double>").repartition(3)
    asked = rows.where("row_id % 10 = 0").withColumnRenamed("row_id", "query_id")
    for radius in (0.3, 0.55):
        got = {(r["query_id"], r["row_id"]) for r in vector.near_join(asked, rows, radius).collect()}
        a = np.array(vectors)
        d2 = ((a[::10][:, None] - a[None]) ** 2).sum(2)
        assert got == {(int(10 * i), int(j)) for i, j in zip(*np.nonzero(d2 <= radius**2), strict=True)}
    # what is compared: rows that probes meet in their rings, against all pairs
    seen = []
    real = vector.written
    monkeypatch.setattr(vector, "written", lambda df, name: (seen.append((name, out := real(df, name))), out)[1])
    vector.near_join(asked, rows, 0.3)
    placed, probes = dict(seen)["placed"], dict(seen)["probes"]
    compared = placed.groupBy("list", "ring").agg(F.count("*").alias("n")).join(probes.groupBy("list", "ring").agg(F.count("*").alias("m")), ["list", "ring"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert compared < 0.15 * asked.count() * rows.count()
    assert vector.near_join(asked, rows.limit(0), 0.3).count() == 0 and vector.near_join(asked.limit(0), rows, 0.3).count() == 0



def test_embed_is_deterministic(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "id long, text string")
    a = [r["embedding"] for r in vector.embed(df, "text").orderBy("id").collect()]
    assert len(a[0]) == 64 and abs(sum(x * x for x in a[0]) - 1) < 1e-5 and set(a[1]) == {0.0}


def test_weights_are_checked():
    with pytest.raises(ValueError, match="sum to 1"):
        scores.check_weights({"vector": 0.5, "graph": 0.5, "behaviour": 0.5})


# ── graph ───────────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def abc(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", 1.0, 1), ("b", "c", "IMPORTS", 1.0, 2), ("c", "a", "CALLS", 1.0, 3), ("x", "y", "CALLS", 1.0, 4)], "src string, dst string, rel string, weight double, seq long")
    nodes = spark.createDataFrame([(n, "FUNCTION", None, 1) for n in "abcxyz"], "id string, type string, file string, seq long")
    return nodes, edges


def test_graph_walks(abc):
    nodes, edges = abc
    assert graph.hop_distance(edges, "a", "c").first()["hops"] == 2
    assert graph.hop_distance(edges, "a", "y").first()["hops"] is None
    assert graph.shortest_path(edges, "a", "c").first()["path"] == ["a", "b", "c"]
    assert graph.shortest_path(edges, "a", "y").isEmpty()
    assert {r["node"] for r in graph.neighbours(edges, "a", 5, "CALLS").collect()} == {"b"}
    assert [r["id"] for r in graph.orphans(nodes, edges).collect()] == ["z"]
    text = graph.describe(*graph.ego(nodes, edges, "a", 1)).first()["text"]
    assert text.startswith("Graph nodes:\n  a [FUNCTION]  (0 hops away)") and "a --CALLS--> b" in text
    assert graph.describe(*graph.ego(nodes.limit(0), edges.limit(0), "q", 1)).first()["text"].startswith("Graph nodes:")


def test_upserts(spark, abc):
    nodes, edges = abc
    new = spark.createDataFrame([("a", "b", "INHERITS", 9.0, 10)], "src string, dst string, rel string, weight double, seq long")
    row = graph.upsert_edges(edges, new).where("src = 'a'").first()
    assert (row["rel"], row["weight"]) == ("CALLS", 9.0)
    row = graph.upsert_nodes(nodes, spark.createDataFrame([("a", "CLASS", "f.py", 9)], nodes.schema)).where("id = 'a'").first()
    assert (row["type"], row["file"]) == ("FUNCTION", "f.py")


def test_dependencies(spark):
    symbols = spark.createDataFrame([("src/auth/auth.py", "verify", ["decode"]), ("src/auth/jwt.py", "decode", ["load"]), ("c.py", "load", [])], "file string, name string, calls array<string>")
    deps = graph.imports(symbols)
    assert {r["node"] for r in graph.transitive(deps, "src/auth/auth.py", depth=3).collect()} == {"src/auth/jwt.py", "c.py"}
    assert graph.transitive(deps, "src/auth/auth.py", depth=1).isEmpty()
    assert graph.resolve_module(symbols.select(F.col("file").alias("path")), "jwt.py").first()["path"] == "src/auth/jwt.py"
    with pytest.raises(ValueError, match="direction"):
        graph.transitive(deps, "a", "sideways")


def test_import_resolution_and_entries(spark):
    paths = spark.createDataFrame([("a/b.py",), ("a/c/__init__.py",), ("cmd/x/main.go",), ("lib.py",)], "path string")
    found = spark.createDataFrame([("lib.py", "a.b"), ("lib.py", "a.c"), ("lib.py", "nope")], "file string, module string")
    assert {(r["src"], r["dst"]) for r in graph.resolve_imports(found, paths).collect()} == {("lib.py", "a/b.py"), ("lib.py", "a/c/__init__.py")}
    assert [r["path"] for r in graph.entry_points(paths).collect()] == ["cmd/x/main.go"]
    assert [r["path"] for r in graph.entry_points(paths.where("path not like 'cmd%'")).collect()] == ["lib.py"]


def test_symbol_edges_and_repositories(spark):
    s = spark.createDataFrame([("a.py", "f", "FUNCTION", ["g"], [], 1), ("a.py", "C", "CLASS", [], ["B"], 2)], "file string, name string, type string, calls array<string>, bases array<string>, start_line int")
    got = {(r["src"], r["dst"], r["rel"]) for r in graph.symbol_edges(s).collect()}
    assert ("a.py::f", "symbol::g", "CALLS") in got and ("symbol::g", "a.py::f", "CALLED_BY") in got and ("a.py::C", "symbol::B", "INHERITS") in got
    notes = spark.createDataFrame([(1, "see parse_tree")], "row_id long, text string")
    assert [tuple(r)[:3] for r in graph.memory_links(notes).collect()] == [("memory::1", "concept::parse_tree", "RELATES_TO")]
    repos = spark.createDataFrame([("/r/a", "a", None), ("/r/b", "b-lib", "/r/a")], "path string, name string, parent string")
    imported = spark.createDataFrame([("/r/b", "A.x"), ("/r/a", "a.y")], "repo string, module string")
    assert [(r["src"], r["dst"]) for r in graph.inferred_links(imported, repos).collect()] == [("/r/b", "/r/a")]
    assert [r["path"] for r in graph.purge(repos, repos.where("name = 'a'")).collect()] == ["/r/a"]
    links = spark.createDataFrame([("/r/a", "/r/b"), ("/r/a", "/r/a")], "src string, dst string")
    assert graph.org_links(links).count() == 2 and graph.org_unlink(links, "/r/a", "/r/b").count() == 1
    named = spark.createDataFrame([("/r/b", "f"), ("/r/b", "e")], "repo string, name string")
    assert graph.traverse(links, named, "/r/a", "forward").first()["symbols"] == ["e", "f"]
    lines = spark.createDataFrame([("x.py", 1, "def go():"), ("x.py", 2, "  call(go)")], "file string, n int, line string")
    assert [r["n"] for r in graph.textual_callers(lines, "go").collect()] == [2]
    assert graph.without_file(*[spark.createDataFrame([("a", "T", "f.py", 1)], "id string, type string, file string, seq long"), spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, rel string")], "f.py")[1].isEmpty()


# ── hybrid, behaviour, memory ───────────────────────────────────────────────────────────────────────────────────────


def test_retrieve_end_to_end(spark):
    memories = spark.createDataFrame([(1, "remember the parser", "memory", 0.5, [1.0, 0.0], False)], "row_id long, text string, source string, importance double, embedding array<double>, deprecated boolean")
    symbols = spark.createDataFrame([("a.py", "parse_tree", "FUNCTION", 3, "Parses.")], "file string, name string, type string, start_line int, docstring string")
    sv = symbols.withColumn("row_id", F.lit(7).cast("long")).withColumn("source", F.lit("symbol")).withColumn("weight", F.lit(1.0)).withColumn("embedding", F.array(F.lit(0.8), F.lit(0.6)))
    edges = spark.createDataFrame([("symbol::parse_tree", "a.py::parse_tree", "CALLS")], "src string, dst string, rel string")
    counts = spark.createDataFrame([("a.py::parse_tree", 4)], "symbol string, n long")
    got = hybrid.retrieve(memories, symbols, sv, edges, counts, [1.0, 0.0], ["parse_tree"]).collect()
    top = got[0]
    assert top["id"] == "a.py::parse_tree" and top["text"] == "FUNCTION parse_tree in a.py:3 — Parses."
    assert top["final_score"] == pytest.approx(0.5 * 0.8 + 0.3 * 0.5 + 0.2, abs=1e-3)
    assert not hybrid.low_confidence(hybrid.merge(hybrid.from_names(symbols, ["parse_tree"])).withColumn("final_score", F.lit(0.1)), "what is it").first()["low"]
    assert hybrid.symbol_search(sv, [1.0, 0.0], extensions=[".go"]).isEmpty()
    with pytest.raises(ValueError, match="characters"):
        hybrid.guard("x" * 50_001)


def test_cold_fallback(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, final_score double")
    assert {r["cold_fallback"] for r in hybrid.with_least(df, 0.5).collect()} == {True}
    assert [r["id"] for r in hybrid.with_least(df, 0.15).collect()] == ["b"]


def test_result_cache(herons):
    cache, calls = hybrid.ResultCache(10), []

    def make():
        calls.append(1)
        return herons

    assert cache.get("q", 1, make, 0.0) == cache.get("q", 1, make, 5.0) and len(calls) == 1
    cache.get("q", 1, make, 11.0)
    cache.clear()
    cache.get("q", 1, make, 11.0)
    assert len(calls) == 3


def test_episodes(spark):
    rows = [(f"e_{i}", e, {"k": v}, AT + dt.timedelta(hours=i), None, None) for i, (e, v) in enumerate([("login", "authentication JWT"), ("edit", "src/a.py"), ("error", "db")])]
    events = spark.createDataFrame(rows, "id string, event string, metadata map<string,string>, time timestamp, stale boolean, stale_reason string")
    assert memory.search(events, "authentication JWT").first()["id"] == "e_0"
    assert memory.search(events, "nothing").isEmpty()
    assert memory.search(events, "login edit error", 10, AT + dt.timedelta(minutes=30), AT + dt.timedelta(minutes=90)).collect()[0]["id"] == "e_1"
    assert memory.search_plus(events, "authentication").first()["id"] == "e_0"
    assert memory.search_plus(events, "zzz", embedder=vector.hashing_embedder).count() >= 0
    once = memory.mark_stale(events, "src/a.py")
    assert [r["id"] for r in once.where("stale").collect()] == ["e_1"]
    assert memory.mark_stale(once, "src/a.py", "again").where("stale_reason = 'again'").isEmpty()
    kept, old = memory.rotate(events, 3)
    assert (kept.count(), old.first()["id"]) == (2, "e_0")


def test_learnings(spark):
    rows = [("1", "decision", "project", "use the broker for jobs", AT, False, None), ("2", "correction", "global", "never use the broker", AT - dt.timedelta(days=9), False, None), ("3", "decision", "project", "old plan", AT, True, None), ("4", "prod_issue", "project", "outage of the broker", AT, False, "1")]
    df = spark.createDataFrame(rows, "id string, type string, scope string, text string, timestamp timestamp, deprecated boolean, supersedes string")
    assert sorted(r["id"] for r in memory.current(df).collect()) == ["2", "4"]
    assert memory.retrieve(df, "broker", F.lit(AT), types=["decision"]).first()["id"] == "1"
    assert [r["id"] for r in memory.injected(df).collect()] == ["4", "2"]
    assert memory.conflicts(df, "use the broker").first()["id"] == "1"
    new = spark.createDataFrame([("5", "x")], "id string, text string")
    assert "1" not in {r["id"] for r in memory.current(memory.supersede(df, "1", new)).collect()}


def test_retention(spark):
    rows = [(1, 0.9, AT - dt.timedelta(days=1), False, False, None, None), (2, 0.9, AT - dt.timedelta(days=40), False, True, None, None), (3, 0.5, None, False, False, None, None)]
    df = spark.createDataFrame(rows, "row_id long, importance double, created_at timestamp, deprecated boolean, suppressed boolean, suppress_reason string, suppressed_at timestamp")
    kept, gone = memory.prune(df, F.lit(AT))
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 3] and gone.first()["row_id"] == 2
    assert memory.dead_share(df).first()["rebuild"]
    marks = spark.createDataFrame([(1, "copy")], "row_id long, reason string")
    assert memory.suppress(df, marks, F.lit(AT)).where("row_id = 1").first()["suppress_reason"] == "copy"
    assert memory.with_tombstones(df, marks).count() == 2
    assert [r["row_id"] for r in memory.compact(df).orderBy("row_id").collect()] == [0, 1]
    assert memory.storable(spark.createDataFrame([("x" * 60, 0.4), ("x", 0.9), ("x" * 60, 0.1)], "text string, importance double")).count() == 1


def test_sessions(spark):
    s = spark.createDataFrame([("abc1", AT, None), ("abd2", AT + dt.timedelta(1), AT)], "session_id string, created_at timestamp, closed_at timestamp")
    assert memory.find_session(s, "abc").first()["session_id"] == "abc1"
    assert memory.find_session(s, "ab").isEmpty()
    assert memory.current_session(s).first()[0] == "abd2" and memory.unclosed(s).first()["session_id"] == "abc1"
    assert memory.list_sessions(s, 1).first()["session_id"] == "abd2"


def test_behaviour(spark):
    edits = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "a", 3)], "session string, file string, seq int")
    assert {(r["file_a"], r["file_b"], r["n"]) for r in behaviour.coedits(edits).collect()} == {("a", "b", 2), ("b", "a", 2)}
    q = spark.createDataFrame([(f"q{i}", "how to join", AT + dt.timedelta(i)) for i in range(12)], "query_id string, text string, time timestamp")
    assert behaviour.style_summary(q, ["time"]).count() == 1
    hits = spark.createDataFrame([("a.py::f",), ("notes",)], "symbol string")
    row = behaviour.profile(q, hits).first()
    assert row["top_question_type"] == "how" and row["code_focus_pct"] == 50.0
    rw = spark.createDataFrame([("Auth", "authentication", AT), ("auth", "authorisation", AT + dt.timedelta(1))], "query string, rewrite string, time timestamp")
    assert tuple(behaviour.rewrites(rw).first()) == ("auth", "authorisation", 2)
    lines = spark.createDataFrame([("a.py", 3, "x = 1  # TODO: make this faster"), ("a.py", 4, "y = 2")], "file string, n int, line string")
    assert behaviour.comment_learnings(lines).first()["text"] == "TODO in a.py:3: make this faster"
    patch = spark.createDataFrame([("h", x) for x in ("--- a", "+++ b", "@@ -1 +1 @@", "+one", "+two", "-three", " same")], "hash string, line string")
    assert tuple(behaviour.diff_stats(patch).first()) == ("h", 2, 1, 1)
    weights = behaviour.seed_symbols(spark.createDataFrame([("a.py", 1.0), ("b.py", 0.5)], "path string, weight double"), spark.createDataFrame([("a.py", "f")], "file string, name string"))
    assert {r["symbol"] for r in weights.collect()} == {"a.py::f", "b.py"}


@pytest.mark.parametrize(("query", "tier"), [("x", "QUICK"), ("implement a new caching layer", "COMPLEX"), ("give me full context on this", "EXPERT"), ("list files", "QUICK"), ("TypeError: boom at line 3", "COMPLEX")])
def test_tiers(spark, query, tier):
    assert one(spark, rules.classify("q"), q=query)["tier"] == tier


def test_tier_retrieval_and_hints(spark):
    assert tuple(one(spark, rules.tier_retrieval("t", 5, 1), t="EXPERT")) == (20, 10)
    assert tuple(one(spark, rules.tier_retrieval("t", 5, 1), t="QUICK")) == (5, 1)
    assert one(spark, rules.error_hint("t"), t="ReadTimeoutError").startswith("Timeout")
    assert one(spark, scores.tool_importance("t"), t="who_calls") == 0.60
    assert one(spark, scores.result_importance(F.lit("context_pack"), F.array(F.lit(0.5), F.lit(0.7)), F.lit(None).cast("double"))) == pytest.approx(0.7)


# ── packing, metrics ────────────────────────────────────────────────────────────────────────────────────────────────


def test_pack_rules(spark):
    rows = [(1, 0, "code", "c0", 50), (1, 1, "code", "c1", 70), (1, 2, "code", "c2", 10), (1, 3, "doc", "d0", 30), (1, 4, "doc", "d1", 15), (1, 5, "doc", "d2", 4)]
    got = packing.pack(spark.createDataFrame(rows, "query_id int, place int, bucket string, id string, tokens int"), 100).first()
    assert got["packed"] == ["c0", "d1", "d2"] and got["used"] == 69 and got["truncated"]
    parts = spark.createDataFrame([("episode", 1, "x" * 80_000), ("memory", 1, "m" * 8)], "kind string, place int, text string")
    assert [r["kind"] for r in packing.trim_bundle(parts, "STANDARD").collect()] == ["memory"]


def test_metrics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "v double")
    assert tuple(metrics.percentiles(df, "v").first()) == (6.0, 10.0, 10.0)
    saved = spark.createDataFrame([(100, 20), (0, 5)], "baseline_tokens int, packed_tokens int")
    assert tuple(metrics.token_reduction(saved).first()) == (80.0, 1)
    assert {r["store"]: r["n"] for r in metrics.health(a=df, b=saved).collect()} == {"a": 11, "b": 2}
    nodes = spark.createDataFrame([("a", "FILE")], "id string, type string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    decisions = spark.createDataFrame([("1", "use x", AT)], "id string, text string, timestamp timestamp")
    hot = spark.createDataFrame([("f", 3)], "symbol string, hit_count long")
    assert {r["section"] for r in metrics.session_brief(nodes, edges, decisions, hot).collect()} == {"graph", "decisions", "entry points", "hot symbols"}


# ── indexing, sources, sinks ────────────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    import subprocess

    root = tmp_path_factory.mktemp("repo")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "docs" / "adr").mkdir(parents=True)
    (root / "src" / "main.py").write_text('"""Top."""\nimport os\nfrom .util import helper\nLIMIT = 3\n\nclass A(Base):\n    """An A. Really."""\n    x: int\n    @wraps\n    def go(self):\n        return helper(os.path.join("a"))\n')
    (root / "src" / "util.py").write_text("def helper(x):\n    return x  # FIXME: handle the empty case\nsquare = lambda x: x * x\n")
    (root / "src" / "bad.py").write_text("def broken(:\n")
    (root / "src" / "app.go").write_text("package main\nfunc Run() {\n}\ntype T struct {\n}\n")
    (root / "node_modules" / "x.js").write_text("function no() {}\n")
    (root / "big.py").write_text("#" * 400_000)
    (root / "README.md").write_text("# Title\n## One\n" + "word " * 30 + "\n## Two\nshort\n")
    (root / "docs" / "adr" / "001-x.md").write_text("# Use Parquet\n## Decision\nWe use it.\n## Why\nFast\n")
    (root / "requirements.txt").write_text("NumPy>=1\n# no\nmy_pkg[x]==2\n")
    (root / "pyproject.toml").write_text('[project]\ndependencies = ["rich>=1"]\n[project.optional-dependencies]\ndev = ["pytest"]\n')
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src", "README.md")
    run("commit", "-qm", "fix: first thing\n\nbody text")
    return root


def test_repository_scan_and_parse(spark, tree):
    found = files.repository(spark, f"file://{tree}")
    assert sorted(r["path"] for r in found.collect()) == ["src/app.go", "src/bad.py", "src/main.py", "src/util.py"]
    parsed = indexing.parse(found)
    symbols = indexing.symbols(parsed)
    got = {(r["file"], r["name"]): r for r in symbols.collect()}
    a, go = got["src/main.py", "A"], got["src/main.py", "go"]
    assert (a["type"], a["bases"], a["docstring"]) == ("CLASS", ["Base"], "An A. Really.")
    assert (go["calls"], go["decorators"]) == (["helper", "join"], ["wraps"])
    assert got["src/main.py", "LIMIT"]["type"] == "CONSTANT" and got["src/main.py", "x"]["type"] == "TYPED_FIELD" and got["src/util.py", "square"]["type"] == "LAMBDA"
    assert got["src/app.go", "Run"]["type"] == "FUNCTION" and got["src/app.go", "T"]["type"] == "CLASS"
    assert not any(f == "src/bad.py" for f, _ in got)
    assert {(r["path"], tuple(r["imports"])) for r in parsed.where("path = 'src/main.py'").collect()} == {("src/main.py", ("os", ".util"))}
    known = parsed.select("path", "sha256")
    assert indexing.changed(found, known).isEmpty()
    assert {(r["word"], r["file"]) for r in indexing.word_index(symbols).where("word = 'really'").collect()} == {("really", "src/main.py")}
    summary = {r["path"]: r for r in indexing.file_summaries(symbols, found).collect()}
    assert summary["src/main.py"]["constants"] == ["LIMIT"] and summary["src/main.py"]["purpose"] == "An A."
    assert indexing.repository_summary(indexing.directory_summaries(indexing.file_summaries(symbols, found))).first()["files"] == 4
    assert {r["language"]: r["files"] for r in indexing.language_counts(found).collect()} == {"python": 3, "go": 1}


def test_parsing_by_lines():
    assert indexing.parse_lines("# nothing\n", "bash") == [] and indexing.parse_lines("", "yaml") == [] and indexing.parse_lines("x", "cobol") == []
    found = indexing.parse_lines("a() {\n}\n\nfunction b() {\n}\n", "bash")
    assert [(x["name"], x["type"], x["start_line"], x["end_line"]) for x in found] == [("a", "FUNCTION", 1, 3), ("b", "FUNCTION", 4, 5)]


def test_documents_and_manifests(spark, tree):
    docs = files.documents(spark, [f"file://{tree}/docs", f"file://{tree}/README.md"])
    assert docs.count() == 2
    assert tuple(files.decision_records(docs).first())[1:] == ("Use Parquet", "We use it.")
    chunks = chunking.chunks(docs.select(F.col("path").alias("source"), "text"))
    assert chunks.count() == 1
    rows = [("r", n, (tree / n).read_text()) for n in ("requirements.txt", "pyproject.toml")] + [("r", "package.json", '{"dependencies": {"left-pad": "1"}}'), ("r", "go.mod", "require github.com/a/b v1.0.0\n"), ("r", "Cargo.toml", "[dependencies]\nserde = '1'\n"), ("r", "package.json", "{broken")]
    got = {r["package"] for r in files.manifest_packages(spark.createDataFrame(rows, "repo string, name string, text string")).collect()}
    assert got == {"numpy", "my-pkg", "rich", "pytest", "left-pad", "github-com/a/b", "serde"}
    assert files.search_extensions("Go") == [".go"] and files.search_extensions("cobol") is None
    lines = files.lines(spark, [f"file://{tree}/src"], "*.py")
    assert behaviour.comment_learnings(lines).count() == 1
    front = spark.createDataFrame([("---\na: 1\n---\nbody",)], "t string")
    assert front.select(indexing.strip_front_matter("t").alias("t")).first()["t"] == "body"
    code = "def a():\n" + "    x = 1\n" * 20 + "def b():\n" + "    y = 2\n" * 20
    cut = {s: one(spark, chunking.source("t", "p"), t=code * 30, p=s) for s in ("m.py", "m.TXT", "m")}
    assert [len(c) for c in cut.values()] == [40, 1, 16] and all(c.startswith("def ") for c in cut["m.py"])
    assert len(one(spark, chunking.source("t", "p", count=None), t=code * 30, p="m.py")) == 60
    assert len(one(spark, chunking.source("t", "p", most=None), t="z" * 5_000, p="m.md")[0]) == 5_000
    long = "## S\n" + "\n\n".join("p" * 700 for _ in range(5))
    assert [len(c) for c in one(spark, chunking.markdown("t"), t=long)] == [1404, 1402, 700]
    assert one(spark, chunking.markdown("t"), t="") == [] and one(spark, chunking.markdown("t"), t="\n\n" * 2_000) == []
    assert [len(c) for c in one(spark, chunking.markdown("t"), t="q" * 5_000)] == [5_000]
    assert len(one(spark, chunking.markdown("t", count=None), t=("## H\n" + "w" * 80 + "\n") * 50)) == 50


def test_git_sources(spark, tree):
    log = git.read(spark, "git_log", str(tree)).collect()
    assert [(r["message"], r["body"]) for r in log] == [("fix: first thing", "body text")]
    assert {r["path"] for r in git.read(spark, "git_files", str(tree)).collect()} == {"src/main.py", "src/util.py", "src/bad.py", "src/app.go", "README.md"}
    assert git.read(spark, "git_tracked", str(tree)).count() == 5
    stats = behaviour.diff_stats(git.read(spark, "git_patch", str(tree), target="src/util.py")).first()
    assert (stats["added"], stats["removed"], stats["hunks"]) == (3, 0, 1)
    assert git.log_chunks(git.read(spark, "git_log", str(tree))).first()["text"].endswith("fix: first thing")
    assert (git.since_days("2w"), git.since_days("1y"), git.since_days("soon")) == (14, 365, 7)
    tracked = git.read(spark, "git_tracked", str(tree)).select("path")
    assert files.tracked_only(files.repository(spark, f"file://{tree}"), tracked).count() == 4


def test_stores(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"row_id": 1, "text": "a"}\n{broken\n{"row_id": 2}\n')
    assert sorted(r["row_id"] for r in files.json_store(spark, str(tmp_path / "m.json"), "row_id long, text string").collect()) == [1, 2]
    table = sinks.Table(spark, f"file://{tmp_path}/t", "row_id long, text string")
    assert table.read().isEmpty()
    sinks.add_memories(table, spark.createDataFrame([(1,)], "row_id long"))
    sinks.add_memories(table, spark.createDataFrame([(2, "b")], "row_id long, text string"))
    assert table.read().count() == 2
    table.overwrite(table.read().where("row_id = 2"))
    assert [r["row_id"] for r in table.read().collect()] == [2] and table.read(1).count() == 2
    table.overwrite(table.read())
    table.vacuum(1)
    assert table.versions() == [3]
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    stored = sinks.manifest(rows)
    assert sinks.verify(rows.orderBy(F.desc("path")), stored) and not sinks.verify(rows.limit(1), stored)
    sinks.append_metrics(spark.createDataFrame([("m", 1.0)], "metric string, value double"), str(tmp_path / "metrics"))
    sinks.snapshot(rows.limit(1), str(tmp_path / "snap"))
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in sinks.append_exchange(turns, 1, "u", "a").orderBy("turn").collect()] == [0, 1, 2]
    stores = Stores(spark, f"file://{tmp_path}/e", {"events": ("id string, time timestamp", "id"), "archive": ("id string, time timestamp", None)})
    stores.store("events").overwrite(spark.createDataFrame([(str(i), AT + dt.timedelta(i)) for i in range(10)], "id string, time timestamp"))
    assert sinks.rotate_events(stores, cap=10) == 2 and stores.read("events").count() == 8 and stores.read("archive").count() == 2
    bucketed = sinks.BucketStore(spark, f"file://{tmp_path}/sym", "k string, name string", "k")
    bucketed.overwrite(spark.createDataFrame([("0", "a"), ("1", "b")], "k string, name string"))
    bucketed.replace(spark.createDataFrame([("1",)], "path string"), spark.createDataFrame([("1", "c")], "k string, name string"))
    assert {r["name"] for r in bucketed.read().collect()} == {"a", "c"}
