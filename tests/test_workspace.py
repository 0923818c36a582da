"""One workspace from index to answer."""

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from larkspur.workspace import Workspace, resolve

AT = dt.datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    repo = root / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "pkg" / "__init__.py").write_text("")
    (repo / "pkg" / "jwt.py").write_text("def decode_jwt(token):\n    'Decodes a token.'\n    return token\n")
    (repo / "main.py").write_text("from pkg.jwt import decode_jwt\n\ndef verify_token(t):\n    # NOTE: tokens are opaque here\n    return decode_jwt(t)\n")
    (repo / "README.md").write_text("# App\n## Use\nTokens are verified with verify_token and nothing else is needed, really.\n")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "fix: verify tokens before use")
    w = Workspace(spark, f"file://{root}/store", repo="/r/app")
    w.repo_path = str(repo)
    assert w.index_repo(f"file://{repo}", AT, docs=f"file://{repo}") == {"parsed": 3, "files": 3, "symbols": 2}
    return w


def test_index_is_incremental(ws):
    assert ws.index_repo(f"file://{ws.repo_path}", AT)["parsed"] == 0
    assert ws.verify_index()
    assert {r["path"]: r["weight"] for r in ws.read("files").collect()} == {"main.py": 1.0, "pkg/jwt.py": 1.0, "pkg/__init__.py": 0.5}


def test_code_tools(ws):
    assert ws.lookup_symbol("Decode_JWT").first()["file"] == "pkg/jwt.py"
    assert ws.search_token("token").count() >= 1
    assert [r["caller"] for r in ws.who_calls("decode_jwt").collect()] == ["main.py::verify_token"]
    assert {(r["direction"], r["node"]) for r in ws.dependency_graph("main.py").collect()} == {("imports", "pkg/jwt.py")}
    with pytest.raises(LookupError):
        ws.dependency_graph("nowhere.py")
    assert ws.semantic_search_code("FUNCTION decode_jwt Decodes a token.", 1).first()["name"] == "decode_jwt"
    assert ws.search_docs("verify_token").count() == 1
    assert ws.subgraph("decode_jwt", 1)[1].count() >= 1
    assert ws.graph_stats()[0].first()["nodes"] == 5
    assert ws.architecture_overview("pkg").count() == 2 and ws.architecture_overview().count() == 2
    assert {r["dir"]: r["symbols"] for r in ws.coverage().collect()} == {".": 1, "pkg": 1}
    change = ws.explain_change(ws.repo_path, since="1y").first()
    assert change["message"].startswith("fix:") and change["added"] >= 8


def test_memory_tools(ws):
    assert ws.store_memory("we decided to keep decode_jwt pure and free of side effects", AT) == "stored"
    assert ws.store_memory("we decided to keep decode_jwt pure and free of side effects", AT, importance=0.9, only_novel=True) == "known"
    assert ws.read("learnings").first()["type"] == "decision"
    top = ws.retrieve_memory("how does decode_jwt work").collect()
    assert any(r["name"] == "decode_jwt" for r in top)
    ws.record_decision("use tokens", "simple", ["main.py"], AT + dt.timedelta(1))
    first = ws.episodic_search("simple tokens").join(ws.read("episodes"), "id").orderBy(F.desc("score")).first()
    assert first["event"] == "decision"
    assert ws.history(1).first()["prev"] is not None
    packed = ws.context_pack("decode_jwt", 200).first()
    assert packed["packed"] and packed["used"] <= 200
    assert ws.learning_conflicts("we decided to keep decode_jwt pure").count() == 1
    assert ws.retrieve_learnings("decode_jwt", AT).count() == 1
    assert ws.org_search("decode_jwt pure").first()["source_repo"] == "/r/app"
    assert ws.prune(AT + dt.timedelta(days=200)) == {"kept": 0, "pruned": 1} and ws.read("pruned").count() == 1


def test_behaviour_tools(ws):
    q = ws.record_query("why does decode_jwt fail", ["pkg/jwt.py::decode_jwt"], AT)
    ws.record_feedback(q, True)
    assert ws.read("weights").first()["hit_count"] == 1
    assert ws.user_profile().first()["top_question_type"] == "why"
    assert ws.enhance(ws.spark.createDataFrame([("test decode_jwt",)], "query string")).first()["method"] == "HOT_SYMBOL"
    ws.record_user_preference("depth", "brief", AT)
    ws.record_user_preference("depth", "long", AT + dt.timedelta(1))
    assert ws.preferences().first()["value"] == "long"
    ws.record_error("KeyError", "x", "main.py", AT)
    assert ws.error_patterns().first()["hint"].startswith("Missing dict key")
    ws.append_exchange("s1", "hello", "hi there")
    assert ws.session_history().first()["assistant"] == "hi there"
    assert ws.session_brief().count() >= 2
    ws.record_feedback(q, True)
    hits = lambda: {r["symbol"]: r["hit_count"] for r in ws.read("weights").collect()}
    assert hits() == {"pkg/jwt.py::decode_jwt": 2.0}
    now = dt.datetime.now()
    assert ws.seed(ws.repo_path, now)["learnings"] == 2 and ws.seed(ws.repo_path, now)["learnings"] == 0
    assert hits()["pkg/jwt.py::decode_jwt"] == 2.0 and 0 < hits()["main.py::verify_token"] <= 1
    seeded = hits()["main.py::verify_token"]
    ws.record_feedback(ws.record_query("verify", ["main.py::verify_token"], AT), True)
    assert hits()["main.py::verify_token"] == seeded + 1 and hits()["pkg/jwt.py::decode_jwt"] == 2.0
    assert ws.seed(ws.repo_path, now)["learnings"] == 0 and hits()["main.py::verify_token"] == seeded + 1
    golden = ws.spark.createDataFrame([("FUNCTION decode_jwt Decodes a token.", "decode_jwt", "jwt")], "query string, expected_symbol string, expected_file_pattern string")
    assert ws.benchmark(golden).first()["recall_at_1"] == 1.0
    assert {r["store"]: r["n"] for r in ws.status().collect()}["files"] == 3


def test_organisation_tools(ws):
    ws.add_repo("o", "p", "/r/app", "app")
    ws.add_repo("o", "p", "/r/lib", "lib", "/r/app")
    ws.link_repos("/r/app", "/r/lib")
    with pytest.raises(ValueError, match="relationship"):
        ws.link_repos("/r/app", "/r/lib", "LIKES")
    assert ws.org_dependencies("/r/app").first()["node"] == "/r/lib"
    assert ws.list_org_context("/r/app")["children"].first()["name"] == "lib"
    manifests = ws.spark.createDataFrame([("/r/app", "requirements.txt", "lib==1")], "repo string, name string, text string")
    assert ws.discover_links(manifests).count() == 1
    named = ws.spark.createDataFrame([("/r/lib", "f")], "repo string, name string")
    assert ws.cross_repo_traverse("/r/app", named).where(F.col("repo") == "/r/lib").count() == 1


@pytest.mark.parametrize(("q", "want"), [("Where is verify_token defined?", ("lookup_symbol", "verify_token")), ("who calls f?", ("who_calls", "f")), ("graph stats", ("graph_stats", None)), ("explain life", None)])
def test_resolver(q, want):
    assert resolve(q) == want


def test_ask(ws):
    got = ws.ask("where is verify_token")
    assert got["local"] == ("lookup_symbol", "verify_token") and got["tier"] in ("QUICK", "STANDARD")
