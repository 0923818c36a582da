"""A tree's changes as a stream, over restarts."""

import os

from larkspur import schemas
from larkspur.sources.commits import Stores
from larkspur.sources.watch import file_changes
from larkspur.streaming import streams


def test_changes_of_a_tree(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "__init__.py").write_text("")
    (root / "a.py").write_text("def one(): pass\n")
    (root / "b.go").write_text("package b\nfunc Two() { three() }\n")
    (root / "node_modules" / "skip.js").write_text("function skip() {}")
    (root / "note.bin").write_text("no source")
    stores = Stores(spark, f"file://{tmp_path}/stores", {"files": (schemas.FILES, "path"), "symbols": (schemas.SYMBOLS, "file")})
    index = streams.reindex(stores)

    def batch(rows, number):
        seen.append(sorted((r["path"], r["action"], bytes(r["content"]) if r["content"] is not None else None) for r in rows.collect()))
        index(rows, number)

    def run():
        seen.clear()
        changes = file_changes(spark, str(root), str(tmp_path / "listings"))
        query = streams.periodic(changes, batch, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
        return [row for rows in seen for row in rows]

    names = lambda: {r["name"] for r in stores.read("symbols").collect()}
    assert [(p, a) for p, a, _ in run()] == [("a.py", "create"), ("b.go", "create"), ("pkg/__init__.py", "create")]
    assert names() == {"one", "Two"}
    assert run() == []
    (root / "a.py").write_text("def uno(): pass\n")
    os.utime(root / "a.py", ns=(1, 2_000_000_000_000_000_000))
    (root / "b.go").unlink()
    (root / "c.rs").write_text("fn four() {}\n")
    assert run() == [("a.py", "modify", b"def uno(): pass\n"), ("b.go", "delete", None), ("c.rs", "create", b"fn four() {}\n")]
    assert names() == {"uno", "four"} and {r["path"] for r in stores.read("files").collect()} == {"a.py", "c.rs", "pkg/__init__.py"}
    assert run() == []
    assert len([n for n in os.listdir(tmp_path / "listings") if n.endswith(".json")]) <= 2
