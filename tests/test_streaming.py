"""Streams: incremental indexing, co-edit state, windows; a second run finds nothing new."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.schemas import FILES
from larkspur.sources import commits, sinks
from larkspur.sources.commits import Change, Stores
from larkspur.streaming import streams

AT = dt.datetime(2024, 1, 10)
SYMBOLS = "file string, name string, type string, start_line int, end_line int, docstring string, calls array<string>, decorators array<string>, tags array<string>, bases array<string>"


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


STORES = {
    "files": (FILES, "path"), "symbols": (SYMBOLS, "file"), "words": (schemas.POSTINGS, "file"), "vectors": ("file string, name string", "file"),
    "nodes": (schemas.NODES, "id"), "edges": (schemas.EDGES, "src"), "events": (schemas.EPISODES, "id"),
}


def feed_rows(spark, *rows):
    return spark.createDataFrame([(p, a, AT + dt.timedelta(seconds=s), bytearray(c.encode()) if c else None) for p, a, s, c in rows], streams.CHANGES)


def embed(symbols):
    return symbols.select("file", "name")


def test_reindex_is_incremental_and_idempotent(spark, tmp_path):
    feed, cp = str(tmp_path / "feed"), str(tmp_path / "cp")
    stores = Stores(spark, f"file://{tmp_path}/stores", {k: STORES[k] for k in ("files", "symbols", "events")})
    stores.store("events").append(spark.createDataFrame([("1", "edit a.py", {}, AT, None, None, None)], schemas.EPISODES))

    def put(*rows):
        feed_rows(spark, *rows).write.mode("append").parquet(feed)

    batch = streams.reindex(stores)
    put(("a.py", "create", 1, "def one(): pass"), ("b.py", "create", 1, "def two(): pass"))
    run(streams.periodic(streams.changes(spark, feed), batch, cp))
    assert {r["name"] for r in stores.read("symbols").collect()} == {"one", "two"}
    put(("b.py", "modify", 5, "def three(): pass"), ("a.py", "delete", 6, None))
    run(streams.periodic(streams.changes(spark, feed), batch, cp))
    assert {r["name"] for r in stores.read("symbols").collect()} == {"three"} and stores.read("files").count() == 1
    assert stores.read("events").first()["stale"]
    before = stores.versions()
    run(streams.periodic(streams.changes(spark, feed), batch, cp))
    assert stores.versions() == before


def test_reindex_drops_a_file_from_every_store(spark, tmp_path):
    stores = Stores(spark, f"file://{tmp_path}", STORES, buckets=16)

    class Cache:
        cleared = 0

        def clear(self):
            self.cleared += 1

    cache = Cache()
    batch = streams.reindex(stores, (cache,), embed)
    batch(feed_rows(spark, ("a.py", "create", 1, "def one():\n    two()\n"), ("b.py", "create", 1, "class Two:\n    'Counts apples.'\n"), *((f"c{i}.py", "create", 1, f"def worker_{i}(): pass") for i in range(20))), 0)
    names = {r["name"] for r in stores.read("symbols").collect()}
    assert {"one", "Two", "worker_0", "worker_19"} <= names and len(names) == 22 and cache.cleared == 1
    assert {r["name"] for r in stores.read("vectors").collect()} == names
    assert stores.read("edges").where("rel = 'CALLS' and dst = 'symbol::two'").count() == 1
    assert stores.read("words").where("word = 'apples'").count() == 1 and stores.read("nodes").where("id = 'b.py::Two'").count() == 1
    folders = lambda: {f[1] for f in stores.state().stores["symbols"].folders}
    before = folders()
    batch(feed_rows(spark, ("a.py", "delete", 2, None), ("b.py", "modify", 2, "def three(): pass")), 1)
    after = folders()
    for name, column in (("files", "path"), ("symbols", "file"), ("words", "file"), ("vectors", "file"), ("nodes", "file")):
        rows = stores.read(name)
        assert rows.where(f"{column} = 'a.py'").isEmpty() and not rows.where(f"{column} = 'c7.py'").isEmpty()
    edges = stores.read("edges")
    assert edges.where("src like 'a.py%' or dst like 'a.py%' or src like '%Two' or dst like '%Two'").isEmpty() and edges.where("src = 'b.py::three'").count() == 1
    assert {r["name"] for r in stores.read("symbols").where("file = 'b.py'").collect()} == {"three"}
    assert len(before - after) <= 2 and cache.cleared == 2
    batch(feed_rows(spark, ("b.py", "modify", 3, "def three(): pass")), 2)
    assert folders() == after and cache.cleared == 2


def contents(stores):
    hide = {"indexed_at", "seq"}
    return {n: sorted(repr(tuple(r[c] for c in stores.columns[n] if c not in hide)) for r in stores.read(n).collect()) for n in stores.tables}


@pytest.mark.parametrize("fail", [*STORES, "publish", "after"])
def test_a_failed_batch_leaves_nothing_and_runs_again(spark, tmp_path, monkeypatch, fail):
    first = [("a.py", "create", 1, "def one():\n    two()\n"), ("b.py", "create", 1, "def two(): pass")]
    second = [("a.py", "delete", 2, None), ("b.py", "modify", 2, "def three():\n    one()\n"), ("c.py", "create", 2, "class Four: pass")]
    outcome = {}
    for place in ("clean", "broken"):
        stores = Stores(spark, f"file://{tmp_path}/{place}", STORES)
        stores.store("events").append(spark.createDataFrame([("1", "edit a.py", {}, AT, None, None, None), ("2", "edit b.py", {}, AT, None, None, None)], schemas.EPISODES))
        batch = streams.reindex(stores, embed=embed)
        batch(feed_rows(spark, *first), 0)
        if place == "broken":
            before, stage, publish = contents(stores), stores._stage, stores._publish

            def broken_stage(base, name, change):
                out = stage(base, name, change)
                if name == fail:
                    raise OSError("the disk is full")
                return out

            def broken_publish(*args):
                if fail == "after":
                    publish(*args)
                raise OSError("the driver died")

            with monkeypatch.context() as patch:
                patch.setattr(stores, "_stage", broken_stage)
                if fail in ("publish", "after"):
                    patch.setattr(stores, "_publish", broken_publish)
                with pytest.raises(OSError, match="disk|died"):
                    batch(feed_rows(spark, *second), 1)
            if fail != "after":
                assert contents(stores) == before
        batch(feed_rows(spark, *second), 1)
        versions = stores.versions()
        batch(feed_rows(spark, *second), 1)
        assert stores.versions() == versions
        outcome[place] = contents(stores)
    assert outcome["clean"] == outcome["broken"]
    stores.vacuum(keep=1, older_than=0)
    assert contents(stores) == outcome["clean"] and len(stores.versions()) == 1


def test_commits_meet(spark, tmp_path):
    """Of two commits from one version, the second is laid over the first, or computed again where they touch the same rows."""
    stores = Stores(spark, f"file://{tmp_path}", {"a": ("k string, v int", "k"), "log": ("k string, v int", None)})
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    key = lambda k: spark.createDataFrame([(k,)], "path string")
    stores.store("a").append(rows(("x", 1), ("y", 1)))
    calls = []

    def raise_x(state):
        calls.append(state.version)
        if len(calls) == 1:
            stores.store("log").append(rows(("z", 9)))
            stores.store("a").replace(key("x"), rows(("x", 5)))
        old = stores.read("a", state).where("k = 'x'")
        return {"a": Change(old.selectExpr("k", "v + 1 AS v"), key("x"))}

    stores.commit(raise_x)
    assert {tuple(r) for r in stores.read("a").collect()} == {("x", 6), ("y", 1)} and len(calls) == 2
    base = stores.state()
    delta = {"log": stores._stage(base, "log", Change(rows(("w", 1))))}
    stores.store("a").append(rows(("q", 1)))
    stores._publish(base, delta, None, None)
    assert stores.read("log").count() == 2 and stores.read("a").count() == 3
    assert stores.changed(stores.versions()[-1]) == {"log"}
    assert stores.read("a", 1).count() == 2


def test_buckets_grow_and_folders_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_FOLDERS", 3)
    stores = Stores(spark, f"file://{tmp_path}", {"a": ("k string, v int", "k"), "log": ("v int", None)})
    for i in range(5):
        stores.store("log").append(spark.createDataFrame([(i,)], "v int"))
        assert len(stores.state().stores["log"].folders) <= 4
    assert sorted(r["v"] for r in stores.read("log").collect()) == [0, 1, 2, 3, 4]
    stores.store("a").append(spark.range(1000).selectExpr("cast(id as string) k", "cast(id as int) v"))
    monkeypatch.setattr(commits, "BUCKET_BYTES", 2000)
    one = spark.createDataFrame([("7",)], "path string")
    stores.store("a").replace(one, spark.createDataFrame([("7", -7)], "k string, v int"))
    assert stores.state().stores["a"].buckets > 1 and stores.read("a").count() == 1000 and stores.read("a").where("v = -7").count() == 1
    before = {f[1] for f in stores.state().stores["a"].folders}
    monkeypatch.setattr(commits, "BUCKET_BYTES", 1 << 30)
    stores.store("a").replace(one)
    assert len(before - {f[1] for f in stores.state().stores["a"].folders}) == 1 and stores.read("a").count() == 999


def test_gate_sheds_what_cannot_wait():
    gate = streams.Gate(1, 1, 0.2)
    begun, go = threading.Event(), threading.Event()

    def hold():
        with gate():
            begun.set()
            go.wait(10)

    first = threading.Thread(target=hold)
    first.start()
    begun.wait(10)
    with pytest.raises(streams.Busy, match="in time"), gate():
        pass
    go.set()
    first.join()
    with gate():
        assert gate.shed == 1
    full = streams.Gate(1, 0)
    with full(), pytest.raises(streams.Busy, match="too many"), full():
        pass


def test_probes(spark, tmp_path):
    assert streams.memory_probe(1.0)() and not streams.memory_probe(0.0)()
    assert streams.storage_probe(spark, f"file://{tmp_path}")() and not streams.storage_probe(spark, f"file://{tmp_path}/none")()
    assert not streams.storage_probe(spark, "nowhere://x/y")()
    breaker = streams.Breaker([streams.memory_probe(0.0)])
    assert not breaker.allow(0.0) and breaker.state == "OPEN"


def test_listing_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert {(r[0], r[1]) for r in streams.listing_changes(old, new).collect()} == {("b", "modify"), ("c", "delete"), ("d", "create")}


def test_coedit_state(spark, tmp_path):
    rows = [("s", "a", 1), ("s", "b", 2), ("s", "a", 3), ("t", "x", 1)]
    feed = str(tmp_path / "edits")
    spark.createDataFrame([(s, f, AT + dt.timedelta(seconds=t)) for s, f, t in rows], streams.EDITS).coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(streams.EDITS).parquet(feed)
    out = str(tmp_path / "out")
    writer = streams.coedit_pairs(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True)
    run(writer.start())
    got = {(r["file_a"], r["file_b"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2}


def test_windows(spark, tmp_path):
    feed = str(tmp_path / "ev")
    rows = [(1, AT, "view"), (1, AT + dt.timedelta(minutes=5), "view"), (1, AT + dt.timedelta(hours=3), "view"), (2, AT + dt.timedelta(days=2), "view")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").write.parquet(feed)

    def outcome(make, name):
        stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(feed)
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        run(q)
        return spark.table(name).collect()

    assert sorted(r["n"] for r in outcome(streams.event_counts, "counts")) == [1, 2]
    assert sorted(r["n"] for r in outcome(streams.idle_sessions, "sessions")) == [1, 2]
    assert len(outcome(lambda s: streams.novel_only(s.withColumn("query", F.lit("q"))), "novel")) == 1
    sliding = streams.event_counts(spark.read.parquet(feed), "1 hour", "30 minutes").collect()
    assert len(sliding) == 6


def test_useful_window_stream(spark, tmp_path):
    q, e = str(tmp_path / "q"), str(tmp_path / "e")
    spark.createDataFrame([("q1", 1, AT), ("q2", 1, AT + dt.timedelta(hours=1))], "query_id string, user_id long, query_ts timestamp").write.parquet(q)
    spark.createDataFrame([(1, AT + dt.timedelta(minutes=4), "f"), (1, AT + dt.timedelta(minutes=9), "g")], "user_id long, edit_ts timestamp, file string").write.parquet(e)
    left = spark.readStream.schema("query_id string, user_id long, query_ts timestamp").parquet(q)
    right = spark.readStream.schema("user_id long, edit_ts timestamp, file string").parquet(e)
    query = streams.useful_window(left, right).writeStream.format("memory").queryName("useful").trigger(availableNow=True).start()
    run(query)
    assert [(r["query_id"], r["file"]) for r in spark.table("useful").collect()] == [("q1", "f")]


def test_prune_batch_loses_nothing_on_replay(spark, tmp_path, monkeypatch):
    schema = "row_id long, importance double, created_at timestamp"
    stores = Stores(spark, f"file://{tmp_path}/m", {"memories": (schema, "row_id"), "archive": (schema, None)})
    stores.store("memories").append(spark.createDataFrame([(1, 0.9, AT), (2, 0.2, AT - dt.timedelta(days=30))], schema))
    batch = streams.prune_batch(stores, F.lit(AT))
    ids = lambda name: sorted(r["row_id"] for r in stores.read(name).collect())
    with monkeypatch.context() as patch:
        patch.setattr(stores, "_publish", lambda *args: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError, match="died"):
            batch(None, 0)
    assert (ids("memories"), ids("archive")) == ([1, 2], [])
    for _ in range(2):
        batch(None, 0)
        assert (ids("memories"), ids("archive")) == ([1], [2])
    # what has come since is not pruned by a batch that is done
    stores.store("memories").append(spark.createDataFrame([(3, 0.1, AT - dt.timedelta(days=99))], schema))
    batch(None, 0)
    assert (ids("memories"), ids("archive")) == ([1, 3], [2])
    batch(None, 1)
    assert (ids("memories"), ids("archive")) == ([1], [2, 3])


def test_rotation_archives_once(spark, tmp_path):
    schema = "id long, time timestamp"
    stores = Stores(spark, f"file://{tmp_path}", {"events": (schema, "id"), "archive": (schema, None)})
    stores.store("events").append(spark.createDataFrame([(i, AT + dt.timedelta(seconds=i // 2)) for i in range(20)], schema))
    assert sinks.rotate_events(stores, stream="r", number=4, cap=20) == 4 and sinks.rotate_events(stores, stream="r", number=4, cap=10) == 0
    assert sorted(r["id"] for r in stores.read("archive").collect()) == [0, 1, 2, 3] and stores.read("events").count() == 16
    assert sinks.rotate_events(stores, cap=100) == 0


def test_breaker():
    healthy = [False]
    breaker = streams.Breaker([lambda: healthy[0]])
    assert not breaker.allow(0.0) and not breaker.allow(10.0)
    healthy[0] = True
    assert not breaker.allow(20.0) and breaker.allow(31.0) and breaker.state == "CLOSED"
