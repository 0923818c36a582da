"""The vector store's life cycle, on both backends."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ann, packing, vector
from larkspur.sources.vector_store import vector_store

AT = dt.datetime(2024, 1, 10)


@pytest.mark.parametrize("backend", ["exact", "cosine"])
def test_life_cycle(spark, tmp_path, backend):
    store = vector_store(spark, f"file://{tmp_path}/s", backend)
    rows = [(0, "a", "memory", 0.5, [1.0, 0.0]), (1, "b", None, 0.6, [0.9, 0.1]), (2, "c", "doc", 0.7, [0.0, 1.0]), (3, "d", "doc", 0.2, [0.1, 0.9])]
    store.add(spark.createDataFrame(rows, "row_id long, text string, source string, importance double, embedding array<float>"))
    q = [1.0, 0.0]
    assert [r["row_id"] for r in store.search(q, 2).collect()] == [0, 1]
    assert [r["row_id"] for r in store.search(q, 9, "memory").collect()] == [0, 1]
    store.update_behaviour_score(1, 0.2, AT)
    store.update_behaviour_score(1, 0.9, AT + dt.timedelta(1))
    assert store.search_with_scores(q, 2).where("row_id = 1").first()["behaviour_score"] == 0.9
    store.deprecate([0], AT)
    store.suppress(1, "copy", 0.95, AT)
    assert [r["row_id"] for r in store.search(q, 2).collect()] == [3, 2]
    assert store.queue.read().first()["entry_id"] == "1"
    assert store.dead_share().first()["rebuild"]
    store.compact()
    assert [(r["row_id"], r["text"]) for r in store.search(q, 5).orderBy("row_id").collect()] == [(2, "c"), (3, "d")]
    assert store.queue.read().isEmpty() and store.marks.read().isEmpty()


def test_compaction_is_one_step(spark, tmp_path, monkeypatch):
    store = vector_store(spark, f"file://{tmp_path}/s")
    store.add(spark.createDataFrame([(i, f"t{i}", 0.5, [1.0, float(i)]) for i in range(12)], "row_id long, text string, importance double, embedding array<float>"))
    store.deprecate([0, 3], AT)
    store.suppress(5, "copy", 0.95, AT)
    store.suppress(6, "copy", 0.99, AT)
    store.update_behaviour_score(7, 0.7, AT)
    seen = lambda: sorted((r["row_id"], r["text"], r["behaviour_score"]) for r in vector.live(store.rows()).collect())
    before, stage = seen(), store.stores._stage
    for fail in ("rows", "updates", "marks", "cleanup", "publish"):
        with monkeypatch.context() as patch:
            patch.setattr(store.stores, "_stage", lambda base, name, change, fail=fail: (_ for _ in ()).throw(OSError("died")) if name == fail else stage(base, name, change))
            if fail == "publish":
                patch.setattr(store.stores, "_publish", lambda *args: (_ for _ in ()).throw(OSError("died")))
            with pytest.raises(OSError, match="died"):
                store.compact()
        assert seen() == before
    # a mark that is set while rows are compacted holds
    publish = store.stores._publish

    def meanwhile(*args):
        monkeypatch.setattr(store.stores, "_publish", publish)
        store.deprecate([8], AT)
        return publish(*args)

    monkeypatch.setattr(store.stores, "_publish", meanwhile)
    store.compact()
    assert seen() == [r for r in before if r[0] != 8] and store.base.read().count() == 8 and store.queue.read().isEmpty()
    store.suppress(9, "copy", 0.95, AT)
    store.suppress(10, "copy", 0.99, AT)
    assert [r["entry_id"] for r in store.cleanup(AT + dt.timedelta(1), 1).collect()] == ["10"]
    assert [r["entry_id"] for r in store.queue.read().collect()] in ([], ["9"]) and 10 not in [r["row_id"] for r in store.base.read().collect()]


def test_unknown_backend(spark):
    with pytest.raises(ValueError, match="backend"):
        vector_store(spark, "file:///nowhere", "faiss")


def test_ann_recall_against_brute_force(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "row_id")
    index = ann.AnnIndex.build(rows, str(tmp_path / "ann"))
    again = ann.AnnIndex(spark, str(tmp_path / "ann"))
    centroids, probes = again._loaded()
    assert index.rows().count() == rows.count() and probes < len(centroids)
    ids = np.array([r["row_id"] for r in rows.orderBy("row_id").collect()])
    vectors = np.array([r["embedding"] for r in rows.orderBy("row_id").collect()])
    found = hits = 0
    for q in range(0, len(ids), 100):
        want = set(ids[np.argsort(((vectors - vectors[q]) ** 2).sum(1), kind="stable")[:10]].tolist())
        hits += len(want & {r["row_id"] for r in again.search(vectors[q].tolist(), 10).collect()})
        found += 10
    assert hits >= 0.9 * found


def test_ann_filters_before_the_top_k(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, draw.normal(size=8).tolist(), i % 50) for i in range(400)] + [(999, None, 0)], "row_id long, embedding array<double>, kind int")
    index = ann.AnnIndex.build(rows, str(tmp_path / "ann"))
    query = [0.1] * 8
    got = [r["row_id"] for r in index.search(query, 8, F.col("kind") == 3).collect()]
    assert got == [r["row_id"] for r in vector.knn(rows.where("kind = 3"), query, 8).collect()] and len(got) == 8
    empty = ann.AnnIndex.build(rows.limit(0), str(tmp_path / "none"))
    assert empty.search(query, 3).count() == 0


def test_embedding_gives_up_in_time(spark):
    def slow(texts):
        if "slow" in texts:
            time.sleep(3)
        return np.ones((len(texts), 2))

    rows = spark.createDataFrame([(1, "quick"), (2, "slow")], "id int, t string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in vector.embed(rows, "t", slow, batch=1, patience=0.5).collect()}
    assert got == {1: [1.0, 1.0], 2: None}
    other = {r["id"]: r["embedding"] for r in vector.embed(rows, "t", slow, batch=1, patience=0.5, fallback=lambda texts: np.zeros((len(texts), 2))).collect()}
    assert other == {1: [1.0, 1.0], 2: [0.0, 0.0]}


def test_exact_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    texts = ["", None, "a few words, and 12345 numbers", "été " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    whole = tokenizers.Tokenizer.from_file(path)
    got = {r["id"]: r["tokens"] for r in packing.with_tokens(rows, "t", path).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r["id"]: r["tokens"] for r in packing.with_tokens(rows, "t").collect()}[3] == 500
