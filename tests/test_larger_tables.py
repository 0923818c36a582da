"""What showed on larger tables: texts of other letters, equal distances, input in one split, work done twice."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from larkspur.operators import indexing, memory, text_search, vector
from larkspur.plans import catalogue


def test_seeds_end_words_where_ascii_ends(spark):
    said = "x" * 80 + " "
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", said + "tionê"), (1, 2, "assistant", said + "tions"), (1, 3, "assistant", said + "êtion."), (1, 4, "assistant", said + "ing_")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r["turn"], r["user"]) for r in memory.seeds(turns, r"(ing|tion)\b").orderBy("turn").collect()] == [(1, "q"), (3, None)]
    assert memory.seeds(turns, r"(ing|tion)\\b").isEmpty()
    assert [r["turn"] for r in memory.seeds(turns, r"\btion").orderBy("turn").collect()] == [1, 2, 3]


def test_entities_of_every_kind_of_question_and_of_whole_texts(spark, tmp_path):
    rows = [(10, 2, "user", "look. at HTTPServer, HTTPServer in src/a.py"), (11, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = {(r["conv_id"], r["kind"]): r["names"] for r in catalogue.queries()["query_entities"](spark, str(tmp_path)).collect()}
    assert [names[10, k] for k in range(6)] == ["fetch_zq,store/app_x.py", "parseTreezq,parse,treezq", "", "a_bzq,HTTPServerx,http,serverx", "", "HTTPServer,http,server,src/a.py"]
    assert names[11, 5] == "" and len(names) == 12


def test_knn_join_ties_go_by_id_in_bounded_memory(spark):
    v = np.random.default_rng(3).normal(size=(40, 64)).astype(np.float32)
    rows = [(i, v[i % 40].tolist()) for i in range(2000)]  # fifty copies of each
    df = spark.createDataFrame(rows, "row_id long, embedding array<float>")
    got = vector.knn_join(df.where("row_id % 9 = 0").withColumnRenamed("row_id", "query_id"), df, 5).collect()
    assert sorted((r["query_id"], r["place"], r["row_id"], r["d2"]) for r in got) == [(i, p + 1, i % 40 + 40 * p, 0.0) for i in range(0, 2000, 9) for p in range(5)]
    # neither all distances of a block nor all its near rows are held at once
    n = 16_384 + 2048
    table = pa.table({"side": pa.array([0] * 2048 + [1] * 16_384), "id": pa.array(range(n)), "v": pa.array([v[i % 40] for i in range(n)], pa.list_(pa.float32()))})
    tracemalloc.start()
    found = vector._nearest(table, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5 * 2048 and peak < 200 << 20


def test_index_cuts_a_text_once_and_shuffles_only_texts(spark, tmp_path):
    rows = [(0, "b a b"), (1, None), (2, "a"), (3, "?!"), (4, "c " * 300 + "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def once(text):
        seen.add(1)
        return text

    counted = docs.withColumn("text", F.udf(once)("text"))
    index = text_search.TextIndex.build(counted, str(tmp_path / "index"))
    assert seen.value == len(rows)
    assert sorted(map(tuple, index.postings().collect())) == [("a", 0, 1, 3), ("a", 2, 1, 1), ("a", 4, 1, 301), ("b", 0, 2, 3), ("c", 4, 300, 301)]
    assert sorted(map(tuple, index.lengths().collect())) == [(0, 3), (1, 0), (2, 1), (3, 0), (4, 301)]
    assert tuple(spark.read.parquet(f"{index.path}/stats").first()) == (5.0, 61.0)
    for segment in (tmp_path / "index" / "postings").glob("*.parquet"):
        terms = pq.read_table(segment, columns=["term", "id"]).to_pylist()
        assert terms == sorted(terms, key=lambda r: (r["term"], r["id"]))


def test_index_of_unicode_words_ranks_like_a_scan_over_many_segments(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("Été über "), F.repeat(F.lit("été "), (F.col("id") % 5).cast("int")), F.lit("ab "), "id")).alias("text"))
    index = text_search.TextIndex.build(docs.repartition(3), str(tmp_path / "index"), unicode_words=True)
    assert len(list((tmp_path / "index" / "postings").glob("*.parquet"))) > 3
    for asked in ("été über été", "100 été", "ab"):
        assert [tuple(r) for r in index.search_plus(asked, 20).collect()] == [tuple(r) for r in text_search.bm25_plus(docs, asked, 20).collect()]
    assert index.lengths().count() == 300 and index.postings().where("term in ('ab', '')").isEmpty()


def test_index_lists_the_documents_of_a_term(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("été über über "), F.pmod("id", F.lit(3))).alias("text"))
    index = text_search.TextIndex.build(docs.repartition(2), str(tmp_path / "index"), unicode_words=True)
    for segment in (tmp_path / "index" / "postings").glob("*.parquet"):
        assert pq.read_table(segment, columns=["term"]).column(0).to_pylist() in ([], ["", "été", "über"])
    assert index.postings().where("tf = if(term = 'über', 2, 1)").count() == 6000 and index.lengths().where("dl = 3").count() == 3000


def test_parts_and_lists_of_an_index_are_bounded(monkeypatch):
    monkeypatch.setattr(text_search, "_HELD", 6)
    monkeypatch.setattr(text_search, "_LISTED", 3)
    texts = [" b a b", "", " a", " a c", " ö a", " a", " a", " a"]
    ids = [7, 3, 5, 1, 0, 2, 4, 6]
    batches = [pa.RecordBatch.from_pydict({"id": ids[i : i + 2], "words": texts[i : i + 2]}) for i in range(0, 8, 2)]
    rows = [r for b in text_search._segments(iter(batches)) for r in b.to_pylist()]
    got = [(r["term"], *x) for r in rows for x in zip(r["id"], r["tf"], r["dl"], strict=True)]
    assert sorted(x for x in got if x[0]) == [("a", 0, 1, 2), ("a", 1, 1, 2), ("a", 2, 1, 1), ("a", 4, 1, 1), ("a", 5, 1, 1), ("a", 6, 1, 1), ("a", 7, 1, 3), ("b", 7, 2, 3), ("c", 1, 1, 2), ("ö", 0, 1, 2)]
    assert sorted((i, dl) for term, i, _, dl in got if not term) == [(0, 2), (1, 2), (2, 1), (3, 0), (4, 1), (5, 1), (6, 1), (7, 3)]
    assert max(len(r["id"]) for r in rows) <= 3
    keys = [(r["term"], r["id"]) for r in rows]
    assert sum(a > b for a, b in zip(keys, keys[1:])) == 1  # two segments, each in order
    assert list(text_search._segments(iter([]))) == []


def test_parsing_is_dealt_out_and_done_once(spark, tmp_path):
    files = spark.createDataFrame([(f"a{i}.go", "go", bytearray(b"package p\nfunc f() { g() }\n")) for i in range(400)], "path string, language string, content binary").coalesce(1)
    tasks = indexing.parse(files).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 200
    spark.range(60).select(F.col("id").alias("c_custkey"), (F.col("id") % 7).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalogue.queries()["parse_languages"](spark, str(tmp_path))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("MapInArrow") == 1 and found.where("type = 'IMPORT'").count() == 50
