"""Vector, keyword and hybrid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hybrid, text_search, vector
from .registry import query, table

TERMS = ("license", "stupid", "reand", "que", "keit")
_QUERY = " ".join(TERMS)
_VALUES = ", ".join(f"('{t}')" for t in TERMS)


def _bm25_sql(corpus: str) -> str:
    return f"""
WITH t AS ({corpus}), d AS (SELECT id, toks, len(toks) AS dl FROM t), q(term) AS (VALUES {_VALUES}),
tf AS (SELECT id, dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d)
SELECT id AS doc_id, round(sum(ln((n - df + 5e-1) / (df + 5e-1) + 1) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 10
"""


@query(_bm25_sql("SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents"))
def bm25_search(spark, d):
    return text_search.bm25(table(spark, d, "documents"), _QUERY)


@query(
    """
WITH t AS (SELECT event_id AS id, regexp_extract_all(lower(event_type || ' ' || json_extract_string(props, '$.k')), '[a-z0-9]+') AS toks
           FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'),
d AS (SELECT id, toks, len(toks) AS dl FROM t), q(term) AS (VALUES ('error'), ('9'), ('purchase')),
tf AS (SELECT id, dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d)
SELECT id AS event_id, round(sum(ln((n - df + 5e-1) / (df + 5e-1) + 1) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score
FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20
"""
)
def bm25_time_range(spark, d):
    from ..operators import memory

    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.from_json("props", "map<string,string>").alias("metadata"), F.col("ts").alias("time"))
    return memory.search(events, "error 9 purchase", 20, "2024-01-05", "2024-01-12").withColumnRenamed("id", "event_id")


@query(
    r"""
WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3) AS toks FROM documents),
d AS (SELECT id, toks, len(toks) AS dl FROM t), q(term, w) AS (VALUES ('license', 2), ('été', 1), ('über', 1)),
tf AS (SELECT id, dl, term, w, len(list_filter(toks, lambda x: x = term))::DOUBLE AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d),
s AS (SELECT id, round(sum(CASE WHEN df > 0 THEN w * ln((n + 1) / df) * (1 + tf * 25e-1 / (15e-1 * (25e-2 + 75e-2 * dl / avgdl) + tf)) ELSE 0 END), 6) AS score
      FROM tf JOIN df USING (term), n GROUP BY id)
SELECT id AS doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10
"""
)
def bm25plus_search(spark, d):
    return text_search.bm25_plus(table(spark, d, "documents"), "license license été über")


@query(
    r"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term
"""
)
def term_frequencies(spark, d):
    index = text_search.term_frequencies(table(spark, d, "documents"))
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def _memories(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.concat(F.lit("s"), "label").alias("source"), (F.col("vec_id") % 10 / F.lit(10.0)).alias("behaviour_score"),
        (F.col("vec_id") % 17 == 3).alias("deprecated"), F.when(F.col("vec_id") % 13 == 5, F.lit(True)).alias("suppressed"), (F.col("vec_id") % 7 / F.lit(10.0) + F.lit(0.2)).alias("importance"),
    )


_QV = [round(((i * 37) % 17 - 8) / 40, 4) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x}e0" if "e" not in str(x) else str(x) for x in _QV) + "]::DOUBLE[]"
_M = "SELECT vec_id AS row_id, embedding::DOUBLE[] AS e, label, vec_id % 10 / 10e0 AS behaviour_score, NOT (vec_id % 17 = 3) AND NOT (vec_id % 13 = 5) AS live, vec_id % 7 / 10e0 + 2e-1 AS importance FROM embeddings"
_D2 = f"list_sum(list_transform(list_zip(e, {_QSQL}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = f"list_sum(list_transform(list_zip(e, {_QSQL}), lambda z: z[1] * z[2]))"


@query(f"SELECT row_id, round({_D2}, 6) AS d2, round(greatest(0, 1 - {_D2} / 2), 4) AS score FROM ({_M}) ORDER BY {_D2}, row_id LIMIT 10")
def vec_l2_topk(spark, d):
    return vector.knn(_memories(spark, d), _QV, 10).select("row_id", F.round("d2", 6).alias("d2"), "score")


@query(f"SELECT row_id, round(8e-1 * greatest(0, 1 - {_D2} / 2) + 2e-1 * behaviour_score, 4) AS combined FROM ({_M}) WHERE live ORDER BY {_D2}, row_id LIMIT 10")
def vec_scores(spark, d):
    return vector.knn_scored(vector.live(_memories(spark, d)), _QV, 10).select("row_id", "combined")


@query(f"SELECT row_id, round({_D2}, 6) AS d2 FROM ({_M}) WHERE live AND label = 3 ORDER BY {_D2}, row_id LIMIT 7")
def vec_filtered(spark, d):
    rows = vector.of_source(vector.live(_memories(spark, d)), "s3")
    return vector.knn(rows, _QV, 7).select("row_id", F.round("d2", 6).alias("d2"))


@query(f"SELECT row_id, round(c, 6) AS cosine FROM (SELECT row_id, {_DOT} / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform({_QSQL}, lambda x: x * x)))) AS c FROM ({_M})) WHERE c > 5e-2 ORDER BY c DESC, row_id LIMIT 50")
def vec_cosine_threshold(spark, d):
    return vector.knn_cosine(_memories(spark, d), _QV, 50, least=0.05).select("row_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT row_id, round({_DOT}, 6) AS score FROM ({_M}) ORDER BY {_DOT} DESC, row_id LIMIT 10")
def vec_inner_product(spark, d):
    return vector.knn_inner(_memories(spark, d), _QV, 10).select("row_id", F.round("inner", 6).alias("score"))


@query(f"SELECT source, row_id, place FROM (SELECT 's' || label AS source, row_id, row_number() OVER (PARTITION BY label ORDER BY {_D2}, row_id) AS place FROM ({_M})) WHERE place <= 3")
def vec_topk_per_group(spark, d):
    return vector.knn_per_group(_memories(spark, d), _QV, "source", 3).select("source", "row_id", "place")


@query(f"SELECT source_repo, row_id, round(d2, 6) AS d2 FROM (SELECT 's' || label AS source_repo, row_id, {_D2} AS d2, row_number() OVER (PARTITION BY label ORDER BY {_D2}, row_id) AS place FROM ({_M}) WHERE live) WHERE place <= 5 ORDER BY d2, source_repo, row_id LIMIT 5")
def cross_store_search(spark, d):
    return hybrid.across_stores(_memories(spark, d), _QV, 5, "source").select("source_repo", "row_id", F.round("d2", 6).alias("d2"))


@query(f"SELECT row_id, name, round(s, 4) AS vector_score FROM (SELECT *, greatest(0, 1 - d2 / 2) * w AS s, row_number() OVER (PARTITION BY name ORDER BY d2, row_id) AS k FROM (SELECT row_id, 'n' || row_id % 9 AS name, CASE row_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 75e-2 ELSE 5e-1 END AS w, {_D2} AS d2 FROM ({_M}) ORDER BY d2, row_id LIMIT 20)) WHERE k = 1 ORDER BY d2, row_id LIMIT 10")
def symbol_knn_weighted(spark, d):
    rows = _memories(spark, d).withColumn("name", F.concat(F.lit("n"), F.col("row_id") % 9)).withColumn("weight", F.when(F.col("row_id") % 3 == 0, 1.0).when(F.col("row_id") % 3 == 1, 0.75).otherwise(0.5))
    return vector.knn_distinct(rows, _QV, 10, ["name"], "weight").select("row_id", "name", F.round("vector_score", 4).alias("vector_score"))


#: The rows that arrive: the query set of searches, every id divisible by 100, against all rows but itself.
_NEW = "row_id % 100 = 0"
_PAIR = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(f"""
WITH m AS ({_M}), p AS (
    SELECT a.row_id AS query_id, b.row_id, round({_PAIR}, 6) AS d2,
           row_number() OVER (PARTITION BY a.row_id ORDER BY {_PAIR}, b.row_id) AS place
    FROM m a, m b WHERE a.row_id % 100 = 0)
SELECT query_id, row_id, d2, place FROM p WHERE place <= 5""")
def vec_batch_knn(spark, d):
    rows = _memories(spark, d)
    queries = rows.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "embedding")
    return vector.knn_join(queries, rows, 5).select("query_id", "row_id", F.round("d2", 6).alias("d2"), "place")


@query(f"""
WITH m AS ({_M}), p AS (
    SELECT a.row_id AS new_id, b.row_id, 1 - {_PAIR} / 2 AS s, a.importance AS new_i, b.importance AS old_i, b.label,
           row_number() OVER (PARTITION BY a.row_id ORDER BY {_PAIR}, b.row_id) AS place
    FROM m a, m b WHERE a.row_id % 100 = 0 AND b.row_id <> a.row_id)
SELECT row_id, new_id, round(s, 6) AS similarity FROM p WHERE place <= 5 AND s > 92e-2 AND NOT (label < 3 AND old_i >= new_i)""")
def near_dup_suppress(spark, d):
    rows = _memories(spark, d).withColumn("source", F.when(F.substring("source", 2, 3).cast("int") < 3, "auto_discovery").otherwise(F.col("source")))
    found = vector.suppressed_by(rows.where(_NEW), rows)
    return found.select("row_id", F.col("by").alias("new_id"), F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH m AS ({_M}), p AS (SELECT a.row_id, max(1 - {_PAIR} / 2) AS s FROM m a, m b WHERE a.row_id % 100 = 0 AND b.row_id <> a.row_id GROUP BY a.row_id)
SELECT row_id FROM p WHERE greatest(0, s) <= 85e-2""")
def novelty_gate(spark, d):
    rows = _memories(spark, d)
    return vector.novel(rows.where(_NEW), rows).select("row_id")


@query(r"""
SELECT doc_id, n, line, context FROM (
    SELECT doc_id, n, line, array_to_string(list_slice(lines, greatest(n - 2, 1), n + 2), chr(10)) AS context
    FROM (SELECT doc_id, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
WHERE contains(lower(line), 'license')""")
def grep_context(spark, d):
    return text_search.grep(table(spark, d, "documents"), "License")


@query("SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT min(p_name) FROM part WHERE p_partkey = 7)")
def symbol_lookup(spark, d):
    part = table(spark, d, "part")
    name = part.where("p_partkey = 7").agg(F.min("p_name")).first()[0]
    return text_search.lookup(part, name, "p_name").select("p_partkey", "p_name")


_TERMS = r"""list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z\x{00C0}-\x{024F}]+'), lambda w: lower(w)), lambda w: length(w) >= 3)"""


@query("SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z]{3,}')) AS word FROM part) GROUP BY word")
def word_postings(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("text"))
    return text_search.postings(part, ["p_partkey"]).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ed') OR contains(lower(p_name), 'gre')) AND contains(lower(p_name), 'b')")
def keyword_match(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return text_search.keyword_match(text_search.keyword_match(part, "ed GRE", "p_name"), "b", "p_name").select("p_partkey")


@query("""
WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line FROM lineitem),
s AS (SELECT l_orderkey AS file, l_linenumber AS start_line, l_linenumber + (l_partkey % 4)::INT AS end_line, 'p' || l_partkey AS name FROM lineitem)
SELECT file, line, name FROM (SELECT l.file, l.line, s.name, row_number() OVER (PARTITION BY l.file, l.line ORDER BY s.start_line DESC, s.end_line, s.name) AS k
FROM (SELECT DISTINCT * FROM l) l JOIN s ON s.file = l.file AND s.start_line <= l.line AND s.end_line >= l.line) WHERE k = 1""")
def containing_symbol(spark, d):
    items = table(spark, d, "lineitem")
    lines = items.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).distinct()
    symbols = items.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + (F.col("l_partkey") % 4).cast("int")).alias("end_line"), F.concat(F.lit("p"), "l_partkey").alias("name"))
    return text_search.containing_symbol(lines, symbols).select("file", "line", "name")


_CANDIDATES = f"""
v AS (SELECT 'd' || row_id AS id, greatest(0, 1 - {_D2} / 2) AS vector_score, 0 AS priority FROM ({_M}) WHERE live ORDER BY {_D2}, row_id LIMIT 60),
x AS (SELECT 'd' || doc_id AS id, 0e0 AS vector_score, 1 AS priority FROM documents WHERE contains(lower(text), 'license')),
c AS (SELECT id, max(vector_score) AS vector_score, min(priority) AS priority FROM (SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY id),
h AS (SELECT 'd' || (l_partkey - 1) AS id, min(l_linenumber) AS hops FROM lineitem GROUP BY l_partkey),
n AS (SELECT 'd' || (l_partkey - 1) AS id, count(*) AS n FROM lineitem GROUP BY l_partkey),
f AS (SELECT c.id, round(5e-1 * round(c.vector_score, 4) + 3e-1 * coalesce(1e0 / (1 + hops), 0) + 2e-1 * ln(1 + coalesce(n, 0)::DOUBLE) / ln(1 + (SELECT max(n) FROM n)::DOUBLE), 4) AS final_score, CASE priority WHEN 0 THEN 'vector' ELSE 'ast' END AS source
      FROM c LEFT JOIN h ON h.id = c.id LEFT JOIN n ON n.id = c.id)
"""


def _hybrid(spark, d, k):
    near = vector.knn(vector.live(_memories(spark, d)), _QV, 60)
    none = F.lit(None).cast("string")
    a = near.select(F.concat(F.lit("d"), "row_id").alias("id"), F.concat(F.lit("d"), "row_id").alias("symbol"), none.alias("text"), F.lit("vector").alias("source"), F.col("score").alias("vector_score"), F.lit(0).alias("priority"))
    docs = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    b = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("symbol"), none.alias("text"), F.lit("ast").alias("source"), F.lit(0.0).alias("vector_score"), F.lit(1).alias("priority"))
    items = table(spark, d, "lineitem")
    part = F.concat(F.lit("d"), F.col("l_partkey") - 1)
    hops = items.groupBy(part.alias("node")).agg(F.min("l_linenumber").alias("hops"))
    counts = items.groupBy(part.alias("symbol")).agg(F.count("*").alias("n"))
    return hybrid.score(hybrid.merge(a, b), hops, counts, k)


@query(f"WITH {_CANDIDATES} SELECT id, source, final_score FROM f ORDER BY final_score DESC, id LIMIT 20")
def hybrid_rank(spark, d):
    return _hybrid(spark, d, 20).select("id", "source", "final_score")


@query(f"WITH {_CANDIDATES}, t AS (SELECT * FROM f ORDER BY final_score DESC, id LIMIT 20) SELECT id, final_score, (SELECT max(final_score) FROM t) < 99e-2 AS cold_fallback FROM t WHERE final_score >= 99e-2 OR (SELECT max(final_score) FROM t) < 99e-2")
def min_score_fallback(spark, d):
    return hybrid.with_least(_hybrid(spark, d, 20), 0.99).select("id", "final_score", "cold_fallback")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'doc' ELSE 'code' END AS bucket, CASE WHEN p_partkey % 3 <> 0 THEN 'FUNCTION' END AS kind,
       CASE WHEN p_partkey % 3 <> 0 THEN 'f' || p_partkey END AS name, CASE WHEN p_partkey % 3 <> 0 THEN 'src/m' || p_size || '.py' END AS file,
       CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS line, CASE WHEN p_size / 50e0 >= 6e-1 THEN 'high' WHEN p_size / 50e0 >= 35e-2 THEN 'medium' ELSE 'low' END AS confidence
FROM part""")
def structured_split(spark, d):
    part = table(spark, d, "part")
    code = F.concat(F.lit("FUNCTION f"), "p_partkey", F.lit(" in src/m"), "p_size", F.lit(".py:"), "p_size", F.lit(" — doc"))
    rows = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(code).alias("text"), (F.col("p_size") / F.lit(50.0)).alias("final_score"))
    return hybrid.structured(rows).select("id", "bucket", "kind", "name", "file", "line", "confidence")


@query("SELECT min_by(p_partkey, (-p_size, p_partkey)) AS id FROM part GROUP BY p_partkey % 97")
def result_dedup(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("CLASS x in m.py:"), F.col("p_partkey") % 97).alias("text"), F.col("p_size").alias("final_score"))
    return hybrid.without_repeats(rows).select("id")


@query(r"SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name), '[_\-.0-9\s]+'), lambda x: length(x) >= 3), ' ') AS tokens FROM part")
def identifier_words(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.identifier_tokens(F.lower("p_name")), " ").alias("tokens"))


_NOTE = "'Decision: for the billing service we chose plan ' || row_id"


@query(f"""WITH m AS (SELECT 'memory::' || sha256({_NOTE}) AS id, 'vector' AS kind, greatest(0, 1 - {_D2} / 2) AS v FROM ({_M}) WHERE live ORDER BY {_D2}, row_id LIMIT 60),
x AS (SELECT p_brand || '::' || p_type AS id, 'ast' AS kind, 0e0 AS v FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_brand, p_type),
n AS (SELECT p_brand || '::' || p_type AS id, count(*) AS n FROM part GROUP BY 1),
h AS (SELECT 'Brand#11::PROMO' AS id, 1 AS hops UNION ALL SELECT id, 2 FROM m)
SELECT id, kind, round(4e-1 * round(v, 4) + 3e-1 * coalesce(1e0 / (1 + hops), 0) + 3e-1 * ln(1 + coalesce(n, 0)::DOUBLE) / ln(1 + (SELECT max(n) FROM n)::DOUBLE), 4) AS final_score
FROM (SELECT * FROM m UNION ALL SELECT * FROM x) LEFT JOIN n USING (id) LEFT JOIN h USING (id) ORDER BY final_score DESC, id LIMIT 20""")
def hybrid_memories(spark, d):
    """The whole retrieval over memories whose texts begin alike: none of them stands for another."""
    notes = _memories(spark, d).withColumn("text", F.concat(F.lit("Decision: for the billing service we chose plan "), "row_id")).withColumn("source", F.lit("vector"))
    parts = table(spark, d, "part")
    symbols = parts.select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.lit("CLASS").alias("type"), F.col("p_partkey").alias("start_line"), F.lit("").alias("docstring"))
    vectors = symbols.limit(0).withColumns({"row_id": F.lit(0), "source": F.lit("symbol"), "weight": F.lit(1.0), "embedding": F.array(F.lit(0.0))})
    counts = parts.groupBy(F.concat("p_brand", F.lit("::"), "p_type").alias("symbol")).agg(F.count("*").alias("n"))
    concept = notes.select(F.concat(F.lit("concept::"), F.lower(F.substring("text", 1, 40))).alias("dst")).distinct()
    edges = concept.select(F.lit("Brand#11::PROMO").alias("src"), "dst").unionByName(concept.select(F.lit("PROMO").alias("src"), F.lit("Brand#11::PROMO").alias("dst")))
    found = hybrid.retrieve(notes, symbols, vectors, edges, counts, _QV, ["ECONOMY", "PROMO"], 20, {"vector": 0.4, "graph": 0.3, "behaviour": 0.3})
    return found.select("id", F.col("source").alias("kind"), "final_score")
