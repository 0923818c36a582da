"""Retrieval, graph building, behaviour and session queries that complete the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, scores
from ..functions import text as T
from ..operators import behaviour, graph, hybrid, indexing, memory, metrics, packing, text_search
from ..session import shared_dir
from ..sources.files import search_extensions
from ..sources.vector_store import ExactStore
from ..workspace import resolutions
from .graphs import _E, _edges, _nodes, _org
from .memories import _aged, _as_of, _case_types, _learnings
from .registry import SQL, query, table
from .search import _D2, _M, _QUERY, _QV, _memories

_INDEXES: dict[tuple, text_search.TextIndex] = {}


def _index(spark, d, unicode_words: bool) -> text_search.TextIndex:
    """An index over the documents, built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, d, unicode_words)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/larkspur-index-{uuid.uuid4().hex}"
        _INDEXES[key] = text_search.TextIndex.build(table(spark, d, "documents"), path, unicode_words=unicode_words)
    return _INDEXES[key]


@query(SQL["bm25_search"])
def bm25_indexed(spark, d):
    return _index(spark, d, False).search(_QUERY).withColumnRenamed("id", "doc_id")


@query(SQL["bm25plus_search"])
def bm25plus_indexed(spark, d):
    return _index(spark, d, True).search_plus("license license été über").withColumnRenamed("id", "doc_id")


# ── order over whole tables ─────────────────────────────────────────────────────────────────────────────────────────


@query("SELECT event_id AS id, lag(event_id) OVER (ORDER BY ts, event_id) AS prev FROM events")
def event_chain(spark, d):
    return memory.with_previous(table(spark, d, "events"), "event_id", "ts").select(F.col("event_id").alias("id"), "prev")


@query("SELECT max(v) FILTER (WHERE k = least(50 * n // 100, n - 1)) AS p50, max(v) FILTER (WHERE k = least(95 * n // 100, n - 1)) AS p95, max(v) FILTER (WHERE k = least(99 * n // 100, n - 1)) AS p99 FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)")
def percentiles_overall(spark, d):
    return metrics.percentiles(table(spark, d, "lineitem"), "l_extendedprice")


# ── retrieval ───────────────────────────────────────────────────────────────────────────────────────────────────────

_LETTERS = "translate({}::VARCHAR, '0123456789', 'qzxjkvbwyp')"
#: (question, its entities); ``@`` stands for a conversation in letters, ``~`` for a turn.
_ASKED = (
    ("what is fetch_@ in store/app_~.py", "fetch_@,store/app_~.py"), ("fix parseTree@ now", "parseTree@,parse,tree@"), ("nothing to see @", ""),
    ("a_b@ and HTTPServer~", "a_b@,HTTPServer~,http,server~"), ("", ""),
)
_PARTS = r"regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')"


@query(rf"""WITH a AS (SELECT conv_id, turn, kind, replace(replace(names, '@', {_LETTERS.format('conv_id')}), '~', {_LETTERS.format('turn')}) AS names
    FROM conversations, (VALUES {', '.join(f"({k}, '{names}')" for k, (_, names) in enumerate(_ASKED))}) v(kind, names)),
t AS (SELECT conv_id, turn, flatten(list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r,;:()\[\]{{}}''"]+'), lambda w: regexp_replace(w, '^\.+|\.+$', '', 'g')), lambda w: length(w) >= 2),
    lambda t: list_concat(
        CASE WHEN regexp_matches(t, '^[0-9A-Za-z_][0-9A-Za-z_/]*\.[0-9A-Za-z_]{{1,6}}([^0-9_\p{{L}}\p{{Nd}}]|$)') OR contains(t, '_') AND regexp_full_match(replace(t, '_', ''), '\p{{L}}+') OR regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') THEN [t] ELSE [] END,
        CASE WHEN regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') THEN list_filter(string_split(lower({_PARTS}), '_'), lambda w: length(w) > 2) ELSE [] END))) AS l FROM conversations)
SELECT * FROM a UNION ALL SELECT conv_id, turn, {len(_ASKED)}, array_to_string(list_filter(l, lambda w, i: list_position(l, w) = i), ',') FROM t""")
def query_entities(spark, d):
    """Entities of questions of every kind for each turn, and of the whole text of the turn itself."""
    letters = lambda c: F.translate(F.col(c).cast("string"), "0123456789", "qzxjkvbwyp")
    filled = [F.replace(F.replace(F.lit(q), F.lit("@"), letters("conv_id")), F.lit("~"), letters("turn")) for q, _ in _ASKED]
    asked = F.posexplode(F.array(*filled, F.coalesce("text", F.lit("")))).alias("kind", "asked")
    return table(spark, d, "conversations").select("conv_id", "turn", asked).select("conv_id", "turn", "kind", F.array_join(T.entities("asked"), ",").alias("names"))


@query("SELECT doc_id FROM documents WHERE length(text) <= 5000")
def query_length(spark, d):
    """Documents that are short enough to be queries."""
    return hybrid.admitted(table(spark, d, "documents"), "text", 5000).select("doc_id")


@query(f"SELECT row_id, round({_D2}, 6) AS d2 FROM ({_M}) WHERE live AND label = 3 ORDER BY {_D2}, row_id LIMIT 7")
def store_search(spark, d):
    """Search in a vector store after deprecations and suppressions, some of them compacted."""
    store, rows = ExactStore(spark, f"{shared_dir(spark)}/larkspur-store-{uuid.uuid4().hex}"), _memories(spark, d)
    at = F.lit("2024-01-01").cast("timestamp")
    store.add(rows.drop("deprecated", "suppressed"))
    dead = rows.where("deprecated").select("row_id", F.lit("deprecated").alias("kind"), F.lit("").alias("reason"), F.lit(None).cast("double").alias("similarity"), at.alias("at"))
    store.marks.append(dead)
    store.compact()
    store.marks.append(rows.where("suppressed").select("row_id", F.lit("suppressed").alias("kind"), F.lit("copy").alias("reason"), F.lit(0.9).alias("similarity"), at.alias("at")))
    return store.search(_QV, 7, "s3").select("row_id", F.round("d2", 6).alias("d2"))


@query("""WITH q AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, lower(regexp_extract(coalesce(text, ''), '[a-zA-Z]{5,}')) AS w FROM conversations WHERE regexp_matches(coalesce(text, ''), '[a-zA-Z]{5,}'))
SELECT conv_id, turn, ['lookup_symbol', 'who_calls', 'list_files', 'graph_stats', 'dependency_graph', NULL][k + 1] AS tool, CASE WHEN k IN (0, 1, 4) THEN w END AS argument FROM q""")
def resolved_questions(spark, d):
    """Questions that a tool answers by itself, and its argument, for every turn."""
    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[a-zA-Z]{5,}", 0))
    texts = (("Where is ", " defined?"), ("who calls ", "?"), ("List all files", ""), ("graph stats", ""), ("what depends on ", "?"), ("tell me of ", " in other words"))
    asked = F.element_at(F.array(*[F.concat(F.lit(a), word if i in (0, 1, 4, 5) else F.lit(""), F.lit(b)) for i, (a, b) in enumerate(texts)]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    rows = table(spark, d, "conversations").where(word != "").select("conv_id", "turn", asked.alias("question"))
    return resolutions(rows).select("conv_id", "turn", "tool", "argument")


@query("SELECT conv_id, turn, regexp_matches(lower(text), '\\b(how does|overview|architecture|what is|explain|describe|why does|design|purpose|history|background|changelog|readme|documentation)\\b') AS doc FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Explain ' || text ELSE text END AS text FROM conversations)")
def doc_intent(spark, d):
    asked = table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Explain "), "text")).otherwise(F.col("text")))
    return asked.select("conv_id", "turn", F.col("text").rlike(rules.DOC_INTENT).alias("doc"))


@query("""WITH r AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'code' ELSE 'doc' END AS bucket, p_partkey % 100 / 4e2 AS v FROM part),
b AS (SELECT max(v) FILTER (WHERE bucket = 'code') AS code, coalesce(max(v) FILTER (WHERE bucket = 'doc'), 0) AS doc FROM r WHERE p_brand = 'Brand#13')
SELECT coalesce(code < 25e-2, false) AND doc < 25e-2 AS low FROM b UNION ALL SELECT false FROM b""")
def confidence_gate(spark, d):
    """Whether results, the parts of one brand, are too weak to answer from; for a question about documents they never are."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("CLASS n"), "p_partkey", F.lit(" in app.py:"), "p_size")).otherwise(F.concat(F.lit("a note on "), "p_name"))
    rows = table(spark, d, "part").where("p_brand = 'Brand#13'").select(text.alias("text"), (F.col("p_partkey") % 100 / F.lit(400.0)).alias("vector_score"), F.lit(0.5).alias("final_score"))
    return hybrid.low_confidence(rows, "where is Store").unionByName(hybrid.low_confidence(rows, "explain Store"))


@query("""SELECT p_brand || '::' || p_type AS id, 'CLASS ' || p_type || ' in ' || p_brand || ':' || min(p_partkey) || ' — Sizes.' AS text FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY p_brand, p_type""")
def symbols_by_name(spark, d):
    """Exact matches of a query's entities: the first symbol of each file and name."""
    symbols = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.lit("CLASS").alias("type"), F.col("p_partkey").alias("start_line"), F.lit("Sizes.").alias("docstring"))
    return hybrid.from_names(symbols, ["ECONOMY", "PROMO"]).select("id", "text")


@query(f"SELECT row_id, round(greatest(0, 1 - {_D2} / 2), 4) AS score FROM ({_M}) WHERE row_id % 3 = 0 ORDER BY {_D2}, row_id LIMIT 10")
def symbol_search(spark, d):
    """Nearest symbols of one language: files of other extensions take no part."""
    rows = _memories(spark, d).withColumn("source", F.lit("symbol")).withColumn("file", F.when(F.col("row_id") % 3 == 0, "a.py").otherwise("b.go"))
    return hybrid.symbol_search(rows, _QV, 10, search_extensions("python")).select("row_id", "score")


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#13' AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#13')")
def index_fast_path(spark, d):
    """Documents that a symbol index names for a word, each once."""
    part = table(spark, d, "part")
    docs = part.select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), F.col("p_partkey")).alias("file"))
    index = part.select(F.col("p_brand").alias("name"), F.concat("p_brand", F.lit("/"), F.col("p_partkey")).alias("file"))
    return text_search.fast_path(docs, index.unionByName(index), "Brand#13").select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#13'")
def symbol_lookup_any_case(spark, d):
    return text_search.lookup(table(spark, d, "part"), "bRAND#13", "p_brand", ignore_case=True).select(F.col("p_partkey").alias("id"))


@query("SELECT doc_id AS id, array_to_string(list_slice(l, greatest(doc_id % 4 - 1, 1), doc_id % 4 + 3), chr(10)) AS shown FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def line_window(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), text_search.window_around(docs, (F.col("doc_id") % 4 + 1).cast("int"), 2).alias("shown"))


@query("SELECT c_custkey AS id, tier, top_k, episodes FROM (SELECT c_custkey, (c_custkey % 5)::INT AS k FROM customer) JOIN (VALUES (0, 'QUICK', 4, 1), (1, 'STANDARD', 5, 3), (2, 'COMPLEX', 10, 5), (3, 'EXPERT', 20, 10), (4, 'ODD', 4, 1)) v(k, tier, top_k, episodes) USING (k)")
def tier_sizes(spark, d):
    """How much each customer's tier fetches, at least what is asked for."""
    tier = F.element_at(F.array(*map(F.lit, ("QUICK", "STANDARD", "COMPLEX", "EXPERT", "ODD"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), tier.alias("tier"))
    return rows.select("id", "tier", rules.tier_retrieval("tier", 4, 1).alias("x")).select("id", "tier", "x.top_k", "x.episodes")


@query("""SELECT kind, place FROM (SELECT kind, place, sum(length(text) // 4) OVER (ORDER BY CASE kind WHEN 'memory' THEN 0 WHEN 'graph' THEN 1 ELSE 2 END, place) AS upto
FROM (SELECT ['memory', 'graph', 'episode'][(doc_id % 3 + 1)::INT] AS kind, doc_id AS place, text FROM documents WHERE text IS NOT NULL)) WHERE upto <= 12000""")
def bundle_trim(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("memory", "graph", "episode"))), (F.col("doc_id") % 3 + 1).cast("int"))
    parts = table(spark, d, "documents").where("text is not null").select(kinds.alias("kind"), F.col("doc_id").alias("place"), "text")
    return packing.trim_bundle(parts, "COMPLEX").select("kind", "place")


# ── graph building ──────────────────────────────────────────────────────────────────────────────────────────────────


@query("""WITH c AS (SELECT DISTINCT 'concept::' || CASE p_partkey % 3 WHEN 0 THEN 'len' WHEN 1 THEN 'print' ELSE p_name || p_size END AS id FROM part)
SELECT node, hops, type FROM (SELECT 'hub' AS node, 0 AS hops, 'FILE' AS type UNION ALL SELECT id, 1, 'CONCEPT' FROM c WHERE id NOT IN ('concept::len', 'concept::print'))""")
def ego_without_builtins(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, "len").when(F.col("p_partkey") % 3 == 1, "print").otherwise(F.concat("p_name", "p_size"))
    ids = table(spark, d, "part").select(F.concat(F.lit("concept::"), name).alias("id")).distinct()
    nodes = ids.select("id", F.lit("CONCEPT").alias("type")).unionByName(spark.createDataFrame([("hub", "FILE")], "id string, type string"))
    edges = ids.select(F.lit("hub").alias("src"), F.col("id").alias("dst"), F.lit("USES").alias("rel"))
    return graph.ego(nodes, edges, "hub", 1)[0].select("node", "hops", "type")


@query("SELECT n_nationkey AS n FROM nation WHERE n_nationkey % 5 = 1 AND n_nationkey % 4 <> 0")
def textual_callers(spark, d):
    """Lines that mention a function other than to define it."""
    key = F.col("n_nationkey")
    line = F.when(key % 4 == 0, F.concat(F.lit("  async def job_"), key % 5, F.lit("(x):"))).otherwise(F.concat(F.lit("  y = job_"), key % 5, F.lit("(1) + job_"), key + 10))
    return graph.textual_callers(table(spark, d, "nation").select(key.alias("n"), line.alias("line")), "job_1").select("n")


@query("SELECT DISTINCT p_brand || '/m' || p_size || '.py' AS path FROM part WHERE p_size = 7")
def module_resolution(spark, d):
    return graph.resolve_module(table(spark, d, "part").select(F.concat("p_brand", F.lit("/m"), "p_size", F.lit(".py")).alias("path")).distinct(), "m7.py")


@query("""WITH s AS (SELECT 'f' || n_regionkey || '.py' AS file, n_name AS name, n_nationkey % 2 = 0 AS c, 'symbol::Base' || n_regionkey AS base, 'symbol::g' || n_regionkey AS callee FROM nation)
SELECT file || '::' || name AS src, file AS dst, 'DEFINED_IN' AS rel FROM s UNION SELECT file || '::' || name, base, 'INHERITS' FROM s WHERE c
UNION SELECT file || '::' || name, callee, 'CALLS' FROM s WHERE NOT c UNION SELECT callee, file || '::' || name, 'CALLED_BY' FROM s WHERE NOT c""")
def edge_build(spark, d):
    even, none = F.col("n_nationkey") % 2 == 0, F.array().cast("array<string>")
    symbols = table(spark, d, "nation").select(
        F.concat(F.lit("f"), "n_regionkey", F.lit(".py")).alias("file"), F.col("n_name").alias("name"), F.when(even, "CLASS").otherwise("FUNCTION").alias("type"),
        F.when(even, F.array(F.concat(F.lit("Base"), "n_regionkey"))).otherwise(none).alias("bases"), F.when(even, none).otherwise(F.array(F.concat(F.lit("g"), "n_regionkey"))).alias("calls"),
    )
    return graph.symbol_edges(symbols).select("src", "dst", "rel")


@query("""SELECT DISTINCT 'f' || n_nationkey AS src, 'r' || n_regionkey || '/m' || (n_nationkey % 4) || CASE n_nationkey % 4 WHEN 1 THEN '/__init__.py' ELSE '.py' END AS dst FROM nation WHERE n_nationkey % 4 <> 3""")
def import_resolution(spark, d):
    """Modules by file, then by package; where both exist the file, where none does nothing."""
    nation = table(spark, d, "nation")
    found = nation.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), F.concat(F.lit("..r"), "n_regionkey", F.lit(".m"), F.col("n_nationkey") % 4).alias("module"))
    tails = F.explode(F.array(*map(F.lit, ("/m0.py", "/m1/__init__.py", "/m2.py", "/m2/__init__.py"))))
    return graph.resolve_imports(found, table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("r"), tails.alias("t")).select(F.concat("r", "t").alias("path")))


@query("SELECT DISTINCT 'd' || p_size || '/' || ['main.py', 'util.py', 'app.js', 'x.rb'][(p_partkey % 4 + 1)::INT] AS path FROM part WHERE p_partkey % 4 IN (0, 2) UNION SELECT 'cmd/' || p_size || '/main.go' FROM part")
def entry_points(spark, d):
    part = table(spark, d, "part")
    name = F.element_at(F.array(*map(F.lit, ("main.py", "util.py", "app.js", "x.rb"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    paths = part.select(F.concat(F.lit("d"), "p_size", F.lit("/"), name).alias("path")).unionByName(part.select(F.concat(F.lit("cmd/"), "p_size", F.lit("/main.go")).alias("path")))
    return graph.entry_points(paths.distinct())


@query("SELECT DISTINCT 'r' || n_regionkey AS src, 'r' || (n_regionkey + 1) % 5 AS dst FROM nation WHERE n_nationkey % 3 <> 0")
def inferred_links(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    wanted = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey")).otherwise((F.col("n_regionkey") + 1) % 5)
    named = region.select(F.col("r_regionkey").alias("k"), F.regexp_replace("r_name", r"\W", "_").alias("name"))
    imported = nation.withColumn("k", wanted).join(named, "k").select(F.concat(F.lit("r"), "n_regionkey").alias("repo"), F.concat("name", F.lit(".core.io")).alias("module"))
    return graph.inferred_links(imported, named.select(F.concat(F.lit("r"), "k").alias("path"), "name"))


@query("""WITH RECURSIVE l AS (SELECT 'n' || s_nationkey AS src, 'n' || (s_suppkey % 25) AS dst FROM supplier), u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
b(node, hops) AS (SELECT 'n1', 0 UNION SELECT u.dst, b.hops + 1 FROM b JOIN u ON u.src = b.node WHERE b.hops < 2), m AS (SELECT node, min(hops) AS hops FROM b GROUP BY node HAVING min(hops) > 0)
SELECT m.node AS repo, m.hops, (SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE 'n' || c_nationkey = m.node) AS symbols FROM m""")
def org_traverse(spark, d):
    symbols = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("repo"), F.col("c_mktsegment").alias("name"))
    return graph.traverse(_org(spark, d), symbols, "n1", "both", 2).select("repo", "hops", F.array_join("symbols", ",").alias("symbols"))


@query("""SELECT 'Graph nodes:' || chr(10) || (SELECT string_agg('  ' || r_name || ' [FILE]  (' || r_regionkey || ' hop' || CASE WHEN r_regionkey <> 1 THEN 's' ELSE '' END || ' away)', chr(10) ORDER BY r_name) FROM region)
|| chr(10) || 'Relationships:' || chr(10) || (SELECT string_agg('  ' || n_name || ' --IN--> r' || n_regionkey, chr(10) ORDER BY n_name || ' r' || n_regionkey) FROM nation) AS text""")
def graph_text(spark, d):
    nodes = table(spark, d, "region").select(F.col("r_name").alias("node"), F.lit("FILE").alias("type"), F.col("r_regionkey").alias("hops"))
    edges = table(spark, d, "nation").select(F.col("n_name").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("IN").alias("rel"))
    return graph.describe(nodes, edges)


@query("SELECT 'memory::' || n_nationkey AS src, 'concept::' || unnest(['load_table', CASE WHEN n_nationkey % 2 = 0 THEN 'store/io.py' ELSE 'open_file' END]) AS dst FROM nation")
def memory_links(spark, d):
    text = F.concat(F.lit("uses load_table, then "), F.when(F.col("n_nationkey") % 2 == 0, "store/io.py").otherwise("open_file"))
    return graph.memory_links(table(spark, d, "nation").select(F.col("n_nationkey").alias("row_id"), text.alias("text"))).select("src", "dst")


@query("SELECT 'n' || n_nationkey AS path FROM nation WHERE n_regionkey < 3")
def repo_purge(spark, d):
    nation = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), "n_regionkey")
    return graph.purge(nation, nation.where("n_regionkey < 3")).select("path")


# ── behaviour ───────────────────────────────────────────────────────────────────────────────────────────────────────


@query(f"""WITH q AS (SELECT {_case_types('lower(trim(text))')} AS t FROM conversations WHERE role = 'user'), k AS (SELECT t, count(*) AS n FROM q GROUP BY t ORDER BY n DESC, t LIMIT 1),
w AS (SELECT * FROM ({SQL['terminology']}) ORDER BY n DESC, term LIMIT 10)
SELECT (SELECT t FROM k) AS top_question_type, (SELECT string_agg(term, ',' ORDER BY n DESC, term) FROM w) AS top_terms, (SELECT round(100e0 * avg((p_partkey % 3 = 0)::INT), 1) FROM part) AS code_focus_pct""")
def user_profile(spark, d):
    hits = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "a.py::x").otherwise("note").alias("symbol"))
    found = behaviour.profile(table(spark, d, "conversations").where("role = 'user'"), hits)
    return found.select("top_question_type", F.array_join("top_terms", ",").alias("top_terms"), "code_focus_pct")


@query(f"""WITH q AS (SELECT floor((row_number() OVER (ORDER BY conv_id, turn, text) - 1) / 10)::BIGINT AS block, length(text) AS l, {_case_types('lower(trim(text))')} AS t FROM conversations WHERE role = 'user'),
s AS (SELECT block, count(*) AS n, round(avg(l), 6) AS mean_length FROM q GROUP BY block HAVING count(*) = 10), m AS (SELECT block, t, count(*) AS c FROM q GROUP BY block, t)
SELECT s.block, s.n, s.mean_length, (SELECT t FROM m WHERE m.block = s.block ORDER BY c DESC, t LIMIT 1) AS question_type FROM s""")
def style_summary(spark, d):
    found = behaviour.style_summary(table(spark, d, "conversations").where("role = 'user'"), ["conv_id", "turn", "text"])
    return found.select("block", "n", F.round("mean_length", 6).alias("mean_length"), "question_type")


@query("""SELECT file, n, type, tag || ' in ' || file || ':' || n || ': ' || body AS text FROM (SELECT 'f' || n_regionkey AS file, n_nationkey AS n, ['TODO', 'FIXME', 'HACK', 'PLAIN'][n_nationkey % 4 + 1] AS tag,
['decision', 'bug', 'quirk', ''][n_nationkey % 4 + 1] AS type, 'look at ' || n_name || ' again' AS body FROM nation) WHERE tag <> 'PLAIN'""")
def comment_learnings(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ("todo", "FIXME", "Hack", "PLAIN"))), F.col("n_nationkey") % 4 + 1)
    line = F.concat(F.lit("x = 1  # "), tag, F.lit(": look at "), "n_name", F.lit(" again"))
    return behaviour.comment_learnings(table(spark, d, "nation").select(F.concat(F.lit("f"), "n_regionkey").alias("file"), F.col("n_nationkey").alias("n"), line.alias("line")))


@query("SELECT l_orderkey AS hash, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS added, count(*) FILTER (WHERE l_linenumber % 4 = 1) AS removed, count(*) FILTER (WHERE l_linenumber % 4 = 2) AS hunks FROM lineitem GROUP BY l_orderkey")
def diff_stats(spark, d):
    line = F.element_at(F.array(*map(F.lit, ("+new", "-old", "@@ -1 +1 @@", "+++ b/f"))), F.col("l_linenumber") % 4 + 1)
    return behaviour.diff_stats(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), line.alias("line")))


@query("SELECT count(DISTINCT n_regionkey) AS directories, count(*) AS files, 'go' AS dominant_language FROM nation")
def repo_rollup(spark, d):
    path = F.concat(F.lit("d"), "n_regionkey", F.lit("/f"), "n_nationkey")
    nation = table(spark, d, "nation")
    symbols = nation.select(path.alias("file"), F.col("n_name").alias("name"), F.lit("FUNCTION").alias("type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("").alias("docstring"))
    found = nation.select(path.alias("path"), F.lit("go").alias("language"))
    return indexing.repository_summary(indexing.directory_summaries(indexing.file_summaries(symbols, found)))


@query(f"""WITH {_E} SELECT 'graph' AS section, 1 AS place, (SELECT count(*) FROM nodes) || ' nodes, ' || (SELECT count(*) FROM e) || ' edges' AS item
UNION ALL SELECT 'decisions', row_number() OVER (ORDER BY n_nationkey DESC), n_name FROM nation WHERE n_nationkey >= (SELECT max(n_nationkey) - 2 FROM nation)
UNION ALL (SELECT 'entry points', row_number() OVER (ORDER BY n DESC, dst), dst FROM (SELECT dst, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, dst LIMIT 3))
UNION ALL (SELECT 'hot symbols', row_number() OVER (ORDER BY p_partkey DESC), p_name FROM part ORDER BY p_partkey DESC LIMIT 3)""")
def session_brief(spark, d):
    decisions = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.timestamp_seconds("n_nationkey").alias("timestamp"), F.col("n_name").alias("text"))
    hot = table(spark, d, "part").select(F.col("p_name").alias("symbol"), F.col("p_partkey").alias("hit_count"))
    return metrics.session_brief(_nodes(spark, d), _edges(spark, d), decisions, hot, 3)


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN least(1e0, (n_nationkey / 40e0 + n_nationkey / 20e0) / 2 + 1e-1) WHEN 1 THEN least(1e0, n_nationkey / 10e0) ELSE 5e-1 END AS importance FROM nation")
def result_importance(spark, d):
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(key.alias("id"), F.when(key % 3 == 0, "context_pack").otherwise("some_tool").alias("tool"), F.array(key / F.lit(40.0), key / F.lit(20.0)).alias("sections"), F.when(key % 3 == 1, key / F.lit(10.0)).alias("top"))
    return rows.select("id", scores.result_importance("tool", "sections", "top").alias("importance"))


# ── learnings, retention, sessions ──────────────────────────────────────────────────────────────────────────────────


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id <> 7 AND doc_id % 11 <> 4 UNION ALL SELECT 'new'")
def learning_supersede(spark, d):
    """Learnings that are current after one has been superseded and some are deprecated."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 11 == 4).alias("deprecated"), F.lit(None).cast("string").alias("supersedes"))
    new = spark.createDataFrame([("new", False)], "id string, deprecated boolean")
    return memory.current(memory.supersede(rows, "7", new)).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id % 400, doc_id LIMIT 10")
def learning_types(spark, d):
    """Learnings of one type, newest first where no word of the query is found."""
    rows = _learnings(spark, d).withColumn("type", F.when(F.col("id") % 3 == 0, "bug").otherwise("decision"))
    return memory.retrieve(rows, "zzzzqqq", _as_of(), 10, ["bug"]).select("id")


@query("""SELECT id FROM (SELECT id, sum(least(200, length(t))) OVER (ORDER BY days, id) AS run FROM (SELECT doc_id AS id, doc_id % 400 AS days, coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0 ORDER BY days, id LIMIT 3)) WHERE run <= 500""")
def learning_injection(spark, d):
    rows = _learnings(spark, d).withColumn("type", F.when(F.col("id") % 2 == 0, "correction").otherwise("decision"))
    return memory.injected(rows, 200, 500).select("id")


@query("SELECT doc_id AS id FROM documents WHERE length(text) >= 50 AND doc_id % 10 >= 3")
def store_gate(spark, d):
    return memory.storable(table(spark, d, "documents").withColumn("importance", F.col("doc_id") % 10 / F.lit(10.0))).select(F.col("doc_id").alias("id"))


@query("SELECT id FROM (SELECT event_id AS id, row_number() OVER (ORDER BY (event_id % 10) / 10e0 DESC, event_id) AS k FROM events) WHERE k > 50")
def cleanup_rest(spark, d):
    queue = _aged(spark, d).select(F.col("id").alias("entry_id"), F.col("importance").alias("priority"))
    return memory.pop_batch(queue, 50)[1].select(F.col("entry_id").alias("id"))


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus = 'O'")
def unclosed_sessions(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("closed_at"))
    return memory.unclosed(rows).select("session_id")


@query("SELECT c_name AS session_id FROM customer WHERE c_name = 'Customer#000000007' OR starts_with(c_name, 'Customer#00000014') AND (SELECT count(*) FROM customer WHERE starts_with(c_name, 'Customer#00000014')) = 1")
def session_prefix(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("session_id"))
    return memory.find_session(rows, "Customer#000000007").unionByName(memory.find_session(rows, "Customer#00000014"))


@query("SELECT DISTINCT id FROM (SELECT n_name AS id FROM nation WHERE n_nationkey < 15 UNION SELECT n_name FROM nation WHERE n_nationkey > 10) WHERE id NOT IN (SELECT n_name FROM nation WHERE n_nationkey = 12)")
def documents_of_roots(spark, d):
    """Rows of two overlapping roots, each once, but those already ingested."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("id"), "n_nationkey")
    both = nation.where("n_nationkey < 15").select("id").union(nation.where("n_nationkey > 10").select("id")).distinct()
    return both.exceptAll(nation.where("n_nationkey = 12").select("id"))
