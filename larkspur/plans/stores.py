"""Source, sink and stream queries: trees, stores and change feeds that the query writes itself, read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import behaviour, indexing, memory, metrics
from ..session import shared_dir
from ..sources import files, sinks
from ..sources.commits import Stores
from ..sources.vector_store import ExactStore
from ..streaming import streams
from .registry import query, table


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/larkspur-store-{uuid.uuid4().hex}"


_TREE = """t AS (SELECT r_name || '/f' || n_nationkey || ['.py', '.go', '.txt', '.tsx'][n_nationkey % 4 + 1] AS path, n_nationkey,
    'def ' || lower(n_name) || '():' || chr(10) || '    return call_' || n_regionkey || '()' || chr(10) AS content FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _tree(spark, d):
    """``(path, content)`` of a small source tree made of the nations."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.element_at(F.array(*map(F.lit, (".py", ".go", ".txt", ".tsx"))), F.col("n_nationkey") % 4 + 1)
    content = F.concat(F.lit("def "), F.lower("n_name"), F.lit("():\n    return call_"), "n_regionkey", F.lit("()\n"))
    return both.select(F.concat("r_name", F.lit("/f"), "n_nationkey", ext).alias("path"), "n_nationkey", content.alias("content"))


def _written_tree(spark, d) -> str:
    """The tree as files in the shared folder, with a directory to skip and a file that is too large."""
    root = _folder(spark)
    rows = [(r["path"], r["content"]) for r in _tree(spark, d).collect()]  # one row per nation
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path, content in [*rows, ("node_modules/skipped.py", "x = 1\n"), ("large.py", "#" * 2_000_000)]:
        target = hadoop.Path(f"{root}/{path}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(content.encode()))
        out.close()
    return root


@query(f"""WITH {_TREE} SELECT path, length(content) AS length, CASE n_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'tsx' END AS language,
CASE n_nationkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'TypeScript' END AS label FROM t WHERE n_nationkey % 4 <> 2""")
def repo_walk(spark, d):
    """A tree's supported files: skipped directories, large files and other extensions are left out."""
    return files.repository(spark, _written_tree(spark, d), max_bytes=1_000_000).select("path", "length", "language", "label")


@query(f"WITH {_TREE} SELECT path FROM t WHERE n_nationkey % 4 <> 2 AND n_nationkey % 3 = 0")
def tracked_files(spark, d):
    tree = files.with_language(_tree(spark, d))
    return files.tracked_only(tree, tree.where("n_nationkey % 3 = 0").select("path")).select("path")


@query(f"WITH {_TREE} SELECT CASE n_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'tsx' END AS language, count(*) AS files FROM t WHERE n_nationkey % 4 <> 2 GROUP BY 1")
def language_counts(spark, d):
    return indexing.language_counts(files.with_language(_tree(spark, d)))


@query(f"WITH {_TREE} SELECT path FROM t WHERE n_nationkey % 4 = 0")
def language_filter(spark, d):
    return _tree(spark, d).where(files.extension(F.col("path")).isin(files.search_extensions("python"))).select("path")


@query(f"WITH {_TREE} SELECT path, 1 + (length(content) - length(replace(content, chr(10), ''))) AS lines FROM t WHERE n_nationkey % 4 = 2")
def document_files(spark, d):
    """Text documents found below a root, with their number of lines."""
    found = files.documents(spark, [_written_tree(spark, d)])
    return found.select(F.regexp_extract("path", "([A-Z ]+/[^/]+)$", 1).alias("path"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query(f"WITH {_TREE} SELECT path AS file, 'nation_' || n_nationkey AS name, 'FUNCTION' AS type, 1 AS start_line, 2 AS end_line, 'call_' || (SELECT n_regionkey FROM nation n WHERE n.n_nationkey = t.n_nationkey) AS calls FROM t WHERE n_nationkey % 4 = 0")
def parse_tree(spark, d):
    """Symbols of a tree's Python files."""
    found = indexing.symbols(indexing.parse(files.with_language(_tree(spark, d).withColumn("content", F.col("content").cast("binary")))))
    return found.where("file like '%.py'").select("file", "name", "type", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


#: (extension, source, what it holds as (name, type, start, end, calls, bases), imports); ``@`` stands for a customer's key, ``~`` for its nation's.
_SOURCES = (
    ("js", "import { load } from './lib~';\n// function hidden() {}\nclass Box@ extends Base~ {\n  open(x) {\n    return load('}', `${x} {`);\n  }\n}\nconst go@ = async (a) => {\n  await save~(a);\n};\n",
     (("Box@", "CLASS", 3, 7, "", "Base~"), ("open", "FUNCTION", 4, 6, "load", ""), ("go@", "FUNCTION", 8, 10, "save~", "")), ("./lib~",)),
    ("ts", "interface Port@ extends Plug~ {\n  id: string;\n}\nexport class Dock@<T> implements Port@, Bay~ {\n  find(id: string): Promise<T> {\n    return this.db.get~<T>(id);\n  }\n}\n",
     (("Port@", "CLASS", 1, 3, "", "Plug~"), ("Dock@", "CLASS", 4, 8, "", "Port@,Bay~"), ("find", "FUNCTION", 5, 7, "get~", "")), ()),
    ("go", "package p\nimport \"example.com/n~\"\ntype Store@ struct {\n\tBase~\n\tname string\n}\nfunc (s *Store@) Get@(id int) string {\n\tx := `}`\n\treturn fetch~(x)\n}\n",
     (("Store@", "CLASS", 3, 6, "", "Base~"), ("Get@", "FUNCTION", 7, 10, "fetch~", "")), ("example.com/n~",)),
    ("rs", "use crate::n~;\npub struct Cell@<'a> { name: &'a str }\nimpl<'a> Shape~ for Cell@<'a> {\n    fn area(&self) -> f64 {\n        let q = '}';\n        compute~(q)\n    }\n}\n",
     (("Cell@", "CLASS", 2, 2, "", "Shape~"), ("area", "FUNCTION", 4, 7, "compute~", "")), ("crate::n~",)),
    ("java", "import a.n~.List;\npublic class Repo@ extends Base~ implements Closeable {\n    public String find(String q) throws IOException {\n        if (q == \"}\") { return empty~(); }\n        return this.db.query(q);\n    }\n    void close();\n}\n",
     (("Repo@", "CLASS", 2, 8, "", "Base~,Closeable"), ("find", "FUNCTION", 3, 6, "empty~,query", "")), ("a.n~.List",)),
    ("cpp", "#include \"n~.h\"\nnamespace app {\nclass Node@ : public Base~<int> {\n  int get(int k) const { return lookup~(k); }\n  void run();\n};\nvoid Node@::run() {\n  char c = '}';\n  use~(c);\n}\n}\n",
     (("Node@", "CLASS", 3, 6, "", "Base~"), ("get", "FUNCTION", 4, 4, "lookup~", ""), ("run", "FUNCTION", 7, 10, "use~", "")), ("n~.h",)),
)


def _sources_sql() -> str:
    rows = []
    for k, (extension, _, symbols, imports) in enumerate(_SOURCES):
        rows += [f"({k}, '{extension}', '{name}', '{kind}', {start}, {end}, '{calls}', '{bases}')" for name, kind, start, end, calls, bases in symbols]
        rows += [f"({k}, '{extension}', '{module}', 'IMPORT', 0, 0, '', '')" for module in imports]
    filled = lambda c: f"replace(replace({c}, '@', c_custkey::VARCHAR), '~', c_nationkey::VARCHAR)"
    return f"""SELECT 'c' || c_custkey || '.' || ext AS file, {filled("name")} AS name, type, start_line, end_line, {filled("calls")} AS calls, {filled("bases")} AS bases
FROM customer JOIN (VALUES {', '.join(rows)}) s(k, ext, name, type, start_line, end_line, calls, bases) ON c_custkey % {len(_SOURCES)} = k"""


@query(_sources_sql())
def parse_languages(spark, d):
    """Symbols with their true ends, calls and bases, and imports, of a source file for every customer in one of six languages."""
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("@"), F.col("c_custkey").cast("string")), F.lit("~"), F.col("c_nationkey").cast("string"))
    k = F.col("c_custkey") % len(_SOURCES)
    pick = lambda values: F.element_at(F.array(*values), (k + 1).cast("int"))
    content = pick([filled(source) for _, source, _, _ in _SOURCES])
    tree = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit("."), pick([F.lit(e) for e, *_ in _SOURCES])).alias("path"), content.cast("binary").alias("content"))
    parsed = indexing.parse(files.with_language(tree))
    # symbols and imports in one array, so that each file is parsed once
    shown = F.transform("symbols", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.array_join(x["calls"], ",").alias("calls"), F.array_join(x["bases"], ",").alias("bases")))
    imported = F.transform("imports", lambda m: F.struct(m.alias("name"), F.lit("IMPORT").alias("type"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("").alias("calls"), F.lit("").alias("bases")))
    return parsed.select(F.col("path").alias("file"), F.inline(F.concat(shown, imported)))


@query(f"WITH {_TREE} SELECT path FROM t WHERE n_nationkey % 5 <> 1")
def unseen_files(spark, d):
    tree = _tree(spark, d)
    seen = tree.where("n_nationkey % 5 = 1").select("path", F.substring(F.sha2("content", 256), 1, 16).alias("sha"))
    return indexing.unseen(tree, seen).select("path")


@query(f"WITH {_TREE} SELECT path FROM t WHERE n_nationkey % 5 <> 1")
def changed_files(spark, d):
    tree = _tree(spark, d)
    known = tree.select("path", F.sha2(F.when(F.col("n_nationkey") % 5 == 1, F.col("content")).otherwise("old"), 256).alias("sha256"))
    return indexing.changed(tree, known).select("path")


@query(f"WITH {_TREE} SELECT path, CASE WHEN n_nationkey % 3 = 0 THEN 'create' WHEN n_nationkey % 3 = 1 THEN 'delete' ELSE 'modify' END AS action FROM t WHERE n_nationkey % 3 <> 2 OR n_nationkey % 2 = 0")
def listing_changes(spark, d):
    tree, key = _tree(spark, d), F.col("n_nationkey")
    sha = lambda c: tree.withColumn("sha256", F.sha2(c, 256))
    before = sha(F.col("content")).where(key % 3 != 0)
    now = sha(F.when(key % 2 == 0, F.concat("content", F.lit("#"))).otherwise(F.col("content"))).where(key % 3 != 1)
    return streams.listing_changes(before.select("path", "sha256"), now.select("path", "sha256"))


@query("SELECT event_id::VARCHAR AS id, event_type AS event, epoch_us(ts) AS at FROM events WHERE event_id % 7 <> 0")
def json_store(spark, d):
    """A store of JSON lines, every seventh of them damaged."""
    path, events = _folder(spark), table(spark, d, "events")
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("event"), F.unix_micros("ts").alias("at")))
    events.select(F.when(F.col("event_id") % 7 == 0, "{damaged").otherwise(good).alias("value")).write.text(path)
    return files.json_store(spark, path, "id string, event string, at long")


@query("SELECT 's' || user_id AS session_id, count(*) AS n FROM events GROUP BY user_id")
def session_files(spark, d):
    """Session documents, one JSON file each, and one that cannot be read."""
    path, events = _folder(spark), table(spark, d, "events")
    each = events.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("role"), F.col("props").alias("content"))).alias("messages"))
    each.select(F.concat(F.lit("s"), "user_id").alias("session_id"), "messages").write.json(path)
    spark.range(1).select(F.lit("{damaged").alias("value")).write.mode("append").text(path)
    found = files.json_store(spark, path, "session_id string, messages array<struct<role:string,content:string>>")
    return found.where("session_id is not null").select("session_id", F.size("messages").cast("long").alias("n"))


@query("""SELECT DISTINCT 'n' || n_nationkey AS repo, unnest(['lib-' || n_regionkey, 'tool-x']) AS package FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'n' || n_nationkey, 'core-' || n_regionkey FROM nation WHERE n_nationkey % 2 = 1""")
def manifest_packages(spark, d):
    nation = table(spark, d, "nation")
    even = F.concat(F.lit("Lib_"), "n_regionkey", F.lit(">=1.0\n# none\ntool.x[all]==2\nlib-"), "n_regionkey", F.lit("\n"))
    odd = F.concat(F.lit('{"dependencies": {"Core.'), "n_regionkey", F.lit('": "^1"}}'))
    rows = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("repo"), F.when(F.col("n_nationkey") % 2 == 0, "requirements.txt").otherwise("package.json").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, even).otherwise(odd).alias("text"))
    return files.manifest_packages(rows)


@query("SELECT 'adr/' || n_nationkey || '.md' AS path, 'Use ' || n_name AS title, 'We use ' || lower(n_name) || '.' AS decision FROM nation WHERE n_nationkey % 2 = 0")
def decision_records(spark, d):
    key = F.col("n_nationkey")
    path = F.concat(F.when(key % 2 == 0, "adr/").otherwise("doc/"), key, F.lit(".md"))
    text = F.concat(F.lit("# Use "), "n_name", F.lit("\n\n## Context\nNone.\n\n## Decision\nWe use "), F.lower("n_name"), F.lit(".\n\n## Consequences\nSome.\n"))
    return files.decision_records(table(spark, d, "nation").select(path.alias("path"), text.alias("text")))


# ── sinks ───────────────────────────────────────────────────────────────────────────────────────────────────────────


@query("SELECT vec_id AS row_id, 'memory' AS source, len(embedding) AS dim FROM embeddings UNION ALL SELECT vec_id + 1000000, 'doc', len(embedding) FROM embeddings WHERE label % 2 = 0")
def vector_append(spark, d):
    """Rows of two appends, absent columns null and the source of the first left to its default."""
    store, rows = ExactStore(spark, _folder(spark)), table(spark, d, "embeddings")
    store.add(rows.select(F.col("vec_id").alias("row_id"), "embedding"))
    store.add(rows.where("label % 2 = 0").select((F.col("vec_id") + 1_000_000).alias("row_id"), "embedding", F.lit("doc").alias("source")))
    return store.rows().select("row_id", "source", F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id AS row_id, vec_id % 3 = 0 AS suppressed, CASE WHEN vec_id % 3 = 0 THEN 'r' || label END AS reason FROM embeddings")
def suppress(spark, d):
    rows = table(spark, d, "embeddings")
    base = rows.select(F.col("vec_id").alias("row_id"), F.lit(None).cast("boolean").alias("suppressed"), F.lit(None).cast("string").alias("suppress_reason"), F.lit(None).cast("timestamp").alias("suppressed_at"))
    marks = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("r"), "label").alias("reason"))
    return memory.suppress(base, marks, F.lit("2024-01-01").cast("timestamp")).select("row_id", "suppressed", F.col("suppress_reason").alias("reason"))


@query("SELECT vec_id AS row_id FROM embeddings WHERE label % 3 <> 1")
def hard_delete(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return memory.with_tombstones(rows, rows.where("label % 3 = 1")).select("row_id")


@query("""SELECT 'a' || (event_id % 200) AS id, arg_min(event_type, event_id) AS type, 'f' || arg_max(user_id, event_id) FILTER (WHERE event_id % 3 = 0) AS file, max(event_id) AS seq FROM events GROUP BY event_id % 200""")
def node_upsert(spark, d):
    from ..operators import graph

    events = table(spark, d, "events")
    rows = events.select(F.concat(F.lit("a"), F.col("event_id") % 200).alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("f"), "user_id")).alias("file"), F.col("event_id").alias("seq"))
    return graph.upsert_nodes(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@query("""WITH f AS (SELECT o_orderkey::VARCHAR AS path, sha256(o_orderkey || o_orderstatus) AS sha FROM orders), h AS (SELECT sha256(path || chr(31) || sha) AS h FROM f),
p AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS files, sha256(string_agg(h, '' ORDER BY h)) AS sha256 FROM p""")
def index_manifest(spark, d):
    orders = table(spark, d, "orders")
    return sinks.manifest(orders.select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.concat("o_orderkey", "o_orderstatus"), 256).alias("sha256")))


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys, true AS sound FROM customer")
def snapshot_load(spark, d):
    """A table's second version, its manifest as a JSON snapshot, and whether the two still agree."""
    root, rows = _folder(spark), table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    store = sinks.Table(spark, f"{root}/files", "path string, sha256 string")
    store.overwrite(rows.limit(1))
    store.overwrite(rows)
    sinks.snapshot(sinks.manifest(store.read()), f"{root}/manifest")
    sound = sinks.verify(store.read(), spark.read.schema("files long, sha256 string").json(f"{root}/manifest"))
    return store.read().agg(F.count("*").alias("n"), F.sum(F.col("path").cast("long")).alias("keys")).withColumn("sound", F.lit(sound))


@query("SELECT n_name AS metric, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT r_name, r_regionkey::DOUBLE FROM region")
def metrics_log(spark, d):
    path = _folder(spark)
    for name, key, value in (("nation", "n_name", "n_nationkey"), ("region", "r_name", "r_regionkey")):
        sinks.append_metrics(table(spark, d, name).select(F.col(key).alias("metric"), F.col(value).cast("double").alias("value")), path)
    return files.json_store(spark, path, "metric string, value double")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT 3, m + 1, 'user', 'one more question' FROM (SELECT coalesce(max(turn), -1) AS m FROM conversations WHERE conv_id = 3) UNION ALL SELECT 3, m + 2, 'assistant', 'and its answer' FROM (SELECT coalesce(max(turn), -1) AS m FROM conversations WHERE conv_id = 3)")
def session_write(spark, d):
    return sinks.append_exchange(table(spark, d, "conversations"), 3, "one more question", "and its answer")


@query("SELECT event_id AS id, user_id FROM events WHERE user_id % 5 <> 2 UNION ALL SELECT event_id + 1000000, user_id FROM events WHERE user_id % 5 = 2 AND event_id % 2 = 0")
def replace_buckets(spark, d):
    """A store whose buckets of some keys are replaced."""
    store = sinks.BucketStore(spark, _folder(spark), "id long, user_id long", "user_id")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    store.overwrite(rows)
    some = rows.where("user_id % 5 = 2")
    store.replace(some.select(F.col("user_id").alias("path")), some.where("id % 2 = 0").withColumn("id", F.col("id") + 1_000_000))
    return store.read()


@query("SELECT event_id AS id, true AS archived FROM events QUALIFY row_number() OVER (ORDER BY ts, event_id) <= CASE WHEN count(*) OVER () >= 900 THEN greatest(1, floor(count(*) OVER () * 2e-1)) ELSE 0 END")
def rotate_archive(spark, d):
    """What a rotation moves to the archive."""
    schema = "id long, time timestamp"
    stores = Stores(spark, _folder(spark), {"events": (schema, "id"), "archive": (schema, None)})
    stores.store("events").overwrite(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("time")))
    sinks.rotate_events(stores, cap=900)
    return stores.read("archive").select("id").withColumn("archived", F.lit(True))


# ── streams, as they run over what is there ─────────────────────────────────────────────────────────────────────────


def _stream(spark, rows, name: str):
    """``rows`` as a stream of the files that hold them."""
    path = f"{_folder(spark)}/{name}"
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _ran(spark, stream, mode: str = "append"):
    """What a stream has written when all that was there is through."""
    root = _folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


_LEFT = "FROM t WHERE n_nationkey % 4 = 0 AND n_nationkey % 5 <> 3"
_CALL = "'symbol::call_' || (SELECT n_regionkey FROM nation n WHERE n.n_nationkey = t.n_nationkey)"


@query(f"""WITH {_TREE}, s AS (SELECT path, 'nation_' || n_nationkey AS name, {_CALL} AS callee {_LEFT})
SELECT 'symbols' AS store, path AS a, name AS b FROM s UNION ALL SELECT 'vectors', path, name FROM s
UNION ALL SELECT 'words', path, 'nation' FROM s
UNION ALL SELECT 'nodes', path || '::' || name, 'FUNCTION' FROM s UNION ALL SELECT 'nodes', path, 'FILE' FROM t WHERE n_nationkey % 4 <> 2 AND n_nationkey % 5 <> 3
UNION ALL SELECT 'edges', path || '::' || name, path FROM s UNION ALL SELECT 'edges', path || '::' || name, callee FROM s UNION ALL SELECT 'edges', callee, path || '::' || name FROM s
UNION ALL SELECT 'events', path, CASE WHEN n_nationkey % 5 = 3 THEN 'stale' ELSE 'fresh' END FROM t""")
def stream_reindex(spark, d):
    """All stores of an index, and the episodes that name its files, after a feed that creates every file and then deletes some."""
    root, tree = _folder(spark), _tree(spark, d)
    stores = Stores(spark, root, {
        "files": (schemas.FILES, "path"), "symbols": (schemas.SYMBOLS, "file"), "words": (schemas.POSTINGS, "file"), "vectors": ("file string, name string", "file"),
        "nodes": (schemas.NODES, "id"), "edges": (schemas.EDGES, "src"), "events": (schemas.EPISODES, "id"),
    })
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + n))
    episodes = tree.select(F.col("path").alias("id"), F.concat(F.lit("edit "), "path").alias("event"), F.create_map().cast("map<string,string>").alias("metadata"), at(0).alias("time"))
    stores.store("events").append(episodes)
    made = tree.select("path", F.lit("create").alias("action"), at(0).alias("time"), F.col("content").cast("binary").alias("content"))
    gone = tree.where("n_nationkey % 5 = 3").select("path", F.lit("delete").alias("action"), at(1).alias("time"), F.lit(None).cast("binary").alias("content"))
    batch = lambda name: streams.reindex(stores, embed=lambda found: found.select("file", "name"), stream=name)
    for name, rows in (("made", made), ("gone", gone)):
        streams.periodic(_stream(spark, rows, name), batch(name), f"{root}/{name}-checkpoint").awaitTermination()
    python = "file like '%.py'"
    parts = [stores.read(name).where(python).select(F.lit(name).alias("store"), F.col("file").alias("a"), F.col(of).alias("b")) for name, of in (("symbols", "name"), ("vectors", "name"), ("words", "word"))]
    parts += [stores.read("nodes").select(F.lit("nodes"), "id", "type"), stores.read("edges").select(F.lit("edges"), "src", "dst"), stores.read("events").select(F.lit("events"), "id", F.when(F.coalesce("stale", F.lit(False)), "stale").otherwise("fresh"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("""WITH x AS (SELECT user_id AS s, event_type AS file, ts FROM events), f AS (SELECT s, file, min(ts) AS first FROM x GROUP BY s, file),
p AS (SELECT x.s, x.file AS a, f.file AS b, count(*) AS n FROM x JOIN f ON f.s = x.s AND f.file <> x.file AND f.first < x.ts GROUP BY ALL)
SELECT 's' || s AS session, file_a, file_b, sum(n)::BIGINT AS n FROM (SELECT s, a AS file_a, b AS file_b, n FROM p UNION ALL SELECT s, b, a, n FROM p) GROUP BY ALL""")
def stream_coedits(spark, d):
    """Pairs of what a session touches, from the state that a session keeps."""
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session"), F.col("event_type").alias("file"), F.col("ts").alias("time"))
    found = _ran(spark, streams.coedit_pairs(_stream(spark, rows, "edits"), late="400 days"))
    return found.groupBy("session", "file_a", "file_b").agg(F.sum("n").alias("n"))


@query("""SELECT q.event_id AS query_id, epoch_us(e.ts) AS edit_at FROM events q JOIN events e ON q.user_id = e.user_id AND q.event_type = 'view' AND e.event_type = 'purchase' AND e.ts BETWEEN q.ts AND q.ts + INTERVAL 60 MINUTE""")
def stream_useful_window(spark, d):
    """A stream-stream join within a window."""
    events = table(spark, d, "events")
    asked = _stream(spark, events.where("event_type = 'view'").select(F.col("event_id").alias("query_id"), "user_id", F.col("ts").alias("query_ts")), "queries")
    edits = _stream(spark, events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("edit_ts"), F.col("event_id").alias("file")), "edits")
    found = _ran(spark, streams.useful_window(asked, edits, 60, "400 days"))
    return found.select("query_id", F.unix_micros("edit_ts").alias("edit_at"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + INTERVAL 30 MINUTE < ts OR lag(ts) OVER w + INTERVAL 30 MINUTE = ts THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def idle_sessions(spark, d):
    """Sessions that an idle gap closes, over events that are all there."""
    found = streams.idle_sessions(table(spark, d, "events"))
    return found.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT event_type AS query, count(DISTINCT event_type) AS let FROM events GROUP BY event_type")
def stream_result_cache(spark, d):
    """How often a result cache whose entries live longer than the stream lets each key through: once."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("query"), "ts")
    return _ran(spark, streams.novel_only(_stream(spark, rows, "queries"), 400 * 86_400)).groupBy("query").agg(F.count("*").alias("let"))


_DECAYED = "(event_id % 10) / 10e0 * exp(-1e-1 * floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000))"


@query(f"SELECT event_id AS id, {_DECAYED} < 15e-2 AS archived FROM events")
def stream_prune(spark, d):
    """Memories that a stream's periodic prune leaves, and those that it moved to the archive."""
    root, events = _folder(spark), table(spark, d, "events")
    schema = "id long, importance double, created_at timestamp"
    stores = Stores(spark, root, {"memories": (schema, "id"), "archive": (schema, None)})
    stores.store("memories").append(events.select(F.col("event_id").alias("id"), (F.col("event_id") % 10 / F.lit(10.0)).alias("importance"), F.col("ts").alias("created_at")))
    tick = _stream(spark, events.where("event_type = 'error'").select("event_id"), "ticks")
    streams.periodic(tick, streams.prune_batch(stores, F.lit("2024-02-01").cast("timestamp")), f"{root}/checkpoint").awaitTermination()
    return stores.read("memories").select("id", F.lit(False).alias("archived")).unionByName(stores.read("archive").select("id", F.lit(True).alias("archived")))


@query("SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def health(spark, d):
    return metrics.health(**{name: table(spark, d, name) for name in ("documents", "events", "pages")})


@query("SELECT lower(event_type) AS query, arg_max('r' || user_id, (ts, event_id)) AS rewrite, count(*) AS hit_count FROM events GROUP BY event_type ORDER BY hit_count DESC, query LIMIT 3")
def query_rewrites(spark, d):
    rows = table(spark, d, "events").select(F.upper("event_type").alias("query"), F.concat(F.lit("r"), "user_id").alias("rewrite"), F.struct("ts", "event_id").alias("time"))
    return behaviour.rewrites(rows, 3)
