"""A workspace: the stores of one repository or organisation, and every tool and command over them.

Reads return DataFrames, plans that nothing has run yet; a write is one commit over all stores that it changes, so readers
see an index, a prune or a seed as a whole.  Times are passed in.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import rules, scores
from .functions import text as T
from .operators import behaviour, chunking, graph, hybrid, indexing, memory, metrics, packing, text_search, vector
from .sources import files, git
from .sources.commits import Change, State, Stores
from .sources.sinks import append_metrics, manifest, snapshot, verify

TABLES = {
    "memories": schemas.MEMORIES + ", repo string",
    "files": schemas.FILES,
    "symbols": schemas.SYMBOLS,
    "symbol_vectors": schemas.SYMBOL_VECTORS,
    "words": schemas.POSTINGS,
    "nodes": schemas.NODES,
    "edges": schemas.EDGES,
    "docs": "path string, text string",
    "chunks": schemas.CHUNKS,
    "imports": "file string, module string",
    "summaries": "path string, language string, purpose string, classes array<string>, functions array<string>, constants array<string>, symbol_count long, line_count int, summary string",
    "episodes": schemas.EPISODES,
    "learnings": schemas.LEARNINGS,
    "queries": schemas.QUERY_HISTORY,
    "preferences": "key string, value string, context string, time timestamp",
    "errors": schemas.ERRORS,
    "cleanup": schemas.CLEANUP,
    "sessions": "conv_id string, turn long, role string, text string",
    "repos": schemas.REPOS,
    "links": schemas.ORG_EDGES,
    "manifest": "files long, sha256 string",
    "weights": schemas.SYMBOL_WEIGHTS,
    "pruned": schemas.MEMORIES + ", repo string, decay_score double",
}
#: Columns by which stores are bucketed and changed; the others only grow or are written whole.
KEYS = {
    "memories": "row_id", "files": "path", "symbols": "file", "symbol_vectors": "file", "words": "file", "nodes": "id", "edges": "src", "docs": "path", "imports": "file",
    "summaries": "path", "learnings": "id", "queries": "query_id", "cleanup": "entry_id", "sessions": "conv_id", "weights": "symbol",
}


class Workspace:
    def __init__(self, spark: SparkSession, root: str, embedder: vector.Embedder = vector.hashing_embedder, repo: str = "") -> None:
        self.spark, self.root, self.embedder, self.repo = spark, root.rstrip("/"), embedder, repo
        self.stores = Stores(spark, self.root, {name: (ddl, KEYS.get(name)) for name, ddl in TABLES.items()})
        self.tables = {name: self.stores.store(name) for name in TABLES}
        self.cache = hybrid.ResultCache()

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def _append(self, name: str, *rows: tuple) -> None:
        self.tables[name].append(self.spark.createDataFrame(list(rows), TABLES[name]))
        self.cache.clear()

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder([text])[0]]

    # ── memories, decisions, episodes ───────────────────────────────────────────────────────────────────────────────

    def store_memory(self, text: str, at: dt.datetime, source: str = "memory", importance: float | None = None, only_novel: bool = False) -> str:
        """Store a text, log it, tag it as a learning where it is one.  Returns ``stored`` or ``known``."""
        new = vector.embed(self.spark.createDataFrame([(text, source)], "text string, source string"), "text", self.embedder)
        value = F.lit(importance) if importance is not None else scores.importance("text")
        new = new.withColumn("importance", value).withColumn("row_id", F.lit(uuid.uuid4().int >> 66).cast("long")).withColumn("created_at", F.lit(at)).withColumn("repo", F.lit(self.repo))
        if only_novel:
            new = memory.storable(new)
            old = vector.live(self.read("memories"))
            if new.isEmpty() or (not old.isEmpty() and vector.novel(new, old).isEmpty()):
                return "known"
        columns = self.read("memories").columns
        filled = new.select(*[F.col(c) if c in new.columns else F.lit(0.0).alias(c) if c == "behaviour_score" else F.lit(None).alias(c) for c in columns])
        self.tables["memories"].append(self.spark.createDataFrame(filled.collect(), TABLES["memories"]))
        self.log_episode("store_memory", {"text": text[:200], "source": source}, at)
        tag = self.spark.createDataFrame([(text,)], "text string").select(rules.learning_type("text"), rules.learning_scope("text")).first()
        if tag[0]:
            self.store_learning(tag[0], text, at, tag[1])
        return "stored"

    def store_learning(self, kind: str, text: str, at: dt.datetime, scope: str = "project", supersedes: str | None = None) -> str:
        key = uuid.uuid4().hex
        self._append("learnings", (key, kind, scope, text, at, False, supersedes, {}))
        return key

    def learning_conflicts(self, text: str, k: int = 3) -> DataFrame:
        return memory.conflicts(memory.current(self.read("learnings")), text, k)

    def retrieve_learnings(self, query: str, at: dt.datetime, k: int = 5) -> DataFrame:
        return memory.retrieve_scopes(memory.current(self.read("learnings")), query, F.lit(at), k)

    def retrieve_memory(self, query: str, k: int = 5, least: float | None = None) -> DataFrame:
        """Hybrid retrieval, repeats removed, split into code and documents."""
        names = _entities(self.spark, hybrid.guard(query))
        counts = self.read("weights").select("symbol", F.col("hit_count").alias("n"))
        found = hybrid.retrieve(self.read("memories"), self.read("symbols"), self.read("symbol_vectors"), self.read("edges"), counts, self._vector(query), names, k)
        if least is not None:
            found = hybrid.with_least(found, least)
        return hybrid.structured(hybrid.without_repeats(found))

    def record_decision(self, summary: str, rationale: str, affected: list[str], at: dt.datetime) -> None:
        self.log_episode("decision", {"summary": summary, "rationale": rationale, "affected_files": ",".join(affected)}, at)

    def log_episode(self, event: str, metadata: dict[str, str], at: dt.datetime) -> str:
        key = f"e_{uuid.uuid4().hex}"
        last = self.read("episodes").agg(F.max_by("id", "time")).first()[0]
        self._append("episodes", (key, event, {str(k): str(v) for k, v in metadata.items()}, at, last, False, None))
        return key

    def episodic_search(self, query: str, limit: int = 10) -> DataFrame:
        return memory.search_plus(self.read("episodes"), query, limit, self.embedder)

    def history(self, n: int = 100) -> DataFrame:
        return memory.history(self.read("episodes"), n)

    # ── organisation ────────────────────────────────────────────────────────────────────────────────────────────────

    def org_search(self, query: str, k: int = 5, project: str | None = None) -> DataFrame:
        """Nearest memories over all repositories, or those of one project."""
        rows = self.read("memories")
        if project is not None:
            inside = self.read("repos").where(F.col("project") == project).select(F.col("path").alias("repo"))
            rows = rows.join(inside, "repo", "left_semi")
        return hybrid.across_stores(rows, self._vector(query), k)

    def list_org_context(self, path: str) -> dict[str, DataFrame]:
        repos = self.read("repos")
        return {"children": graph.children(repos, path), "siblings": graph.siblings(repos, path), "roots": graph.roots(repos)}

    def add_repo(self, org: str, project: str, path: str, name: str, parent: str | None = None) -> None:
        self._append("repos", (org, project, path, name, parent))

    def link_repos(self, src: str, dst: str, relationship: str = "IMPORTS", note: str = "") -> None:
        if relationship not in graph.ORG_KINDS:
            raise ValueError(f"relationship must be one of {graph.ORG_KINDS}: {relationship}")
        if src != dst:
            self._append("links", (src, dst, relationship, False, note))

    def org_dependencies(self, repo: str, depth: int = 2, dependents: bool = False) -> DataFrame:
        return graph.dependencies(self.read("links"), repo, depth, dependents)

    def cross_repo_traverse(self, repo: str, symbols: DataFrame, direction: str = "both", depth: int = 2) -> DataFrame:
        return graph.traverse(self.read("links"), symbols, repo, direction, depth)

    def discover_links(self, manifests: DataFrame) -> DataFrame:
        """Link repositories by the packages that their manifests ``(repo, name, text)`` name."""
        packages = files.manifest_packages(manifests)
        matched = graph.match_packages(packages.select("package"), self.read("repos"))
        found = packages.join(matched, "package").where("repo <> path").select(F.col("repo").alias("src"), F.col("path").alias("dst")).distinct()
        new = found.select("src", "dst", F.lit("DISCOVERED").alias("kind"), F.lit(True).alias("auto"), F.lit("").alias("note"))
        self.tables["links"].append(new)
        return new

    # ── code ────────────────────────────────────────────────────────────────────────────────────────────────────────

    def index_repo(self, root: str, at: dt.datetime, docs: str | None = None) -> dict[str, int]:
        """Index a source tree: symbols, words, graph, vectors, summaries, documents.  Unchanged files are not parsed again."""
        scan = files.repository(self.spark, root)
        known = self.read("files")
        fresh = indexing.changed(scan, known)
        parsed = graph.written(indexing.parse(fresh), "parsed")
        present = scan.select("path")
        keep = known.join(present, "path", "left_semi").join(parsed.select("path"), "path", "left_anti")
        symbols = self.read("symbols").join(keep.select(F.col("path").alias("file")), "file", "left_semi").unionByName(indexing.symbols(parsed))
        imports = self.read("imports").join(keep.select(F.col("path").alias("file")), "file", "left_semi").unionByName(parsed.select(F.col("path").alias("file"), F.explode("imports").alias("module")))
        imports = graph.written(imports, "imports")
        every = keep.select("path", "sha256", "language").unionByName(parsed.select("path", "sha256", "language"))
        deps = graph.resolve_imports(imports, every)
        weights = graph.crawl_weights(every, deps, graph.entry_points(every))
        table = every.join(weights, "path").select("path", "sha256", "language", "weight", F.lit(at).alias("indexed_at"))
        symbols = graph.written(symbols, "symbols")
        me = T.node_id("type", "name", "file")
        nodes = table.select(F.col("path").alias("id"), F.lit("FILE").alias("type"), F.col("path").alias("file"), F.lit(0).alias("line"), "weight", F.lit(0).cast("long").alias("seq"))
        nodes = nodes.unionByName(symbols.select(me.alias("id"), "type", "file", F.col("start_line").alias("line"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("seq")).dropDuplicates(["id"]))
        edges = graph.symbol_edges(symbols).withColumn("purpose", T.call_purpose(F.regexp_replace("dst", "^symbol::", "")))
        edges = edges.unionByName(deps.select("src", "dst", F.lit("IMPORTS").alias("rel"), F.lit(1.0).alias("weight"), F.lit("imports").alias("purpose"))).withColumn("seq", F.lit(0).cast("long"))
        edges = graph.upsert_edges(edges.limit(0), edges)
        text = F.concat_ws(" ", "type", "name", "docstring")
        vectors = vector.embed(symbols.select("name", "type", "file", "start_line", "docstring", text.alias("t")), "t", self.embedder)
        vectors = vectors.select(F.xxhash64("file", "name", "start_line").alias("row_id"), "name", "type", "file", "start_line", "docstring", F.lit("symbol").alias("source"), "embedding").join(table.select(F.col("path").alias("file"), "weight"), "file").select("row_id", "name", "type", "file", "start_line", "docstring", "source", "weight", "embedding")
        out = {"symbols": symbols, "words": indexing.word_index(symbols), "nodes": nodes, "edges": edges.select("src", "dst", "rel", "weight", "purpose", "seq"), "symbol_vectors": vectors, "imports": imports, "summaries": indexing.file_summaries(symbols, table), "manifest": manifest(every)}
        if docs:
            found = files.documents(self.spark, [docs])
            out |= {"docs": found, "chunks": chunking.chunks(found.select(F.col("path").alias("source"), indexing.strip_front_matter("text").alias("text"))).select("source", F.lit(None).cast("string").alias("section"), "position", "text")}
        self.stores.commit({name: Change(df, whole=True) for name, df in {**out, "files": table}.items()})
        self.cache.clear()
        return {"parsed": parsed.count(), "files": self.read("files").count(), "symbols": self.read("symbols").count()}

    def verify_index(self) -> bool:
        return verify(self.read("files"), self.read("manifest"))

    def lookup_symbol(self, name: str) -> DataFrame:
        return text_search.lookup(self.read("symbols"), name, ignore_case=True).select("file", F.col("start_line").alias("line"), "type")

    def search_token(self, word: str) -> DataFrame:
        return text_search.lookup_word(self.read("words"), self.read("symbols"), word)

    def who_calls(self, name: str) -> DataFrame:
        return graph.who_calls(self.read("edges"), name)

    def subgraph(self, entity: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Around the first of the ids that an entity may have."""
        nodes = self.read("nodes")
        for node in (entity, f"concept::{entity.lower()}", f"symbol::{entity}"):
            if not nodes.where(F.col("id") == node).isEmpty() or not self.read("edges").where((F.col("src") == node) | (F.col("dst") == node)).isEmpty():
                return graph.ego(nodes, self.read("edges"), node, depth)
        return graph.ego(nodes, self.read("edges"), entity, depth)

    def graph_stats(self) -> tuple[DataFrame, DataFrame]:
        return graph.stats(self.read("nodes"), self.read("edges")), graph.top_degree(self.read("nodes"), self.read("edges"), 5, "CONCEPT")

    def semantic_search_code(self, query: str, k: int = 10, language: str | None = None) -> DataFrame:
        return hybrid.symbol_search(self.read("symbol_vectors"), self._vector(query), k, files.search_extensions(language))

    def search_docs(self, query: str, k: int = 20) -> DataFrame:
        return text_search.grep(self.read("docs"), query, id_col="path").orderBy("path", "n").limit(k)

    def dependency_graph(self, module: str, direction: str = "both", depth: int = 2) -> DataFrame:
        """``(direction, node, hops)`` of a module's dependencies, by its path or the unique end of one."""
        found = [r["path"] for r in graph.resolve_module(self.read("files"), module).limit(10).collect()]
        if len(found) != 1:
            raise LookupError(f"{module}: {'ambiguous: ' + ', '.join(found) if found else 'unknown'}")
        deps = graph.written(graph.imports(self.read("symbols")), "deps")
        sides = ("imports", "imported_by") if direction == "both" else (direction,)
        parts = []
        for side in sides:
            walk = deps if side == "imports" else deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            parts.append(graph.neighbours(walk, found[0], max(depth, 1)).select(F.lit(side).alias("direction"), "node", "hops"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def explain_change(self, repository: str, target: str = "", since: str = "7d", max_commits: int = 10) -> DataFrame:
        """Commits that touched a target, with the size of their changes."""
        options = {"since": since, "target": target, "max_commits": str(max_commits)}
        log = git.read(self.spark, "git_log", repository, **options)
        stats = behaviour.diff_stats(git.read(self.spark, "git_patch", repository, **options))
        return log.join(stats, "hash", "left").orderBy(F.desc("at"), "hash")

    def architecture_overview(self, scope: str = "root") -> DataFrame:
        if scope == "root":
            return indexing.directory_summaries(self.read("summaries"))
        return self.read("summaries").where((F.col("path") == scope) | F.col("path").startswith(f"{scope}/"))

    def coverage(self) -> DataFrame:
        return indexing.coverage(self.read("symbols"), self.read("files"))

    # ── context ─────────────────────────────────────────────────────────────────────────────────────────────────────

    def context_pack(self, query: str, max_tokens: int = 2000, include_episodic: bool = True, save: str | None = None) -> DataFrame:
        """One row: what of the retrieved rows, then of related episodes, fits into the budget."""
        doc = re.search(rules.DOC_INTENT.removeprefix("(?i)"), query, re.IGNORECASE) is not None
        found = self.retrieve_memory(query, 20)
        rows = found.select(F.lit(0).alias("query_id"), F.row_number().over(graph.Window.partitionBy(F.lit(0)).orderBy(F.desc("final_score"), "id")).alias("place"), "bucket", F.col("text").alias("id"), T.token_estimate("text").alias("tokens"))
        if include_episodic:
            near = memory.search(self.read("episodes"), query, 5).join(self.read("episodes"), "id")
            text = memory.event_text(near)
            rows = rows.unionByName(near.select(F.lit(0).alias("query_id"), F.lit(1000).alias("place"), F.lit("doc").alias("bucket"), text.alias("id"), T.token_estimate(text).alias("tokens")))
        share = packing.DOC_FIRST_SHARE if doc else packing.CODE_FIRST_SHARE
        packed = packing.pack(rows, max_tokens, share).withColumn("query", F.lit(query)).drop("query_id")
        if save:
            snapshot(packed, save)
        return packed

    def last_context(self, path: str) -> DataFrame:
        return self.spark.read.json(path)

    def ask(self, question: str, top_k: int = 5, episodes: int = 3) -> dict:
        """How a question would be handled: its tier, how much to fetch, and which tool answers it without a model, if any."""
        row = self.spark.createDataFrame([(question,)], "q string").select(rules.classify("q").alias("x")).select("x.*", rules.tier_retrieval("x.tier", top_k, episodes).alias("fetch")).first()
        return {"tier": row["tier"], "score": row["score"], "override": row["override"], "top_k": row["fetch"]["top_k"], "episodes": row["fetch"]["episodes"], "local": resolve(question)}

    def session_history(self, length: int = 300) -> DataFrame:
        return memory.last_exchanges(self.read("sessions"), length)

    def append_exchange(self, conv_id: str, user: str, assistant: str) -> None:
        last = self.read("sessions").where(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0]
        self._append("sessions", (conv_id, last + 1, "user", user), (conv_id, last + 2, "assistant", assistant))

    def session_brief(self) -> DataFrame:
        decisions = memory.current(self.read("learnings")).where("type = 'decision'")
        return metrics.session_brief(self.read("nodes"), self.read("edges"), decisions, self.read("weights"))

    # ── behaviour ───────────────────────────────────────────────────────────────────────────────────────────────────

    def record_query(self, text: str, symbols: list[str], at: dt.datetime) -> str:
        key = uuid.uuid4().hex
        self._append("queries", (key, text, at, symbols, None, None))
        return key

    def record_feedback(self, query_id: str, useful: bool) -> None:
        """Mark a query; where it was useful, its symbols get a hit more."""
        def change(state: State) -> dict[str, Change]:
            mine = graph.written(self.stores.read("queries", state).where(F.col("query_id") == query_id), "query")
            out = {"queries": Change(mine.withColumn("useful", F.lit(useful)), mine.select(F.col("query_id").alias("path")))}
            if useful:
                hits = mine.select(F.explode("symbols").alias("symbol"), "time")
                touched = self.stores.read("weights", state).join(hits, "symbol", "left_semi")
                out["weights"] = Change(behaviour.with_hits(touched, hits), hits.select(F.col("symbol").alias("path")))
            return out

        self.stores.commit(change)
        self.cache.clear()

    def enhance(self, queries: DataFrame, depth: str = "medium") -> DataFrame:
        hot = [r["symbol"].split("::")[-1] for r in behaviour.hot_symbols(self.read("weights"), 30).collect()]
        recent = self.read("queries").select(F.col("text").alias("query"), F.struct("time", "query_id").alias("seq"))
        terms = [r["term"] for r in behaviour.terminology(self.read("queries")).orderBy(F.desc("n"), "term").limit(30).collect()]
        return hybrid.enhance(queries, hot, recent, terms, depth)

    def user_profile(self) -> DataFrame:
        return behaviour.profile(self.read("queries"), self.read("weights"))

    def record_user_preference(self, key: str, value: str, at: dt.datetime, context: str = "") -> None:
        self._append("preferences", (key, value, context, at))

    def preferences(self) -> DataFrame:
        return behaviour.latest(self.read("preferences"), "key", "time")

    def record_error(self, kind: str, message: str, file: str, at: dt.datetime) -> None:
        self._append("errors", (kind, message, file, at))

    def error_patterns(self, least: int = 1) -> DataFrame:
        return behaviour.error_patterns(self.read("errors"), least)

    def seed(self, repository: str, at: dt.datetime, since: str = "1y") -> dict[str, int]:
        """Symbol weights from how lately files changed, learnings from commits and tagged comments."""
        touched = git.read(self.spark, "git_files", repository, since=since)
        recency = behaviour.seed_symbols(behaviour.git_recency(touched, F.lit(at)), self.read("symbols"))
        recency = graph.written(recency, "recency")
        commits = behaviour.commit_learnings(git.read(self.spark, "git_log", repository, since=since))
        comments = behaviour.comment_learnings(files.lines(self.spark, [f"file://{repository}"], "*.py"))
        key = F.concat(F.lit("seed_"), F.substring(F.sha2(F.concat_ws("|", "type", "text"), 256), 1, 24))
        new = commits.select("type", "text").unionByName(comments.select("type", "text")).distinct().withColumn("id", key).join(self.read("learnings").select("id"), "id", "left_anti")
        new = new.select("id", "type", rules.learning_scope("text").alias("scope"), "text", F.lit(at).alias("timestamp"), F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("supersedes"), F.create_map().cast("map<string,string>").alias("metadata"))
        rows = graph.written(new, "seed")

        def change(state: State) -> dict[str, Change]:
            touched = self.stores.read("weights", state).join(recency, "symbol", "left_semi")
            return {"weights": Change(behaviour.with_seeds(touched, recency, F.lit(at)), recency.select(F.col("symbol").alias("path"))), "learnings": Change(rows)}

        self.stores.commit(change)
        return {"weights": self.read("weights").count(), "learnings": rows.count()}

    # ── upkeep ──────────────────────────────────────────────────────────────────────────────────────────────────────

    def prune(self, at: dt.datetime, aggressive: bool = False) -> dict[str, int]:
        """Move decayed memories to the ``pruned`` store."""
        counts = {}

        def change(state: State) -> dict[str, Change]:
            rows = self.stores.read("memories", state)
            gone = graph.written(memory.prune(rows, F.lit(at), aggressive)[1], "pruned")
            counts["pruned"] = gone.count()
            counts["kept"] = rows.count() - counts["pruned"]
            return {"memories": Change(None, gone.select(F.col("row_id").alias("path"))), "pruned": Change(gone)}

        self.stores.commit(change)
        self.cache.clear()
        return counts

    def suppress(self, row_id: int, reason: str, similarity: float, at: dt.datetime) -> None:
        """Hide a memory and queue it for cleanup."""

        def change(state: State) -> dict[str, Change]:
            row = self.stores.read("memories", state).where(F.col("row_id") == row_id)
            mark = self.spark.createDataFrame([(row_id, reason)], "row_id long, reason string")
            item = row.select(F.col("row_id").cast("string").alias("entry_id"), F.lit("memories").alias("store"), "importance", F.lit(at).alias("suppressed_at"), F.lit(float(similarity)).alias("similarity"))
            return {"memories": Change(memory.suppress(row, mark, F.lit(at)), mark.select(F.col("row_id").alias("path"))), "cleanup": Change(item)}

        self.stores.commit(change)
        self.cache.clear()

    def cleanup(self, at: dt.datetime, n: int = 50) -> DataFrame:
        """Delete the ``n`` suppressed memories of highest priority for good, and all dead ones once they make up a fifth; the entries deleted."""
        popped = []

        def change(state: State) -> dict[str, Change]:
            popped[:] = [graph.written(memory.pop_batch(memory.cleanup_queue(self.stores.read("cleanup", state), F.lit(at)), n)[0], "cleanup")]
            gone = popped[0].select(F.col("entry_id").alias("path"))
            rows = self.stores.read("memories", state).join(gone.select(F.col("path").cast("long").alias("row_id")), "row_id", "left_anti")
            if memory.dead_share(rows).first()["rebuild"]:
                kept = graph.written(vector.live(rows), "live")
                waiting = self.stores.read("cleanup", state).join(kept.select(F.col("row_id").cast("string").alias("entry_id")), "entry_id", "left_semi")
                return {"memories": Change(kept, whole=True), "cleanup": Change(waiting, whole=True)}
            return {"memories": Change(None, gone), "cleanup": Change(None, gone)}

        self.stores.commit(change)
        self.cache.clear()
        return popped[0]

    def benchmark(self, golden: DataFrame, history: str | None = None) -> DataFrame:
        """Precision and recall of symbol search over all golden queries, searched in blocks at once."""
        asked = golden.select("query").distinct().withColumn("query_id", F.monotonically_increasing_id())
        asked = graph.written(vector.embed(asked, "query", self.embedder), "golden")
        rows = self.read("symbol_vectors").where("source = 'symbol'")
        near = vector.knn_join(asked, rows, 3).join(asked.select("query_id", "query"), "query_id")
        results = near.join(rows.select("row_id", "file", F.col("name").alias("symbol")), "row_id").select("query", "place", "file", "symbol")
        out = metrics.precision_recall(results, golden)
        if history:
            append_metrics(out, history)
        return out

    def status(self) -> DataFrame:
        return metrics.health(**{name: self.read(name) for name in ("memories", "files", "symbols", "nodes", "edges", "episodes", "learnings", "errors", "repos")})


def _entities(spark: SparkSession, query: str) -> list[str]:
    """Entities of a query."""
    return spark.createDataFrame([(query,)], "q string").select(T.entities("q").alias("x")).first()["x"]


#: (pattern, tool): questions that need no model; the first group is the tool's argument.
RESOLVERS = (
    (r"^where is (?:the )?[`'\"]?([\w.]+)[`'\"]?(?: (?:defined|located|implemented))?\??$", "lookup_symbol"),
    (r"^(?:who|what) calls [`'\"]?([\w.]+)[`'\"]?\??$", "who_calls"),
    (r"^(?:list|show)(?: all)? (?:indexed )?files\??$", "list_files"),
    (r"^(?:show )?graph stats\??$", "graph_stats"),
    (r"^(?:show )?(?:recent )?history\??$", "history"),
    (r"^what depends on [`'\"]?([\w./]+)[`'\"]?\??$", "dependency_graph"),
)


def resolutions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """``questions`` with ``tool`` and ``argument`` as ``resolve`` gives them, for many at once."""
    asked, tool, argument = F.trim(F.col(text_col)), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name in reversed(RESOLVERS):
        hit = asked.rlike(f"(?i){pattern}")
        tool = F.when(hit, name).otherwise(tool)
        groups = re.compile(pattern).groups
        argument = F.when(hit, F.regexp_extract(asked, f"(?i){pattern}", 1) if groups else F.lit(None)).otherwise(argument)
    return questions.withColumn("tool", tool).withColumn("argument", argument)


def resolve(question: str) -> tuple[str, str | None] | None:
    """The tool that answers a question by itself, and its argument."""
    for pattern, tool in RESOLVERS:
        if m := re.match(pattern, question.strip(), re.IGNORECASE):
            return tool, (m[1] if m.groups() else None)
    return None
