"""Embeddings, conversations, urls and the pipeline."""

import hashlib
import json
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import chat, common, embedding_dedup, mixing, queries, url_filter, words


def brute_links(vectors):
    """Links and component of every vector, in the order given; equal ids do not link."""
    rows = [np.array(v, float) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and np.any(v) else None for _, v in vectors]
    near = [(a, b) for a, u in enumerate(rows) for b, w in enumerate(rows) if a != b and u is not None and w is not None and len(u) == len(w) and u @ w >= 0.9]
    low = [i for i, _ in vectors]
    for _ in rows:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return [(i, sum(a == k for a, _ in near), low[k]) for k, (i, _) in enumerate(vectors)]


@pytest.mark.parametrize("block", [4096, 4])
def test_near_vectors(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    vectors = [(i, (base[i % 30] + 0.12 * rng.normal(size=16) * (i >= 30)).astype("f4").tolist()) for i in range(120)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0] * 15 + [None]), (305, [float("inf")] * 16), (306, [1.0, 2.0])]
    # an id that repeats, with the same vector and with others
    vectors += [(400, [1.0, 0.0, 0.0, 0.0]), (400, [0.0, 1.0, 0.0, 0.0]), (400, [1.0, 0.0, 0.0, 0.0]), (401, [1.0, 0.1, 0.0, 0.0])]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in vectors], "vec_id long, embedding array<float>, label int, cell string, node int, digest int").repartition(3)
    got = [(r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()]
    assert sorted(got) == sorted(brute_links(vectors))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_lattice_decoding_and_recall():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(500, 8)) * 3
    points = embedding_dedup.decode(y)
    for shift in embedding_dedup.neighbours():
        assert (((y - points) ** 2).sum(1) <= ((y - points - shift) ** 2).sum(1) + 1e-9).all()
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    apart = np.bitwise_count((embedding_dedup.signatures(a) ^ embedding_dedup.signatures(b)).view(np.uint64)).sum(axis=1)
    assert (apart <= embedding_dedup.MAX_BITS).mean() > 0.999
    for most, width, tables in embedding_dedup.LADDER:
        assert embedding_dedup.rung(most) == (width, tables)
        some = slice(None, 3000 if tables < 20 else 1000)
        met = [bool(set(x) & set(y)) for x, y in zip(embedding_dedup.cells(a[some], width, tables).tolist(), embedding_dedup.cells(b[some], width, tables).tolist(), strict=True)]
        assert np.mean(met) >= 0.998


@pytest.mark.parametrize("width, tables", [x[1:] for x in embedding_dedup.LADDER[:3]])
def test_near_vectors_by_hashing_alone(spark, monkeypatch, width, tables):
    monkeypatch.setattr(embedding_dedup, "LADDER", ((1 << 62, width, tables),))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    unit = np.array([v for _, v in vectors]) / np.linalg.norm([v for _, v in vectors], axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r["id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.999 * links.sum() and all(got[i] <= n for (i, _), n in zip(vectors, links.tolist(), strict=True))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


HARD = ["", "\\", "\\### Assistant: </turn> ok", "### User: x</turn>\n### a: b</turn>\n", "####", "<</turn>/turn>", "\\\\</turn", "a\nb", "é" * 5000, "</turn>" * 3]


def test_format_reads_back():
    turns = [(role, text) for role in ("user", "assistant", "", "a:b\\", "### x", "</turn>") for text in HARD]
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [x[:2] for x in chat.read_turns(formatted)] == turns


def test_layouts(spark):
    records = [
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
        ({"data": {"prompt": "p", "response": "r"}}, [("user", "p"), ("assistant", "r")]),
        ({"strange": 1}, []),
        ({"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": 7}], "id": "x", "meta": {"source": 1}}, [("user", "u"), ("assistant", "7")]),
        ({"system": "s", "question": None, "answer": 1.5, "lang": "en"}, [("system", "s"), ("assistant", "1.5")]),
        ({"prompt": "p", "question": "what else is there does not count", "answer": "a"}, [("user", "what else is there does not count"), ("assistant", "a")]),
        ({"prompt": "p", "response": "r" * 300_000}, [("user", "p"), ("assistant", "r" * 300_000)]),
        ({"prompt": "seed", "messages": [{"role": "user", "content": "u"}]}, [("user", "u")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "h"}]}, [("system", "s"), ("user", "h")]),
        ({"question": "q", "answer": "a", "text": "t"}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "output": "o", "system": "s"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a "}, {"type": "image_url", "image_url": {"url": "x"}}, {"type": "text", "text": " b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "a [image_url] b"), ("assistant", "c")]),
        ({"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f"}}]}, {"role": "tool", "content": "7"}]}, [("assistant", '{"tool_calls": [{"id": "1", "function": {"name": "f"}}]}'), ("tool", "7")]),
        ({"messages": []}, []),
        ({"messages": None, "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"messages": ["just a string"], "role": "user", "text": "t"}, [("user", "t")]),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, None), (91, "{broken"), (92, "[1]")]
    got = {r["k"]: r for r in chat.format_records(spark.createDataFrame(rows, "k long, j string"), "j", carry=("k",)).collect()}
    for i, (_, turns) in enumerate(records):
        assert [x[:2] for x in chat.read_turns(got[i]["formatted"])] == turns
        assert [got[i]["formatted"][a:b] for a, b in got[i]["loss_spans"]] == [t for r, t in turns if r == "assistant"]
    assert all(got[k]["layout"] == "unknown" and got[k]["n_turns"] == 0 for k in (5, 90, 91, 92))
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, formatted string, loss_spans array<array<bigint>>")).count() == 0


def test_op5_digests(spark, tmp_path):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], HARD[(c * 3 + t) % len(HARD)] or None) for c in range(12) for t in range(4)]
    rows += [(None, 0, "user", "x"), (20, None, "assistant", "y"), rows[0]]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    want = {}
    for r in [*rows, *queries.HARD]:
        want.setdefault(r[0], []).append((r[1] if r[1] is not None else -1, chat.format_turn(r[2] or "", r[3] or ""), r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(f) for _, f, *_ in turns)


URLS = [
    "http://example.net/en/1", "https://a.b.example.net/fr/1?x#y", "http://EXAMPLE.com/de/", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org/fr",
    "http://net/", "http://net", "no scheme", None, "", "://", "http://", "http://a.net?q=/en/", "http://x.example.net/en/http://y", "http://example-com/de/", "http://.net/", "http://a..net/b#c?d",
    "HTTP://Ünï.NET/En/", "http://example.com:80/de/", "http://com.example.net.example.com/de/x", "http://z.org/fr/" + "p" * 50_000,
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([i for i, c in enumerate(rest[cut:]) if c in "?#"], default=len(rest))]
    fit = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fit, key=lambda x: (-len(x[0]), x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    rules = [*url_filter.RULES, ("block", "b.example.net", "/"), ("allow", "a.b.example.net", "/fr/"), ("block", "a.b.example.net", "/fr/1"), ("block", "z.org", "/"), ("block", "a.net", "")]
    df = spark.createDataFrame([(i, u, 0, "k") for i, u in enumerate(URLS * 3)], "page_id long, url string, kind int, key string").repartition(4)
    for some in (rules, list(url_filter.RULES)):
        got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, tuple(some))).collect()}
        assert got == {i: brute_verdict(u, some) for i, u in enumerate(URLS * 3)}
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0
    # ids that are null or repeat; no rules; rules that repeat
    rows = spark.createDataFrame([(None, "http://a.net/"), (None, "http://a.org/"), (7, "http://x.net"), (7, "http://x.net/")], "page_id long, url string")
    twice = url_filter.rule_table(spark, (*url_filter.RULES, *url_filter.RULES))
    want = [(None, "http://a.net/", "net/"), (None, "http://a.org/", None), (7, "http://x.net", None), (7, "http://x.net/", "net/")]
    assert sorted(map(repr, (tuple(r) for r in url_filter.judge(rows, twice).select("id", "url", "rule").collect()))) == sorted(map(repr, want))
    assert {r["verdict"] for r in url_filter.judge(rows, twice.limit(0)).collect()} == {"allow"}


def test_urls_under_many_path_rules_of_one_host(spark):
    draw = np.random.default_rng(3)
    part = lambda: "/" + "/".join("".join(draw.choice(list("ab\u00e9"), 2)) for _ in range(draw.integers(1, 5)))
    rules = [("block" if i % 2 else "allow", host, p) for i, (host, p) in enumerate(sorted({(h, part()) for h in ("big.net", "x.big.net", "net") for _ in range(400)}))]
    urls = [f"http://{draw.choice(['big.net', 'a.big.net', 'x.big.net', 'y.x.big.net', 'net', 'o.net'])}{part()}{draw.choice(['', '/', 'q'])}" for _ in range(1500)]
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5), url_filter.rule_table(spark, tuple(rules))).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    many = spark.range(100_000).selectExpr("'block' AS verdict", "'big.net' AS host", "'/' || lpad(id, 6, '0') AS path")
    found = url_filter.judge(spark.createDataFrame([(1, "http://a.big.net/054321/x"), (2, "http://big.net/1")], "page_id long, url string"), many)
    assert {r["id"]: r["rule"] for r in found.collect()} == {1: "big.net/054321", 2: None}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def brute_near(rows):
    """Fingerprint of every text, and for each the first row (smallest id, null last) of its component."""
    from tests.llm.test_documents import brute_fingerprint

    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if root[b] < root[a] and (a ^ b).bit_count() <= 3:
                    root[a], changed = root[b], True
    first = {}
    for f, r in zip(fps, rows, strict=True):
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        first[root[f]] = min(first.get(root[f], rank), rank)
    return sorted(first.values())


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "src0", 5), (None, "a row without an id", None, "src0", 5), (None, "another row without any id", None, None, 5)], docs.schema))
    docs = docs.unionByName(docs.limit(3))
    rows = docs.collect()
    body = lambda r: "".join((r["text"] or "").split())
    library = Tokenizer.from_file(words.default_path())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert name == "BPE" or docs.columns == names
        before, rows = rows, docs.collect()
        if name == "language ID":
            assert sorted(map(repr, rows)) == sorted(repr(r) for r in before if any(c.isalpha() for c in r["text"] or ""))
        if name == "exact dedup":
            best = {}
            for r in sorted(before, key=lambda r: (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)):
                best.setdefault(body(r), r)
            assert sorted(map(repr, rows)) == sorted(map(repr, best.values()))
        if name == "SimHash near-dedup":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == brute_near(before)
            assert set(map(repr, rows)) <= set(map(repr, before))
        if name == "mixing":
            found = mixing.mix(spark.createDataFrame(before, docs.schema)).collect()
            taken = sorted((r["id"], r["taken"] // r["size"]) for r in found if r["size"] and r["taken"] and r["id"] is not None)
            assert sorted(Counter(r["doc_id"] for r in rows if r["doc_id"] is not None).items()) == taken
            for key, target in {(r["source_size"], r["target"]) for r in found}:
                assert abs(sum(r["taken"] for r in found if r["source_size"] == key) - target) <= 0.1 * key
        if name == "BPE":
            want = sorted(((r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in before), key=repr)
            assert sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows), key=repr) == want
            assert all(r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() for r in rows)


def test_pipeline_leaves_one_table_and_its_last_stage_s(spark, sf_dir, tmp_path, monkeypatch):
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["bpe", "pipeline"]


def test_pipeline_on_nothing_and_without_labels(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], schema), sf_dir)
        assert empty.count() == 0
        if name != "BPE":
            assert empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(1, "some words here", None, None, 3), (2, "12 34", None, None, 5), (3, None, None, None, None)]
    kept = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, schema), sf_dir)
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_null_ids_take_no_part(spark):
    v, w = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    df = spark.createDataFrame([(None, v), (None, w), (3, v), (5, w), (9, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in embedding_dedup.near_vectors(df).where("id is not null").collect())
    assert got == [(3, 1, 3), (5, 1, 3), (9, 0, 9)]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    words = "der und die ist nicht ein zu haben werden mit the and of to in a is that for it".split()
    rows = [(i, " ".join(words[(i * 7 + k) % len(words)] + str(k % 9) for k in range(40)) + " wort", "de", "s", 5, 1, 2, "x", "y", 3, 4, 5.0) for i in range(24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, row string, part string, size long, taken long, score double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        assert {(r["id"], r["fp"], r["row"], r["size"]) for r in docs.collect()} <= {(1, 2, "x", 3)}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 3 * len(rows)


def test_usable_vectors():
    import pyarrow as pa

    rows = [None, [], [0.0, -0.0], [1.0, None], [1.0, 2.0], [float("nan"), 1.0], [1.0, float("-inf")], [3.0]]
    for kind, width in (("<f4", 4), ("<f8", 8)):
        lists = pa.array(rows, pa.list_(pa.float32() if width == 4 else pa.float64()))
        got = embedding_dedup._usable(lists, kind)
        assert [b is None for b in got] == [True, True, True, True, False, True, True, False]
        assert np.frombuffer(got[4], kind).tolist() == [1.0, 2.0] and len(got[7]) == width
        assert embedding_dedup._usable(lists.slice(4, 1), kind) == got[4:5] and embedding_dedup._usable(lists.slice(0, 0), kind) == []
