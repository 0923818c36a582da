"""Operators on documents against brute force, with the awkward rows that every one of them must take."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import bpe, common, exact_dedup, langid, mixing, sharding, simhash, token_count, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, h string, key int"
TEXTS = [
    "The quick brown fox jumps over the lazy dog",
    "the  quick brown\tfox jumps over the lazy dog\n",
    "The quick brown fox jumps over the lazy dog",
    None,
    "",
    " \n\t\x0b\x0c\r",
    "été ÉTÉ naïve Straße µ² ½ don't it's we'll 'sx ''s 123 a1b2",
    "İstanbul ΣΑΣ Ωμέγα é 日本語 привет мир 👍🏽 ẞ Å ͅ",
    "a<|endoftext|>b <|startoftext|> <|endoftext",
    "x\x85y\xa0z \x1c\x1d\x1e\x1f \x00 end",
    "word " * 30_000,
    "12345 !!! ???",
    "Ünïcödé ... ­​ zero",
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 2 else None, [None, "b", "a", ""][i % 4], None, 7, 1, "x", 2) for i, t in enumerate(TEXTS)]
    return [*out, out[0], out[0], (None, "no id", "en", "b", 5, 7, 1, "x", 2), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(words.default_path())


def keyed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_words_are_the_library_s(library):
    cut = words.tokenizer(words.default_path())
    low = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} " for c in range(1, 0x300))
    for text in [*TEXTS, low]:
        ids = [i for w in cut.encode(cut.words(text)) for i in w] if text else []
        assert ids == library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, rows, library):
    want = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    got = token_count.token_counts(docs, limit=100)
    assert keyed(got, "id", "n_bytes", "n_tokens") == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.collect())


def test_token_counts_cache_turns_over(library, monkeypatch):
    monkeypatch.setattr(token_count, "GENERATION", 450)
    cut = words.tokenizer(words.default_path())
    lengths = token_count.Lengths({"the": 1}, cut)
    for text in ["the one two three", "four five six the", "one seven eight nine", "the one two three four"]:
        assert lengths.total(cut.words(text)) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_long_words(spark, library, monkeypatch):
    texts = ["z" * 300_000, "ab " * 3 + "q" * 5_000, "ab ab"]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    assert max(map(len, token_count.frequent(docs, "text", words.default_path()))) <= token_count.LONGEST
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts * 3]
    assert [r["n_tokens"] for r in token_count.token_counts(docs).orderBy("id").collect()] == want


def test_frequency_summary_keeps_heavy_hitters():
    merged = Counter()
    for part in range(20):
        merged.update(token_count._shrink(Counter({"hot": 500, **{f"w{part}.{i}": 1 for i in range(300)}}), 50))
        merged = token_count._shrink(merged, 50)
    assert merged.most_common(1)[0][0] == "hot"


def test_bpe_round_trip(docs, rows, library):
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    got = [(r["id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_small_blocks(docs, rows, library, monkeypatch, spark):
    run = bpe._blocks(words.default_path(), 3)
    assert run is not None
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 10)
    monkeypatch.setattr(bpe, "SEND_BYTES", 10)
    got = bpe.encode_decode(docs.repartition(1))
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)


def test_bpe_words_of_many_tokens(spark, library):
    texts = ["a" * 1_000_000, "".join(np.random.default_rng(7).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "".join(chr(0x4E00 + i % 20_000) for i in range(60_000))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(ids) > 65_535 and len(words.tokenizer(words.default_path()).words(t)) == 1 for ids, t in zip(want, texts, strict=True))
    got = {r["id"]: r for r in bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, ids in enumerate(want):
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_exact(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(exact_dedup.normalise((r[1] or "").encode()), []).append(r)
    want, taken = [], set()
    for r in rows:
        body = exact_dedup.normalise((r[1] or "").encode())
        best = min(groups[body], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        want.append((r[0], best[0], len(groups[body]), r[0] == best[0] and (r[1] or "") == (best[1] or "") and body not in taken, hashlib.sha256(body).hexdigest()))
        taken |= {body} if want[-1][3] else set()
    assert keyed(exact_dedup.exact_duplicates(docs), "id", "keep_id", "group_size", "kept", "sha") == sorted(want, key=repr)
    only = exact_dedup.owners_only(docs)
    assert only.columns == docs.columns and only.count() == len(groups)


TRIE_KEYS = {
    "random": lambda draw: [bytes(draw.integers(97, 99 + i % 4, size=int(draw.integers(0, 40))).tolist()) for i in range(600)],
    "shared prefix": lambda draw: [b"h" * 3_000 + bytes(draw.integers(97, 123, size=30).tolist()) for i in range(200)] * 2,
    "long alike": lambda draw: [b"z" * 50_000 + bytes([97 + i % 5]) for i in range(20)] + [b"y" * 40_000, b"y" * 39_999 + b"q"] + [b"x" * n for n in (0, 1, 2, 30_000)],
    "chain": lambda draw: [b"ab" * n for n in range(400)],
}


@pytest.mark.parametrize("budget", [1 << 30, 4000, 600])
@pytest.mark.parametrize("kind", sorted(TRIE_KEYS))
def test_trie_spills(budget, kind, tmp_path):
    keys = TRIE_KEYS[kind](np.random.default_rng(1))
    scratch = exact_dedup.Scratch(str(tmp_path))
    trie = exact_dedup.PatriciaTrie(budget, scratch)
    for i, k in enumerate(keys):
        trie.insert(k, exact_dedup.Owner(i % 7, i, 1, 0, hashlib.sha256(k).digest() + b"\0" * 8))
    assert bool(trie.spilled) == (budget < 1 << 20)
    got = {}
    for o in trie.owners():
        assert o.sha not in got
        got[o.sha] = (o.id, o.copies)
    want = {}
    for k in set(keys):
        mine = [i for i, x in enumerate(keys) if x == k]
        want[hashlib.sha256(k).digest() + b"\0" * 8] = (min(mine, key=lambda i: (-(i % 7), i)), len(mine))
    assert got == want
    assert not list(tmp_path.iterdir()) and not scratch.held
    assert scratch.next < 20 * len(keys)  # far fewer than bytes


def test_exact_spills_end_to_end(spark, monkeypatch):
    # a small budget travels to the workers within the function that they run
    texts = ["license " * 400 + f"body {i % 150}" for i in range(300)] + ["x" * 200_000 + str(i % 3) for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)

    def own(batches):
        exact_dedup.TRIE_BYTES = 4_000
        yield from exact_dedup._own(batches)

    folded = exact_dedup._rows(docs, "doc_id", "text").mapInArrow(exact_dedup._fold, exact_dedup._FOLDED).repartition(1)
    found = folded.select("sha", "body", "chars", "id", "copies", "raw", "alike").mapInArrow(own, exact_dedup._CLASSES).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in found) == sorted([(i, 2) for i in range(150)] + [(300 + i, 3) for i in range(3)])


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    low = {}
    none = 10**9
    for f, r in zip(fps, rows, strict=True):
        low[f] = min(low.get(f, none), none if r[0] is None else r[0])
    label = {f: low[f] for f in fps}
    for _ in fps:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    label = {f: None if x == none else x for f, x in label.items()}
    got = [(r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], f, label[f]) for r, f in zip(rows, fps, strict=True)), key=repr)


def test_golay_keys_never_miss():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, size=4000, dtype=np.uint64) * 2 + rng.integers(0, 2, size=4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, size=4000, dtype=np.uint64)
    keys = [set(), set()]
    for side, fps in zip(keys, (a, b), strict=True):
        r, k = simhash.fuzzy_keys(fps)
        side.update(zip(r.tolist(), k.tolist(), strict=True))
    assert {r for r, _ in keys[0] & keys[1]} == set(range(4000))


def test_simhash_links_by_fingerprint_alone(spark):
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:399])
    rows = [(None, " ".join(words)), (7, near), (7, "something else entirely, said once"), (3, "another text that is far from all"), (None, "null id alone, with words of its own"), (3, "another text that is far from all")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, fp int, row int")
    assert (brute_fingerprint(rows[0][1]) ^ brute_fingerprint(near)).bit_count() <= 3
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (3, 3), (3, 3), (None, None)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[3], rows[4]], key=repr)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_long_runs_link_like_short_ones(dense):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, size=2 if dense else 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(i) for i in range(40 if dense else 5)]
    fps = np.unique(np.concatenate([base, *(base ^ f for f in flips)]))
    ids = np.arange(len(fps))
    two = common.Forest()
    for i in ids:
        for j in ids[:i]:
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                two.link(int(i), int(j))
    for keys in (np.zeros(len(fps)), np.arange(len(fps)) // 20):
        one = common.Forest()
        simhash._verify(keys, ids, fps, one)
        if not keys.any():
            assert [one.find(int(i)) for i in ids] == [two.find(int(i)) for i in ids]
        else:
            assert all(two.find(int(i)) == two.find(one.find(int(i))) for i in ids) and len(one.parent) > 1


def test_shards(docs, rows):
    got = sharding.shard_rows(docs, 5).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(5)]
    assert max(counts) - min(counts) <= 1 and len(got) == len(rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want


def test_shards_match_a_walk_around_the_ring(spark):
    rows = [(i % 300, f"text {i}") for i in range(900)] + [(None, "x")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cell = F.shiftrightunsigned(F.xxhash64(F.lit(16), F.col("doc_id").cast("string")), 48).cast("int").alias("cell")
    of = {r["doc_id"]: r["cell"] for r in docs.select("doc_id", cell).distinct().collect()}
    nodes = sorted((sharding._hash("vnode", s, v) % sharding.CELLS, s) for s in range(6) for v in range(sharding.VNODES))
    room = [len(rows) // 6 + (s < len(rows) % 6) for s in range(6)]
    want = Counter()
    for c in sorted(set(of.values()), key=lambda c: (sharding._hash("cell", c), c)):
        for _ in range(sum(of[i] == c for i, _ in rows)):
            # the first shard with room, clockwise from the cell
            clockwise = [s for at, s in nodes if at >= c] + [s for at, s in nodes if at < c]
            shard = next(s for s in clockwise if room[s])
            room[shard] -= 1
            want[c, shard] += 1
    assert Counter((of[r["id"]], r["shard"]) for r in sharding.shard_rows(docs, 6).collect()) == want


def test_shards_split_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPLIT", 10)
    monkeypatch.setattr(sharding, "CELLS", 1 << 16)
    rows = [(None, f"t{i % 3}") for i in range(500)] + [(7, "x")] * 200 + [(i, "y") for i in range(100)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 7).collect()
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)}
    assert len(got) == 800 and all(slots == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_ring_moves_little_and_fills_exactly():
    counts = {c: 3 for c in range(0, sharding.CELLS, 31)}
    homes = {}
    for shards in (16, 17):
        placed = sharding.place(counts, shards)
        load = [0] * shards
        for cell, first, last, shard, slot in placed:
            assert slot == load[shard]
            load[shard] += last - first
            homes.setdefault(shards, {}).update({(cell, i): shard for i in range(first, last)})
        assert sum(load) == sum(counts.values()) and max(load) - min(load) <= 1
    moved = np.mean([homes[16][k] != homes[17][k] for k in homes[16]])
    assert moved < 0.1


def test_mix_edges(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    total = sum(r["size"] for r in got)
    per_source = {r["source_size"]: r["target"] for r in got}
    assert total > 0 and per_source
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns


def test_mix_comes_near_its_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= max(0.02 * r["target"], 30) for r in got)


def test_mix_source_of_one_long_document(spark):
    # b: target 9,500 of 10,000 words, 9,000 of them in one document
    rows = [(i, "w " * (9_000 if i == 50 else 10), "b") for i in range(101)] + [(1000, "w " * 23_250, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs).collect() if r["source_size"] == 10_000]
    assert {r["target"] for r in got} == {9_500.0} and sum(r["taken"] for r in got) == 9_500
    assert mixing.mixed_documents(docs).where("source = 'b'").count() == 51
    # one document of 1,000 words and a target of 700: it is nearer than nothing
    docs = spark.createDataFrame([(1, "w " * 1_000, "b"), (2, "w " * 1_450, "a")], docs.schema)
    assert {r["id"]: (r["target"], r["taken"]) for r in mixing.mix(docs).collect()} == {1: (700.0, 1_000), 2: (1_750.0, 1_450)}


def test_mix_repeats_and_null_ids(spark):
    # b: weight 2 of 7, 50 rows of one text without ids, 40 of one id; c fills the rest
    rows = [(None, "ten words " * 5, "b")] * 50 + [(7, "one row again and again", "b")] * 40 + [(i, "w " * 500, "a") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs)
    (b,) = [r for r in got.where("source_size = 700").groupBy("target").agg({"taken": "sum"}).collect()]
    assert abs(b["sum(taken)"] - b["target"]) <= 0.02 * b["target"] and got.count() == len(rows)
    assert mixing.mixed_documents(docs).count() == got.selectExpr("sum(taken / size)").first()[0]
    one = spark.createDataFrame([(None, "same words here", "a")] * 1_000 + [(None, "same words here", "b")] * 1_500, docs.schema)
    for r in mixing.mix(one).groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 2


def test_mix_large_documents_come_near(spark):
    draw = np.random.default_rng(11)
    sizes = {s: [int(x) for x in draw.pareto(0.7, 60) * 20 + 1] for s in "abcdef"}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, min(n, 20_000)) for s in sizes for n in sizes[s])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= 0.03 * r["source_size"]


def test_mix_targets_water_fill(spark):
    sizes = {"0a": 10, "0b": 1000, "0c": 2000, "0d": 40, "1": 0}
    sized = spark.createDataFrame(list(sizes.items()), "skey string, size long")
    got = {r["skey"]: r["target"] for r in mixing.targets(sized).collect()}
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5, 2), strict=True))
    want, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


def test_language_und_and_scores(docs, rows):
    learned = {"en": "the quick brown fox jumps over the lazy dog " * 5, "fr": "le renard brun saute par dessus le chien paresseux été naïve " * 5}
    got = langid.identify(docs, learned).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
    by = {r["id"]: r["lang_pred"] for r in got if r["id"] is not None}
    assert by[0] == "en" and {by[3], by[4], by[5], by[11]} == {"und"}
    kept = langid.identify(docs, learned, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)


def test_language_learns_every_label(spark, monkeypatch):
    draw = np.random.default_rng(9)
    lexicon = {f"l{k:02}": ["".join(map(chr, draw.choice(range(0x61, 0x7B), 6))) for _ in range(40)] for k in range(70)}
    rows = [(i, " ".join(draw.choice(w, 60)), lang) for i, (lang, w) in enumerate((x for x in lexicon.items() for _ in range(8)))]
    rows += [(None, "hot null id", "l00")] * 500 + [(10_003, None, "none"), (10_005, "", "l01")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TOTAL_CHARS", 70 * 1_500)
    learned = langid.samples(docs)
    assert set(learned) == set(lexicon) and max(map(len, learned.values())) <= 1_500
    found = langid.identify(docs, learned).withColumnRenamed("id", "doc_id").join(docs.where(langid.held_out()), "doc_id")
    assert found.where("lang <> lang_pred and lang_pred <> 'und'").count() <= 0.02 * found.count() and found.count() > 60
    model = langid.Model({k: learned[k] for k in ("l00", "l01", "l02")})
    for text in [" ".join(draw.choice(lexicon[k], 30)) for k in ("l00", "l01", "l02")]:
        # the winner by plain parsing of each language's sample
        cost = []
        for k, lang in enumerate(model.langs):
            train, codes, n = bytes(model.codes(learned[lang])), bytes(model.codes(text)), 0
            for at in range(0, len(codes), langid.WINDOW):
                phrase, n = b"", n + 1
                for c in codes[at : at + langid.WINDOW]:
                    phrase += bytes([c])
                    if phrase not in train:
                        n, phrase = n + 1, bytes([c]) if bytes([c]) in train else b""
            cost.append(n * model.bits[k])
        assert model.predict([text])[0] == [model.langs[int(np.argmin(cost))]]


def test_language_phrases_match_plain_parsing():
    sample = "abracadabra simsalabim hocus pocus " * 3
    model = langid.Model({"x": sample})
    text = "abra hocus simpoc zzz cadabrahoc"
    train, codes = bytes(model.codes(sample)), bytes(model.codes(text))
    n, at = 1, 0
    for i in range(1, len(codes) + 1):
        if codes[at:i] not in train:
            n, at = n + 1, i - 1 if codes[i - 1 : i] in train else i
    assert model.phrases([model.codes(text)])[0, 0] == n


SCRIPTS = {
    "en": range(0x61, 0x7B), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3C2), "uk": range(0x434, 0x458), "ar": range(0x628, 0x640), "fa": range(0x62F, 0x64A),
    "ja": [*range(0x3041, 0x3090), *range(0x4E00, 0x5000)], "zh": range(0x4E00, 0x5800), "ko": range(0xAC00, 0xB400),
}


def test_language_tells_languages_of_many_scripts_apart():
    draw = np.random.default_rng(3)
    lexicon = {lang: ["".join(map(chr, draw.choice(list(letters), draw.integers(2, 6)))) for _ in range(400)] for lang, letters in SCRIPTS.items()}
    model = langid.Model({lang: " ".join(draw.choice(w, 4_000)) for lang, w in lexicon.items()})
    for lang, w in lexicon.items():
        assert set(model.predict([" ".join(draw.choice(w, 12)) for _ in range(20)])[0]) == {lang}


@pytest.mark.parametrize("alphabet", [2, 60])
def test_language_phrases_of_many_letters_match_plain_parsing(monkeypatch, alphabet):
    monkeypatch.setattr(langid, "ALPHABET", alphabet)
    draw = np.random.default_rng(5)
    samples = {lang: "".join(map(chr, draw.choice(list(SCRIPTS[lang]), 3_000))) for lang in ("en", "ja", "zh")}
    model = langid.Model(samples)
    text = "".join(samples[lang][at : at + 7] for lang in samples for at in range(0, 70, 9))
    for k, lang in enumerate(model.langs):
        n, phrase = 1, ""
        for ch in text:
            phrase += ch
            if phrase not in samples[lang]:
                n, phrase = n + 1, ch if ch in samples[lang] else ""
        assert model.phrases([model.codes(text)])[0, k] == n


@pytest.mark.parametrize("table", ["sf0.01"])
def test_language_held_out_accuracy(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    found = langid.identify(docs, langid.samples(docs)).withColumnRenamed("id", "doc_id").join(docs.where(langid.held_out()), "doc_id")
    right = found.where("lang = lang_pred").count() / found.count()
    assert right > 0.97


def test_empty_tables(none):
    assert token_count.token_counts(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert langid.identify(none, langid.samples(none)).count() == 0
