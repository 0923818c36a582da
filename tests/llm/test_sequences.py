"""Packing, fill-in-middle and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from larkspur.llm import fim, packing, queries, repair, words

TEXTS = [None, "", " ", "plain words and 1 number", "Ünïcödé ñ 漢字 🙂 é", "a <P> b", "x<S", "<", "<P", "<M>", "<<S>>", "tie", "tie", "İstanbul ΣΑΣ", "don't <|endoftext|> stop", "x" * 5000, "ab cd " * 30_000]
NASTY = "aZ<>PSM é\n漢🙂1"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (3, "plain words and 1 number"), (3, "other")]
    draw = random.Random(4)
    rows += [(100 + i, "".join(draw.choices(NASTY, k=draw.choice((1, 2, 3, 7, 40, 1500))))) for i in range(150)]
    clash = ", id long, length int, task string, t string, h1 int, output string, form int, n int"
    return rows, spark.createDataFrame([(*r, 1, 2, "x", "y", 3, "z", 4, 5) for r in rows], "doc_id long, text string" + clash).repartition(3)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(words.default_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("longest, part", [(4096, 1 << 20), (8, 50)])
def test_packing(docs, library, monkeypatch, longest, part):
    monkeypatch.setattr(packing, "PART", part)
    rows, df = docs
    got = packing.pack(df, longest=longest).collect()
    want = defaultdict(int)
    for id, text in rows:
        want[id, tuple([*library.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    by_document = defaultdict(list)
    for r in got:
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= longest
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        by_document[r["id"], r["doc_tokens"]].append((r["start"], ids))
    for (id, tokens), n in {(i, len(t)): sum(c for (j, s), c in want.items() if (j, len(s)) == (i, len(t))) for i, t in want}.items():
        assert sum(len(x) for _, x in by_document[id, tokens]) == n * tokens
    for (id, ids), n in want.items():
        pieces = by_document[id, len(ids)]
        start = 0
        for length in packing.lengths(len(ids), longest):
            assert sum(p == (start, list(ids[start : start + length])) for p in pieces) >= n
            start += length
        assert start == len(ids)
    # numbers without a gap, longest bucket first
    numbered = sorted((r["sequence_id"], r["length"]) for r in got)
    assert [n for n, _ in numbered] == list(range(len(got)))
    assert [x for _, x in numbered] == sorted((x for _, x in numbered), reverse=True)
    assert packing.pack(df.limit(0)).collect() == []


def test_packing_cache_turns_over(library, monkeypatch):
    monkeypatch.setattr(packing, "GENERATION", 2000)
    cache = packing.WordIds(words.default_path())
    draw = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(20)) + " " + "z" * draw.choice((1, 3000))
        assert np.frombuffer(cache.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert cache.held <= 2000
    with pytest.raises(ValueError):
        packing.pack(None, longest=100)


def brute_fim(id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return id, n, "plain", None, None, text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block, chunk", [(1024, 1 << 20), (1, 1), (3, 7)])
def test_fill_in_middle(docs, monkeypatch, block, chunk):
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rows, df = docs
    if block < 1024:
        rows, df = [r for r in rows if len(r[1] or "") < 2000], df.where("coalesce(length(text), 0) < 2000")
    got = fim.fill_in_middle(df).withColumn("back", fim.restored()).collect()
    key = repr
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted((brute_fim(*r) for r in rows), key=key)
    assert sorted((r["back"] for r in got)) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_state_follows_from_two_bytes():
    for table in (fim.STEP, fim.UNIT, fim.CHARACTER):  # these two states differ in how they were reached alone
        assert (table[fim.WHOLE] == table[fim.SINGLE]).all()
    for a, b in itertools.product(range(fim.CLASSES), repeat=2):
        assert len({int(x) % fim.WHOLE for x in [*(fim.STEP[fim.STEP[s, a], b] for s in range(fim.STATES)), fim.AFTER[a, b]]}) == 1


def brute_damage(rows):
    out = []
    for place, (conv, turn, role, text) in enumerate(rows):
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits by Dijkstra's search over (row, state), audits kept whole."""
    sha = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, sha(r[2], r[3])))
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if to := step.get((state, role[0])):
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*made, f"{role}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] in (0, 3):
                extra = faults[i]
                if to := step.get((state, role[:1])):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if to := step.get((state, new[0])):
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, to, (*made, f"{new}:{text}")))
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(), made


def conversations(n=120):
    draw = random.Random(8)
    says = ["Yes.", "no", "Why?", " ", "", "ok\n", "Good! \t", None, "漢字。", "Well. And"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(draw.randint(0, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "System"])
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None, 0]), role, draw.choice(says)))
    return rows


def check(spark, rows, parts=3):
    clash = "conv long, part int, body string, digest string, row int, audit string, kind int"
    df = spark.createDataFrame([(*r, 1, 2, "b", "d", 3, "a", 4) for r in rows], "conv_id long, turn long, role string, text string, " + clash).repartition(parts)
    turns, found = repair.repair(df)
    made = defaultdict(list)
    for r in repair.repaired_turns(turns, found).orderBy("conv", "place").collect():
        assert r["place"] == len(made[r["conv"]])
        made[r["conv"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv"]: r["sha"] for r in repair.repaired_digests(turns, found).collect()}
    got = {r["conv"]: (*tuple(r)[1:], digests[r["conv"]], tuple(made[r["conv"]])) for r in found.collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((conv, turn, *(" " if x is None else x for x in (role, text))))
    assert got == {conv: brute_repair(mine) for conv, mine in by_conv.items()}


def test_repair(spark):
    rows = conversations()
    check(spark, rows + rows[:40])
    turns, found = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert found.collect() == [] and repair.repaired_digests(turns, found).collect() == []


def test_repair_long_conversations_over_many_ranges(spark, monkeypatch):
    draw = random.Random(1)
    monkeypatch.setattr(repair, "RUN", 16)
    rows = [(k, t, draw.choice(["user", "assistant", "system"]), f"{draw.choice(['Said.', 'cut'])} {t if t % 5 else 0}.") for k, n in ((1, 700), (2, 3), (3, 400), (4, 1)) for t in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_products_are_associative():
    draw = random.Random(2)
    kinds = list(repair.TURNS)
    for _ in range(300):
        run = draw.choices(kinds, k=draw.randint(2, 9))
        left = right = None
        for kind in run:
            left = repair.TURNS[kind] if left is None else repair.multiply(left, repair.TURNS[kind])
        for kind in reversed(run):
            right = repair.TURNS[kind] if right is None else repair.multiply(repair.TURNS[kind], right)
        assert left == right == repair.Products().of("".join(run))


def test_op13_damage_and_conversations_without_rows(spark, tmp_path):
    rows = conversations(150) + [(conv, 0, "user", "One.") for conv in range(1000, 1060)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_repair_conversations(spark, str(tmp_path)).collect()}
    by_conv = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        by_conv[r[0]].append(r)
    assert any(not v for v in by_conv.values())
    assert got == {conv: brute_repair(mine)[:-1] for conv, mine in by_conv.items()}
