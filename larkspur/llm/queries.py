"""The registered queries of the ten operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, exact_dedup, fim, langid, mixing, packing, repair, sharding, simhash, token_count, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_count.token_counts(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(_table(spark, sf_dir, "documents"), 16)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A conversation whose texts hold the template's own marks.
HARD = tuple((-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(list(HARD), "conv_id long, turn long, role string, text string"))
    # a row as a record of its own, numbered as sources do; the layout is found from the record
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"))
    parts = chat.format_records(rows.withColumn("record", record), "record", carry=("conv_id", "turn"))
    return chat.conversation_digests(parts)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.samples(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    sha = [F.sha2(text.cast("binary"), 256).alias(name) for text, name in ((F.col("output"), "output_sha256"), (fim.restored(), "restored_sha256"))]
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *sha)


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    turns, found = repair.repair(repair.damaged(rows), "conv", "turn", "role", "text")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    digests = repair.repaired_digests(turns, found).withColumnRenamed("conv", "of")
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


_QUERIES = (
    op1_lattice_dedup, op2_exact_dedup, op3_token_counts, op4_ring_shards, op5_chat_format, op6_simhash_dedup, op7_bpe_roundtrip,
    op8_mix_sources, op9_language_id, op10_url_filter, op11_pack_powers, op12_fill_in_middle, op13_repair_conversations,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_OP1 = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
    WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
    SELECT a, min(b) AS low FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""

_OP2 = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY body) AS group_size,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id
    FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""

_OP5 = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) hard
), f AS (
    SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
              || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10) AS formatted
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

_OP8 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
    FROM d GROUP BY source
), o AS (
    SELECT *, 3.0::DOUBLE * source_size AS cap,
           sum(source_size) OVER ()::DOUBLE AS total,
           coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS caps,
           sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest,
           row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k
    FROM s WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
    SELECT (total - caps) / rest AS level FROM o WHERE (total - caps) / rest * w <= cap ORDER BY k LIMIT 1
), t AS (
    SELECT source, source_size, coalesce(least(cap, (SELECT level FROM v) * w), cap) AS target FROM o
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t
), q AS (
    SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE target - whole * source_size END::DOUBLE AS budget FROM b
), r AS (  -- rows with what is known of their source; the large ones by falling size class and hash, the others by hash
    SELECT d.doc_id, d.size, d.h, q.*, d.size * 1024 > q.source_size AS large,
           row_number() OVER (PARTITION BY d.source, d.size * 1024 > q.source_size ORDER BY CASE WHEN d.size * 1024 > q.source_size THEN -length(bin(d.size)) END, d.h, d.doc_id) AS k
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), g AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k)::BIGINT AS seen FROM r WHERE large
), f AS (  -- words taken stay nearest to the share of those seen
    SELECT source, 0::BIGINT AS k, 0::BIGINT AS taken, false AS pick FROM q
    UNION ALL
    SELECT f.source, g.k, f.taken + CASE WHEN 2 * f.taken + g.size < 2 * (g.budget * g.seen / g.source_size) THEN g.size ELSE 0 END,
           2 * f.taken + g.size < 2 * (g.budget * g.seen / g.source_size)
    FROM f JOIN g ON g.source IS NOT DISTINCT FROM f.source AND g.k = f.k + 1
), l AS (
    SELECT z.source, z.taken, coalesce(y.words, 0)::BIGINT AS words FROM (SELECT source, max(taken) AS taken FROM f GROUP BY source) z
    LEFT JOIN (SELECT source, sum(size) AS words FROM g GROUP BY source) y ON y.source IS NOT DISTINCT FROM z.source
), n AS (
    SELECT g.doc_id, g.size, g.source_size, g.target, g.whole, f.pick AS more FROM g JOIN f ON f.source IS NOT DISTINCT FROM g.source AND f.k = g.k
    UNION ALL
    SELECT r.doc_id, r.size, r.source_size, r.target, r.whole,
           2 * (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k) - r.size) + r.size <= 2 * greatest(0, least(r.source_size - l.words, r.budget - l.taken)) AS more
    FROM r JOIN l ON l.source IS NOT DISTINCT FROM r.source WHERE NOT r.large
)
SELECT doc_id, size, source_size, target, (size * (whole + more::INT))::BIGINT AS taken FROM n
"""

_OP10 = r"""
WITH u AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r(verdict, host, path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
    SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS k
    FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""


_OP12 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM d
), c AS (
    SELECT doc_id, t, u, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
           CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
), o AS (
    SELECT doc_id, n, form, t, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


def _edit(way: str, cost: str, letter: str, line: str = "''") -> str:
    """A way, ``cost in nine digits || audit || chr(1) || repaired lines``, with one more edit; null stays null."""
    mark = f"instr({way}, chr(1))"
    return f"lpad((substr({way}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({way}, 10, {mark} - 10) || '{letter}' || substr({way}, {mark}) || {line}"


def _inserted(way: str, *roles: str) -> str:
    for role in roles:
        way = f"({_edit(way, '3', 'I', f"'{role}:' || chr(10)")})"
    return way


def _op13() -> str:
    u, a = "user", "assistant"
    closed = f"""w0, w1, least(w2, {_inserted("w0", u)}, {_inserted("w1", u)}, {_inserted("w3", u)}) AS w2,
               least(w3, {_inserted("w2", a)}, {_inserted("w0", u, a)}, {_inserted("w1", u, a)}) AS w3"""
    keep, rerole = "CASE fault WHEN 3 THEN 3 ELSE 0 END", "CASE fault WHEN 3 THEN 6 ELSE 3 END"

    def by(initial: str, way: str) -> str:
        return f"CASE WHEN fault IN (0, 3) AND left(role, 1) = '{initial}' THEN {_edit(way, keep, 'K', "role || ':' || text || chr(10)")} END"

    def new(role: str, way: str) -> str:
        return f"CASE WHEN fault IN (0, 3) THEN {_edit(way, rerole, 'R', f"'{role}:' || text || chr(10)")} END"

    gone = [_edit(f"w{i}", "4", "D") for i in range(4)]
    steps = [
        gone[0],
        f"least({gone[1]}, {by('s', 'w0')})",
        f"least({gone[2]}, {', '.join(f'{by("u", w)}, {new(u, w)}' for w in ('w0', 'w1', 'w3'))})",
        f"least({gone[3]}, {by('a', 'w2')}, {new(a, 'w2')})",
    ]
    return rf"""
WITH RECURSIVE z AS (  -- with the CRC-32 of conv_id:turn, bit by bit
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
               lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384))) % 20 AS draw
    FROM conversations
), d AS (
    SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM z, (VALUES (0), (1)) copies(k) WHERE draw <> 0 AND (k = 0 OR draw = 3)
), o AS (
    SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS i
    FROM d
), f AS (
    SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
           CASE WHEN said = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM o
), w AS (  -- the cheapest way to each state: nothing yet, after system, user, assistant
    SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM f
    UNION ALL
    SELECT e.conv_id, f.i, {steps[0]}, {steps[1]}, {steps[2]}, {steps[3]}
    FROM (SELECT conv_id, i, {closed} FROM w) e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i + 1
), n AS (
    SELECT conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
           count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
), b AS (
    SELECT n.*, least(e.w0, e.w3) AS way FROM n JOIN (SELECT conv_id, i, {closed} FROM w) e ON e.conv_id IS NOT DISTINCT FROM n.conv_id AND e.i = n.i
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(way, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(way, 10, instr(way, chr(1)) - 10), '') AS audit,
       sha256(coalesce(regexp_replace(substr(way, instr(way, chr(1)) + 1), '\n$', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op1_lattice_dedup": _OP1, "op2_exact_dedup": _OP2, "op5_chat_format": _OP5, "op8_mix_sources": _OP8, "op10_url_filter": _OP10, "op12_fill_in_middle": _OP12, "op13_repair_conversations": _op13()}
