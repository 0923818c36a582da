"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; a row's cell comes from a hash of its id.  Every shard owns ``VNODES`` virtual nodes
and a row's home is the first one clockwise from its cell.  Shards have capacities that add up to the number of rows
and differ by one at most; what a full shard cannot take continues clockwise, so counts are balanced exactly.  Only the
histogram of cells, ``CELLS`` numbers whatever the corpus, goes to the driver; the placement comes back as ranges of
ranks within cells, at most one more range per cell than shards that fill up there.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VNODES = 128
#: Rows of one cell that are ranked together at most, or four times an even share where that is more.
SPLIT = 1 << 18


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("/".join(map(str, parts)), 7)


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order."""
    return sorted((_hash("vnode", s, v) % CELLS, s) for s in range(shards) for v in range(vnodes))


def place(counts: dict[int, int], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(cell, from_rank, to_rank, shard, first_slot)`` for the rows of every cell.

    Cells arrive in the order of a hash; each goes to its home and, beyond what that can take, on clockwise.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    nodes = ring(shards, vnodes)
    at = [cell for cell, _ in nodes]
    out = []
    for cell in sorted(counts, key=lambda c: (_hash("cell", c), c)):
        start, here = 0, bisect_left(at, cell)
        while start < counts[cell]:
            shard = nodes[here % len(nodes)][1]
            if take := min(room[shard] - filled[shard], counts[cell] - start):
                out.append((cell, start, start + take, shard, filled[shard]))
                filled[shard] += take
                start += take
            here += 1
    return out


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot)`` for every row; ``law`` is ``rows``: counts differ by one at most.

    ``size`` is the UTF-8 bytes of the whole text, however long (null: none), plus 1.  ``slot`` numbers the rows of a shard
    without gaps from 0.  Rows with a null id share one cell, as do rows of one id; repeated rows take a slot each; other
    columns are ignored; an empty table gives an empty result.  Rows of a cell are ranked by hash, id, size and CRC; a
    cell over ``SPLIT`` rows, which only a hot id makes, is dealt over parts by row number and ranked within each.
    """
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    cell = F.shiftrightunsigned(F.xxhash64(F.lit(16), F.col(id_col).cast("string")), 64 - CELL_BITS).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # CELLS rows at most
    spark = docs.sparkSession
    ranges = spark.createDataFrame(place(counts, shards), "cell int, first long, last long, shard int, slot long")
    split = max(SPLIT, 4 * sum(counts.values()) // CELLS)
    hot = spark.createDataFrame([(c, -(-n // split)) for c, n in counts.items() if n > split], "cell int, parts int")
    order = Window.partitionBy("cell", "part").orderBy(F.xxhash64("id"), "id", "size", "text_crc32")
    # ranges and hot hold a few entries a cell at most, whatever the corpus
    dealt = rows.join(F.broadcast(hot), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)))
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.where("parts is not null").groupBy("cell", "part").count().select("cell", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(order) - F.lit(1).cast("long"))
    if any(n > split for n in counts.values()):
        ranked = ranked.join(F.broadcast(parts), ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(F.broadcast(ranges), "cell").where("rank >= first and rank < last")
    return placed.select("id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))
