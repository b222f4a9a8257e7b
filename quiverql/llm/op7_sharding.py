"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring of fixed resolution. A
row hashes to a cell of the ring and belongs to the first shard at or after
it; rows that find the shard full go on clockwise to the next point whose shard
has room. The bound on loads here is the tightest one: shard sizes add up to
the number of rows and differ by at most one (law ``rows``). With ``slack``
above zero shards may hold that share more, fewer rows overflow, and fewer
move when a shard is added.

Placement of a cell's rows depends only on how many rows each cell has, so the
walk round the ring is done on the driver over that table, whose size is the
ring's resolution whatever the input; rows then find their shard and slot by
their rank in the cell. Equal rows are counted before they are ranked, so a
row repeated without end makes one ranked row.

SQL functions only: no Python on the executors.

Defined results: a null text has no bytes and the check sum of the empty text;
a null ``doc_id`` is a key like any other; rows that agree in id, size and
check sum are interchangeable and fill consecutive places; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, document_texts

#: Cells of the ring (a power of two) and points of each shard.
CELL_BITS, POINTS = 14, 64
#: Repeats of one row that one task writes out.
REPEATS = 100_000
SEGMENT = "cell int, begins long, ends long, shard int, slot0 long"


def mix(x: int) -> int:
    """A 64-bit integer hash (the finaliser of SplitMix64)."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ x >> 31


def ring(shards: int) -> list[tuple[int, int]]:
    """(cell, shard) of all points, in ring order. A shard's points do not depend on the number of shards."""
    points = {}
    for shard in range(shards):
        for k in range(POINTS):
            cell, turn = mix(shard << 20 | k) >> (64 - CELL_BITS), 0
            while cell in points:  # a taken cell: the point's next hash decides
                turn += 1
                cell = mix(shard << 20 | k | turn << 40) >> (64 - CELL_BITS)
            points[cell] = shard
    return sorted(points.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(loads: dict[int, int], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, begins, ends, shard, slot0): ranks ``begins`` to ``ends`` of a cell go to ``shard`` from ``slot0`` on.

    Rows wait at the point they hashed to. In each turn every point takes what
    waits there as far as its shard has room, in ring order, and the rest moves
    to the next point; so each row ends at the first shard clockwise that had
    room when it came.
    """
    points = ring(shards)
    room, filled = capacities(sum(loads.values()), shards, slack), [0] * shards
    waiting: list[deque[tuple[int, int, int]]] = [deque() for _ in points]
    at = 0
    for cell in sorted(loads):
        while at < len(points) and points[at][0] < cell:
            at += 1
        waiting[at % len(points)].append((cell, 0, loads[cell]))
    out = []
    while any(waiting):
        moved: list[deque[tuple[int, int, int]]] = [deque() for _ in points]
        for k, (_, shard) in enumerate(points):
            for cell, begins, ends in waiting[k]:
                take = min(ends - begins, room[shard] - filled[shard])
                if take:
                    out.append((cell, begins, begins + take, shard, filled[shard]))
                    filled[shard] += take
                if begins + take < ends:
                    moved[(k + 1) % len(points)].append((cell, begins + take, ends))
        waiting = moved
    return out


def cell_of(*key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - CELL_BITS).cast("int")


def assign(docs: DataFrame, shards: int, slack: float = 0.0) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row; slots of a shard are gapless from 0."""
    text = F.coalesce("text", F.lit(""))
    rows = document_texts(docs).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    # size and check sum belong to the key, so that one id with very many texts does not crowd one cell
    kinds = kinds.withColumn("cell", cell_of("doc_id", "size", "text_crc32"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("doc_id", "size", "text_crc32"), "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = Written(kinds.withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))).df
    loads = {r.cell: r.n for r in ranked.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most 2 ** CELL_BITS rows
    segments = place(loads, shards, slack)  # at most one for each cell and turn of a full shard
    placed = ranked.sparkSession.createDataFrame(segments, SEGMENT)
    r, s = ranked.alias("r"), F.broadcast(placed).alias("s")
    first, last = F.greatest("r.begin", "s.begins"), F.least(F.col("r.begin") + F.col("r.n"), F.col("s.ends"))
    met = r.join(s, (F.col("r.cell") == F.col("s.cell")) & (F.col("r.begin") < F.col("s.ends")) & (F.col("r.begin") + F.col("r.n") > F.col("s.begins")))
    runs = met.select("r.doc_id", "r.size", "r.text_crc32", "s.shard", (F.col("s.slot0") + first - F.col("s.begins")).alias("slot"), (last - first).alias("n"))
    blocks = runs.select("doc_id", "size", "text_crc32", "shard", F.posexplode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1, F.lit(REPEATS).cast("long"))).alias("k", "slot"), "n")
    left = F.col("n") - F.col("k") * REPEATS
    each = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.least(left, F.lit(REPEATS).cast("long")) - 1))
    return blocks.select("doc_id", "size", "text_crc32", "shard", each.alias("slot"))


def digests(docs: DataFrame, shards: int) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
