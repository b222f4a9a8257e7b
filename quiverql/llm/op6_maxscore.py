"""Exact top-k by inner product, with MaxScore over dimensions as terms.

A vector is a document whose terms are its dimensions, with integer weights of
either sign. Each shard of rows is an inverted index, dimension by dimension. A
query's terms are ordered by the most they can add to any row of the shard (the
larger of its weight times the shard's greatest and its least weight in that
dimension). The terms whose joint bound cannot lift a row past the query's
current k-th score are non-essential: postings of the essential ones are
traversed for all rows, and only rows that can still compete are probed for
the others, in chunks, until none is left or all terms are in. Rows are dropped
only when their bound is strictly below the k-th score, so ties are exact.

Rows are dealt to shards of about ``SHARD`` rows and queries to blocks of about
``BLOCK``; each pair of a shard and a block is one task's work, which keeps k
rows for each query, and shards are merged by rank. So neither rows nor queries
are gathered anywhere, and what a task holds is bounded. The rows of a shard are
read again for each block, as work grows with rows times queries in any case.

Scores are exact: sums that fit a double's 53 bits are computed as doubles,
others as integers without bound.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; a vector that is shorter than others has zeros for the dimensions
it lacks, so an empty one scores 0; a query is taken once for each id (of rows
that repeat an id, the least vector), and rows with the query's id are not its
candidates; all candidate rows count, so repeated rows take several ranks; a
null id takes no part; a score beyond a long is given as the nearest long, and
such scores rank by the exact value up to 38 digits; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Queries of a block, rows of a shard, and dimensions that are added before rows are dropped again.
BLOCK, SHARD, STEP = 2_048, 10_000, 8
#: Rows of a shard that are searched before any can be left out.
STEP_ROWS = 512
#: Bounds of a long, and of the scores that shards hand on.
LONG, WIDE = 2**63, 10**38


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x): whole, finite vectors, as doubles."""
    x = F.col("x")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & ok)


def integers(lists: pa.ListArray, width: int) -> np.ndarray:
    """floor(1024 x) of every component, in rows of ``width``: as doubles where these are exact and finite, else as Python integers."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if not np.isfinite(scaled).all():
        scaled = np.array([int(c) * SCALE if abs(c) > 2.0**60 else math.floor(c * SCALE) for c in flat.tolist()], dtype=object)
    out = np.zeros((len(n), width), dtype=scaled.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = scaled
    return out


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums of products are exact in them, else as Python integers."""
    if rows.dtype == queries.dtype == np.float64 and float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < 2.0**52:
        return rows, queries
    return tuple(np.array([int(c) for c in x.ravel().tolist()], dtype=object).reshape(x.shape) for x in (rows, queries))


def search_shard(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Take rows of a shard into ``best`` (scores and ids of each query's k best so far). Returns the terms that were added up."""
    postings = np.ascontiguousarray(rows.T)
    top, low = postings.max(axis=1), postings.min(axis=1)
    bounds = np.maximum(queries * top, queries * low)
    order = np.argsort(-np.abs(queries) * (top - low), axis=1, kind="stable")
    work = 0
    for q in range(len(queries)):
        weight, turn = queries[q], order[q]
        scores, held = best[q]
        full = len(scores) == k
        least = scores.min() if full else None
        left = np.r_[np.cumsum(bounds[q][turn][::-1])[::-1], 0]  # the most that the terms from here on add
        if full and left[0] < least:
            continue
        # essential terms: up to where the rest alone cannot reach the k-th score
        essential = int(np.argmax(left <= min(least, 0))) if full and (left <= min(least, 0)).any() else min(STEP, len(turn))
        essential = max(essential, 1)
        at = min(essential, STEP) if full else len(turn)
        partial = weight[turn[:at]] @ postings[turn[:at]]
        work += at * len(ids)
        live = None
        while True:
            if full:
                keep = np.flatnonzero(partial + left[at] >= least)
                live, partial = (keep if live is None else live[keep]), partial[keep]
            if at == len(turn) or not len(partial):
                break
            to = min(at + STEP, len(turn))
            partial = partial + weight[turn[at:to]] @ (postings[turn[at:to]] if live is None else postings[np.ix_(turn[at:to], live)])
            work += (to - at) * len(partial)
            at = to
        found = ids if live is None else ids[live]
        other = found != query_ids[q]
        scores, held = np.concatenate([scores, partial[other]]), np.concatenate([held, found[other]])
        if len(scores) > 4 * k:  # ties at the k-th place stay in
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, held = scores[scores >= cut], held[scores >= cut]
        first = np.lexsort((held, -scores))[:k]
        best[q] = scores[first], held[first]
    return work


def _task(k: int):
    """The k best rows of a shard for each query of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, asked = left.combine_chunks(), right.combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ids = np.zeros(0, np.int64)
        if rows.num_rows and asked.num_rows:
            lists = [t.column("x").combine_chunks() for t in (rows, asked)]
            width = max(1, *(pc.max(x.value_lengths()).as_py() for x in lists))
            v, q = exact(*(integers(x, width) for x in lists))
            ids = asked.column("vec_id").to_numpy()
            found = [(np.zeros(0, v.dtype), np.zeros(0, np.int64)) for _ in ids]
            for at, to in pairwise([0, *range(min(STEP_ROWS, len(v)), len(v), SHARD // 4), len(v)]):  # the first few set the scores to beat
                search_shard(v[at:to], rows.column("vec_id").to_numpy()[at:to], q, ids, k, found)
        held = pa.array([i for _, h in found for i in h.tolist()], pa.int64())
        scores = pa.array([Decimal(max(min(int(s), WIDE - 1), 1 - WIDE)) for x, _ in found for s in x.tolist()], pa.decimal128(38, 0))
        return pa.table({"query_id": pa.array(np.repeat(ids, [len(h) for _, h in found]), pa.int64()), "vec_id": held, "score": scores})

    return run


def top_k(table: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    usable = vectors(table)
    asked = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    many = usable.agg(F.count("*"), F.countDistinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id")))).first()
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(many, (SHARD, BLOCK), strict=True))
    # rows go to shards by their place in the scan, so rows that repeat an id do not meet
    place = F.monotonically_increasing_id()
    rows = usable.withColumn("shard", F.pmod(F.xxhash64(place), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = rows.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_task(k), "query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    long = F.greatest(F.least(F.col("score"), F.lit(LONG - 1).cast("decimal(38,0)")), F.lit(-LONG).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", long.alias("score"))


#: The same result in DuckDB.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
