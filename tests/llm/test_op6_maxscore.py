import math
from fractions import Fraction

import numpy as np

from quiverql.llm import op6_maxscore
from quiverql.llm.op6_maxscore import search_shard, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, score string"


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        w = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).round(2).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(700, rows[4][1]), (900, None), (901, [1.0] * 15 + [None]), (902, [float("nan")] * 16), (None, rows[0][1]), (1000, [])]
    table = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, top_k(table, 100, 10).collect())) == brute(rows, 100, 10)
    assert top_k(table.where("false"), 100, 10).count() == 0 and top_k(table.where("vec_id = 1"), 100, 10).count() == 0
    few = table.where("vec_id in (100, 101, 102)")
    assert [(r.rank, r.vec_id) for r in top_k(few, 100, 10).orderBy("rank").collect()] == [x[1:3] for x in brute([r for r in rows if r[0] in (100, 101, 102)], 100, 10)]


def test_all_lengths_and_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=rng.integers(0, 9)).tolist()) for i in range(400)]
    rows += [(500 + i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 14)).tolist()) for i in range(60)]
    rows += [(600, [3e12, 1.0]), (601, [1.0]), (602, [-3e12, 5.0]), (603, [2.0**70]), (604, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, 100, 7)]
    assert sorted(map(tuple, top_k(table, 100, 7).collect())) == want and {602, 603} <= {x[2] for x in want}
    huge = spark.createDataFrame([(0, [1e200]), (1, [1.5e308]), (2, [-1e300]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(huge, 100, 7).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op6_maxscore, "SHARD", 40)
    monkeypatch.setattr(op6_maxscore, "BLOCK", 3)
    monkeypatch.setattr(op6_maxscore, "STEP_ROWS", 16)
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-2, 3, 6).tolist()) for i in rng.integers(0, 300, 500)]
    rows += [(10, rows[0][1])] * 200  # one id, and one vector, with very many rows
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, top_k(table, 10, 5).collect())) == brute(rows, 10, 5)


def test_terms_are_left_out():
    rng = np.random.default_rng(7)
    scale = np.r_[np.full(4, 1000), np.full(60, 5)]
    rows = np.rint(rng.normal(size=(20000, 64)) * scale)
    queries, ids = rows[:5], np.arange(20000)
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
    work = sum(search_shard(rows[a : a + 4000], ids[a : a + 4000], queries, ids[:5], 10, best) for a in range(0, 20000, 4000))
    for q in range(5):
        scores = rows @ queries[q]
        scores[q] = -np.inf
        assert best[q][1].tolist() == np.lexsort((ids, -scores))[:10].tolist()
    assert work < 0.5 * 5 * rows.size
