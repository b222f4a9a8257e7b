import zlib
from collections import Counter

import pytest

from quiverql.llm.op7_sharding import CELL_BITS, assign, capacities, digests, place, ring


def walk(cells, shards, slack=0.0):
    """One row at a time, in the same turns as ``place``: where each cell's rows end up."""
    points, room = ring(shards), capacities(len(cells), shards, slack)
    queue = []
    for c in sorted(cells):
        queue.append((next((k for k, p in enumerate(points) if p[0] >= c), 0), c))
    out = Counter()
    while queue:
        rest = []
        for k in range(len(points)):
            for at, c in queue:
                if at == k:
                    s = points[k][1]
                    if room[s]:
                        room[s] -= 1
                        out[c, s] += 1
                    else:
                        rest.append(((k + 1) % len(points), c))
        queue = rest
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_place_against_single_rows(slack):
    cells = [(i * 7919 * 31) % 2**CELL_BITS for i in range(150)] + [17] * 40
    got = Counter()
    for cell, begins, ends, shard, _ in place(dict(Counter(cells)), 5, slack):
        got[cell, shard] += ends - begins
    assert got == walk(cells, 5, slack)


def test_points_stay_when_a_shard_is_added():
    small, large = dict(ring(5)), dict(ring(6))
    assert len(small) == 5 * 64 and sum(large.get(c) == s for c, s in small.items()) >= len(small) - 2


def test_rows(docs_of, odd_docs):
    rows = [(i, "t" * (i % 50)) for i in range(997)] + [(7, "same")] * 500 + [(8, None)]
    got = digests(docs_of(rows), 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = Counter(r["shard"] for r in got)
    assert set(by) == set(range(40)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in got if r["shard"] == s) == list(range(n)) for s, n in by.items())
    odd = digests(odd_docs, 4).collect()
    assert len(odd) == odd_docs.count() and digests(docs_of([]), 4).count() == 0
    assert all(r.law == "rows" and r.grown_shard is None for r in odd)


def test_slack_moves_less(docs_of):
    docs = docs_of([(i, "") for i in range(3000)])
    move = {}
    for slack in (0.0, 0.5):
        a, b = ({r.doc_id: r["shard"] for r in assign(docs, n, slack).collect()} for n in (8, 9))
        move[slack] = sum(a[i] != b[i] for i in a)
    assert move[0.5] < 3000 * 0.4
