import itertools
import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from quiverql.llm.common import connected_components
from quiverql.llm.op1_simhash import components, cosets, digests, fingerprint, homes, links, one_of_each, reach, similar
from quiverql.llm.op3_lines import dedup_lines

from .conftest import ODD_ROWS


def slow_fingerprint(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_covering():
    at = cosets()[1]
    assert ((at[:, 1] - at[:, 0]) == 1).all()  # one pattern of up to 3 bits in each coset: the code is perfect
    rng = random.Random(0)
    for _ in range(300):
        f = rng.getrandbits(64)
        g = f
        for b in rng.sample(range(64), rng.randint(0, 2)):
            g ^= 1 << b
        anchors, _ = reach(np.array([g], dtype=np.uint64))
        assert homes(np.array([f], dtype=np.uint64))[0] in anchors and len(set(anchors)) == len(anchors)


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(rng.choice(["The", "ÉTÉ", "a", "Zz"]) for _ in range(n)) + " \t\n"
        assert fingerprint(t) == slow_fingerprint(t)


def test_links_and_components(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        for b in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << b
        fps.add(f)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = [(r.u, r.v) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_against_brute_force(docs_of, odd_docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)) for _ in range(6)]
    texts = [*base]
    for t in base:
        for _ in range(8):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["X", "yy", "zz"])
            texts.append(" ".join(w))
    texts += ["", None, "  \n", base[0].upper(), base[1].replace(" ", "\n")]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    fp = {i: slow_fingerprint(t) for i, t in rows}
    want = roots(list(fp), [(a, b) for a in fp for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in digests(docs_of(rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == want and len(set(want.values())) < len(want)
    odd = components(odd_docs).collect()
    assert len(odd) == len(ODD_ROWS) and {r.component_id for r in odd if r.fp == 0} == {1}
    assert digests(docs_of([])).count() == 0
    kept = one_of_each(docs_of(rows), components(docs_of(rows)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs_of(rows).columns
    assert one_of_each(odd_docs, components(odd_docs)).count() == len({r.root for r in odd})
    three = docs_of([(None, "a b"), (None, "c d"), (None, "a b")])
    assert one_of_each(three, components(three)).count() == one_of_each(three, similar(three)).count() == 2


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_texts(docs_of, odd_docs):
    """Groups against brute force over all pairs: near copies meet, other texts do not."""
    rng = random.Random(12)
    say = lambda n: [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n)]
    rows = []
    for g in range(40):
        base = say(rng.choice([60, 200, 900]))
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 6):
            w = list(base)
            for _ in range(round(len(w) * k * 0.004)):  # up to a tenth of the shingles, and more
                w[rng.randrange(len(w))] = "new"
            rows.append((g * 10 + k, " ".join(w).upper() if k == 5 else " ".join(w)))
    rows += [(1000 + i, " ".join(say(80))) for i in range(200)]
    text, root = dict(rows), {r.doc_id: r.root for r in similar(docs_of(rows)).collect()}
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if i // 10 == j // 10 and i < 1000 and jaccard(a, b) >= 0.8]
    recall = lambda least: (found := [root[i] == root[j] for i, j in near if jaccard(text[i], text[j]) >= least]) and sum(found) / len(found)
    assert len(near) > 250 and recall(0.8) >= 0.9 and recall(0.85) >= 0.97, (recall(0.8), recall(0.85))
    assert len({root[i] for i, _ in rows if i >= 1000}) == 200 and len({root[i] for i, _ in rows if i < 1000}) >= 40
    assert all(root[i] != root[j] for (i, a), (j, b) in itertools.combinations(rows, 2) if i // 10 != j // 10)
    odd = similar(odd_docs).collect()
    assert len(odd) == len(ODD_ROWS) and len({r.root for r in odd if r.doc_id in (1, 2, 3)}) == 1 and similar(docs_of([])).count() == 0


def test_anchors_that_span_partitions(docs_of, monkeypatch):
    """A group of many near copies shares anchors across partitions and batches and stays one group."""
    rng = random.Random(13)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(400)]
    rows = []
    for i in range(3000):
        w = list(base)
        w[rng.randrange(400)] = f"n{i}"
        rows.append((i, " ".join(w)))
    groups = similar(docs_of(rows).repartition(4))
    assert len({r.root for r in groups.collect()}) == 1


def test_columns_of_any_name(docs_of):
    odd = docs_of([(1, "a b c"), (2, "a b c"), (3, "d e f")])
    for name in ("_n", "_k", "_t", "x", "row", "root", "a.b", "node", "th"):
        docs = odd.withColumn(name, F.lit(7))
        kept = one_of_each(docs, similar(docs))
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
        lines = dedup_lines(docs, 2)
        assert lines.columns == docs.columns and sorted((r.doc_id, r.text) for r in lines.collect()) == [(1, ""), (2, ""), (3, "d e f")]
