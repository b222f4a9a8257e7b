import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quiverql.llm import op8_repeats
from quiverql.llm.op8_repeats import CHUNK, LENGTH, SEED, Rolling, digests, parse, remove_repeats, repeated_suffixes, spans_of, without

from .conftest import ODD_ROWS


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + LENGTH] for _, b in raw for p in range(len(b) - LENGTH + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - LENGTH + 1):
            if seen[b[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(i), len(b), len(b) - len(kept), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def say(rng, n):
    return " ".join(rng.choice(["the", "onda", "mié", "thenre", "er", "quou"]) + rng.choice("abcdefgh") for _ in range(n))


def test_against_brute_force(docs_of):
    rng = random.Random(8)
    shared = [say(rng, 120) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [say(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) - 150)
            parts += [s[a : a + rng.choice([150, 199, 200, 201, 230, 400, 900])], say(rng, rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(200, "ab" * 300), (201, "x" * 199), (202, "y" * 200), (203, "z" * 201), (204, shared[0][:200]), (205, "x" * 199)]
    near = rows[7][1] + shared[1]
    for i in range(12):
        k = rng.randrange(len(near))
        rows.append((300 + i, near[:k] + "#" + near[k + 1 :]))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs_of(rows).repartition(3)).collect())
    assert got == brute(rows)


def test_every_string_has_one_anchor():
    rng = np.random.default_rng(8)
    for data in (rng.integers(0, 4, 5000).astype(np.uint8), np.zeros(900, np.uint8), np.tile(np.arange(7, dtype=np.uint8), 200)):
        begin = np.array([0, 300, 450, len(data)])
        text, place, first, last = parse(Rolling(data), begin)
        strings = sorted(p for a, b in zip(first, last, strict=True) for p in range(a, b + 1))
        assert strings == [p for i in range(3) for p in range(begin[i], begin[i + 1] - LENGTH + 1)]
        assert all(a <= t <= a + LENGTH - SEED and b <= t for t, a, b in zip(place, first, last, strict=True) if a == b) and (place >= last).all()


def test_suffixes_against_counts():
    rng = np.random.default_rng(9)
    data = np.concatenate([x := rng.integers(97, 100, 700).astype(np.uint8), x[100:450], rng.integers(0, 2, 300).astype(np.uint8), np.zeros(450, np.uint8)])
    begin = np.arange(len(data) - LENGTH + 1)
    seen = Counter(data[p : p + LENGTH].tobytes() for p in begin)
    assert repeated_suffixes(data, begin).tolist() == [seen[data[p : p + LENGTH].tobytes()] > 1 for p in begin]


def test_judge_across_batches():
    """Batches of any size say the same of a partition, but for rows that are marked twice."""
    rng = np.random.default_rng(3)
    rows = sorted((int(s), int(p)) for s, p in zip(rng.integers(0, 25, 400), rng.integers(0, 1000, 400) ** 2 // 60000, strict=True))
    seed, phrase = np.array(rows).T
    n = np.arange(400)
    whole = pa.RecordBatch.from_arrays([pa.array(seed), pa.array(phrase), pa.array(n), pa.array(n), pa.array(n), pa.array(n)], ["seed", "phrase", "doc_id", "th", "first", "last"])
    count, kinds, last = Counter(rows), Counter(s for s, _ in set(rows)), rows[-1][0]
    for most in (3, 20_000):
        op8_repeats.MOST = most
        for size in (1, 2, 7, 60, 400):
            said = Counter()
            for b in op8_repeats.judge(iter([whole.slice(at, size) for at in range(0, 400, size)])):
                for r in b.to_pylist():
                    said[r["doc_id"]] |= r["mark"]
            for i, (s, p) in enumerate(rows):
                alone = i == rows.index((s, p))
                apart = s in (rows[0][0], last) or kinds[s] > most
                assert said[i] == (count[s, p] > 1) + (alone and (4 if apart else 2 if kinds[s] > 1 else 0)), (most, size, i)
    op8_repeats.MOST = 20_000


def test_spans():
    assert spans_of(np.array([500, 0, 10, 200, 9]), np.array([500, 3, 12, 210, 9])) == [(0, 410), (500, 700)]
    assert spans_of(np.zeros(0, int), np.zeros(0, int)) == [] and without(b"abcdef", [(0, 2), (4, 6)]) == b"cd" and without(b"", []) == b""


@pytest.mark.parametrize("most", [2, 300, 20_000])
def test_seeds_of_many_phrases(docs_of, monkeypatch, most):
    monkeypatch.setattr(op8_repeats, "MOST", most)
    rng = random.Random(5)
    shared = say(rng, 120)
    rows = [(i, say(rng, 2) + shared[rng.randint(0, 200) :][: rng.choice([180, 210, 330])] + say(rng, 2)) for i in range(250)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs_of(rows).repartition(4)).collect())
    assert got == brute(rows)


def test_long_texts_and_many_copies(docs_of):
    rng = random.Random(9)
    shared, long = say(rng, 300), say(rng, 60_000)
    assert len(long.encode()) > 2 * CHUNK
    rows = [(0, long), (1, shared + long[CHUNK - 400 : CHUNK + 900] + say(rng, 50)), (2, long[: CHUNK // 2][-700:]), (3, long[-300:])]
    rows += [(4, shared)] * 700 + [(5 + i, say(rng, 3) + shared[:400] + say(rng, 3)) for i in range(1200)]  # a seed of many phrases, a row of many copies
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs_of(rows).repartition(4)).collect())
    assert got == brute(rows)


def test_odd_rows(odd_docs, docs_of):
    rows = ODD_ROWS
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(docs_of(rows)).collect())
    assert got == brute(rows)
    assert remove_repeats(odd_docs).count() == odd_docs.count() and digests(docs_of([])).count() == 0
