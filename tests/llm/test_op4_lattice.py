import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import quiverql.llm.op4_lattice as op4
from quiverql.llm.op4_lattice import Lattice, frequent, pieces_of, score, split_words, train, word_counts

from .conftest import ODD_ROWS

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(lattice, word):
    """(pieces, probability) of every way to spell a word, one by one."""
    weight = dict(zip(lattice.pieces, lattice.weights, strict=True))

    def ways(rest):
        if not rest:
            yield [], math.exp(lattice.stop)
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                for more, p in ways(rest[n:]):
                    yield [rest[:n], *more], math.exp(weight[rest[:n]]) * p

    return list(ways(b" " + word))


def toy():
    pieces = sorted([b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba"])
    lattice = Lattice(pieces, -np.arange(2.0, 2 + len(pieces)))
    rng = np.random.default_rng(4)
    lattice.normalise(rng.uniform(0.2, 1, len(pieces)), 2.5)
    return lattice


def test_pieces():
    pieces, scores = pieces_of(VOCABULARY)
    assert len(pieces) == len(set(pieces)) == len(scores) > 20_000 and scores.max() < 0 and np.isfinite(scores).all()
    assert {bytes([b]) for b in range(256) if b not in b"\t\n\x0b\x0c\r" and not 65 <= b <= 90} <= set(pieces)
    assert max(map(len, pieces)) > 12 and not any(b" " in p[1:] for p in pieces)


def test_lattice_against_enumeration():
    lattice = Lattice(*pieces_of(VOCABULARY))
    rng = np.random.default_rng(4)
    lattice.normalise(rng.dirichlet(np.ones(len(lattice.pieces))) + 1e-9, 0.3)
    words = [b"a", b"the", "été".encode(), b"information", b"x" * 9, b"zq\xf0\x9f\x98\x80", b"thereafter", b"\0", b"nul\0l"]
    all_ways = [segmentations(lattice, w) for w in words]
    assert np.allclose(lattice.spelling(pa.array(words)), [math.log(sum(p for _, p in ways)) for ways in all_ways])
    want = Counter()
    for ways in all_ways:
        for found, p in ways:
            for piece in found:
                want[piece] += p / sum(q for _, q in ways)
    assert np.allclose(lattice.uses(pa.array(words)), [want[p] for p in lattice.pieces])
    assert np.isfinite(lattice.spelling(pa.array([b"y" * 30000, b"i"], pa.binary()).slice(0, 1))).all() and len(lattice.spelling(pa.array([], pa.binary()))) == 0


def test_words_sum_to_one():
    lattice = toy()
    shares = []
    for n in (9, 13):
        words = [bytes(w) for k in range(1, n + 1) for w in itertools.product(b"ab", repeat=k)]
        shares.append(math.fsum(np.exp(lattice.spelling(pa.array(words)))))
    assert shares[0] < shares[1] < 1 and shares[1] > 0.98


def test_learning_raises_the_likelihood():
    lattice = Lattice(*pieces_of(VOCABULARY))
    words = pa.array([b"the", b"then", b"hexe", b"ononon", b"onenon"])
    seen = []
    for _ in range(4):
        seen.append(lattice.spelling(words).sum())
        lattice.learn(lattice.uses(words), len(words))
    assert seen == sorted(seen)


def test_words_are_split_as_said():
    texts = [None, "", " a\tB\n", "x\x1cy z", "Ünï\x0bcode É", "a  b\r\r"]
    flat, per = split_words(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert flat.to_pylist() == [w for ws in want for w in ws] and per.tolist() == [len(ws) for ws in want]


@pytest.mark.parametrize("most", [0, 20, 100_000])
def test_against_brute_force(spark, docs_of, monkeypatch, most):
    monkeypatch.setattr(op4, "FREQUENT", most)
    monkeypatch.setattr(op4, "HELD", 40)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2, 7]) for _ in range(rng.randint(0, 60))) + rng.choice(["", " Only%d" % i])) for i in range(120)]
    rows += [r for r in ODD_ROWS if r[0] not in (6, 8)]
    tok = lambda t: (t or "").encode().lower().split()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = Counter(w for i, t in rows if not out(i) for w in tok(t))
    ends = sum(not out(i) for i, _ in rows)
    c = words + Counter({b"\n": ends})
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(tok(t)) + 1, sum(c[w] > 0 for w in [*tok(t), b"\n"]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*tok(t), b"\n"]), 6)) for i, t in rows)
    got = score(docs_of(rows), VOCABULARY).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the score, from its definition
    lattice = train(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"), VOCABULARY)
    once, twice, total = sum(k == 1 for k in words.values()), sum(k == 2 for k in words.values()), n - ends
    d = min(max(once / (once + 2 * twice), 0.05), 0.95)
    spelled = {w: float(lattice.spelling(pa.array([w]))[0]) for w in {w for _, t in rows for w in tok(t)}}
    p = {w: (max(words[w] - d, 0) + (d * len(words) + 1) * math.exp(s)) / (total + 1) * (total + 0.5) / (n + 1) for w, s in spelled.items()}
    scores = sorted((str(i), len(tok(t)) + 1, sum(math.log10(p[w]) for w in tok(t)) + math.log10((ends + 0.5) / (n + 1))) for i, t in rows)
    assert np.allclose([x[2] for x in scores], [x[2] for x in sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)])


def test_held_out_rows_teach_nothing(docs_of):
    rows = [(i, f"some words of row {i} and w{i % 7}") for i in range(40)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    other = [(i, "quite another text, text text" if i in out else t) for i, t in rows]
    a, b = ({r.doc_id: r.score for r in score(docs_of(x), VOCABULARY).collect() if r.doc_id not in out} for x in (rows, other))
    assert out and a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-12) for i in a)


def test_frequent_words_are_bounded(docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(i, "a " * (i % 9) + f"w{i}") for i in range(100)]).select("doc_id", "text", F.lit(False).alias("held_out"))
    counts = word_counts(docs).withColumn("q", F.lit(-1.5))
    words, c, q = frequent(counts, 50)
    assert (words.to_pylist(), c.tolist(), q.tolist()) == ([b"a"], [sum(i % 9 for i in range(100))], [-1.5])
    assert len(frequent(counts, 0)[0]) == 0 and len(frequent(counts, 1000)[0]) == 101


def test_odd_rows_and_empty(odd_docs, docs_of):
    got = score(odd_docs, VOCABULARY).collect()
    assert len(got) == len(ODD_ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score(docs_of([]), VOCABULARY).count() == 0
    alone = score(docs_of([(i, "no training rows") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]), VOCABULARY).collect()
    assert alone and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)
