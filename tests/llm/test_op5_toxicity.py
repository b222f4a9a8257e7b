import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quiverql.llm.common import document_texts
from quiverql.llm.op5_toxicity import LEXICON, LabelModel, _beginnings, below, dependence, digests, fit, fit_label_model, openings, strongest_tree


@pytest.fixture(scope="module")
def corpus():
    """Sentences of invented words; toxic texts hold lexicon words and words of two invented beginnings, put anywhere."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "er", "un"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        w = []
        for _ in range(10):
            sentence = [word() for _ in range(6)]
            w += [sentence[0].capitalize(), *sentence[1:5], sentence[5] + "."]
        toxic = int(rng.random() < 0.2)
        if toxic:
            kind = rng.randrange(3)
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), [rng.choice(["idiot", "moron"]), "grobx" + word(), "fuzq" + word()][kind])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic if rng.random() > 0.02 else 1 - toxic))
    return rows, labels


def test_held_out_accuracy(spark, docs_of, corpus):
    rows, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in digests(docs_of(rows), table).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    out = [(got[i].predicted, truth[i]) for i in truth if got[i].held_out]
    assert sum(p == t for p, t in out) / len(out) > 0.95
    assert sum(p for p, t in out if t) / sum(t for _, t in out) > 0.85


def test_voters_are_found_without_labels(spark, docs_of, corpus):
    rows, labels = corpus
    assert {"grobx", "fuzq"} <= set(_beginnings(document_texts(docs_of(rows))))
    a, b = (fit(docs_of(rows), spark.createDataFrame([(i, q, t ^ flip) for i, q, t in labels], "doc_id long, quality int, toxic int")) for flip in (0, 1))
    assert a.voters.stems == b.voters.stems


def test_held_out_labels_are_not_used(spark, docs_of, corpus):
    rows, labels = corpus
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (fit(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a.voters.stems == b.voters.stems and np.allclose(a.linear, b.linear)


def test_label_model_against_enumeration():
    """Votes of a tree sum to one under either class, and the odds are those of the joint probabilities."""
    rng = np.random.default_rng(1)
    model = LabelModel(0.3, np.array([0, 0, 1, 3, 3]), rng.uniform(0.05, 0.95, (5, 2, 2)))
    votes = np.array(list(itertools.product([0, 1], repeat=5)), dtype=float)
    joint = np.ones((len(votes), 2))
    for k, row in enumerate(votes.astype(int)):
        for y in (0, 1):
            for i, p in enumerate(model.parent):
                rate = model.fires[i, y, 0 if p == i else row[p]]
                joint[k, y] *= rate if row[i] else 1 - rate
    assert np.allclose(joint.sum(axis=0), 1)
    assert np.allclose(model.log_odds(votes), np.log(joint[:, 1] / joint[:, 0]) + math.log(0.3 / 0.7))


def test_correlations_become_the_tree():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    fires = lambda: np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.05)
    one, other = fires(), fires()
    votes = np.stack([one, one, np.where(rng.random(3000) < 0.02, ~one, one), other], axis=1).astype(float)
    w = np.stack([~y, y], axis=1).astype(float)
    d = dependence(votes, w)
    for i, j in itertools.combinations(range(4), 2):  # mutual information from its definition
        want = 0.0
        for c in (0, 1):
            for a, b in itertools.product([0, 1], repeat=2):
                p = (w[:, c] * (votes[:, i] == a) * (votes[:, j] == b)).sum() / w[:, c].sum()
                q = (w[:, c] * (votes[:, i] == a)).sum() * (w[:, c] * (votes[:, j] == b)).sum() / w[:, c].sum() ** 2
                want += w[:, c].mean() * (p * math.log(p / q) if p else 0)
        assert math.isclose(d[i, j], want, abs_tol=1e-9)
    parent = strongest_tree(d, 6 / 3000)
    assert parent[3] == 3 and sum(p != k for k, p in enumerate(parent)) == 2
    model, q = fit_label_model(votes, y.astype(int), np.ones(4, dtype=bool))
    alone, _ = fit_label_model(votes[:, [0, 3]], y.astype(int), np.ones(2, dtype=bool))
    all_fire, pair = model.log_odds(np.ones((1, 4))), alone.log_odds(np.ones((1, 2)))
    assert abs(all_fire - pair)[0] < 1.0 and ((q > 0.5) == y).mean() > 0.95  # copies of a voter add nearly nothing
    tree = strongest_tree(np.array([[0, 5, 1], [5, 0, 2], [1, 2, 0.0]]), 1.5)
    assert sorted((min(k, p), max(k, p)) for k, p in enumerate(tree.tolist()) if k != p) == [(0, 1), (1, 2)]


def test_openings():
    assert openings("One two. three Four! Fünf. élan? x") == ({"three", "élan", "x"}, {"fünf"}) and openings("") == (set(), set())


def test_odd_rows(spark, odd_docs, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert digests(odd_docs, none).count() == odd_docs.count()
    odd = spark.createDataFrame([(1, None, None), (4, 1, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit(odd_docs, odd)
    assert [r.doc_id for r in below(docs_of([(1, f"you {LEXICON[0]}"), (2, None)]).withColumnRenamed("u", "_toxicity"), model, 0.7).collect()] == [2]
    assert digests(docs_of([]), odd).count() == 0
    one_class = spark.createDataFrame([(5, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in digests(odd_docs, one_class).collect())
