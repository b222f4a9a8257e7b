import random

import numpy as np
import pyarrow as pa
import pytest

from quiverql.llm.op10_decontam import DIMENSIONS, PASSES, Items, clean, common_length, detectors, masks_of, search, windows, words_of

rng = random.Random(10)
WORD = lambda: "".join(rng.choice(["ta", "lo", "mi", "er", "un", "sé"]) for _ in range(rng.randint(1, 4)))
VOCABULARY = sorted({WORD() for _ in range(900)})


def say(n):
    return " ".join(rng.choice(VOCABULARY[:40] if rng.random() < 0.4 else VOCABULARY) for _ in range(n)) + "."


ITEMS = [(i, say(rng.randint(15, 60))) for i in range(25)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.fixture(scope="module")
def corpus():
    rows, planted = [], set()
    for i in range(300):
        text = say(rng.choice([5, 80, 400]))
        if i % 3 == 0:
            k, item = rng.choice(ITEMS)
            words = item.upper().split()
            if i % 2:
                for _ in range(len(words) // 10):  # a paraphrase: some words changed, some put in
                    words[rng.randrange(len(words) - 8)] = WORD()
                    words.insert(rng.randrange(len(words) - 8), WORD())
            at = rng.randint(0, len(text.split()))
            text = " ".join([*text.split()[:at], *words, *text.split()[at:]])
            planted.add((i, k))
        rows.append((i, text))
    return rows, planted


def test_recall_and_precision(spark, docs_of, corpus):
    rows, planted = corpus
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in search(docs_of(rows), bench).collect()}
    assert got == planted
    kept = clean(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in planted}


def test_item_in_a_third_of_the_rows(spark, docs_of):
    """A hot item loses its weight, and rare words of other items lie beside it."""
    rare = [f"rare{i}" for i in range(2000)]
    plain = [f"plain{i}" for i in range(60)]
    hot = [f"hot{i}" for i in range(20)] + plain[:10]
    bench = spark.createDataFrame([(0, " ".join(hot))] + [(i, " ".join(rare[i * 20 - 20 : i * 20])) for i in range(1, 101)], "item_id long, text string")
    some = random.Random(3)
    rows = []
    for i in range(300):
        words = [some.choice(plain if some.random() < 0.3 else rare) for _ in range(120)]
        if i % 3 == 0:
            at = some.randint(0, 120)
            words[at:at] = hot
        rows.append((i, " ".join(words)))
    got = {(r.doc_id, r.item_id) for r in search(docs_of(rows), bench).collect()}
    assert got == {(i, 0) for i in range(0, 300, 3)}
    assert {r.doc_id for r in clean(docs_of(rows), bench).collect()} == {i for i in range(300) if i % 3}


def test_exact_candidates_contain_every_confirmed_window():
    some = random.Random(5)
    for _ in range(20):
        words = [f"w{i}" for i in range(40)]
        items = Items([(i, " ".join(some.choice(words) for _ in range(some.choice([1, 3, 12, 20, 40])))) for i in range(12)])
        items.weigh(np.array([some.randint(0, 50) for _ in items.terms], dtype=float), 50)
        items.basis = np.eye(len(items.terms))
        items.prepare()
        texts = ["", *(" ".join(some.choice([*words, "x"]) for _ in range(some.randint(0, 200))) for _ in range(6))]
        texts += [" ".join([*some.choices(words, k=30), *t.split()[some.randint(0, 3) :], *some.choices(words, k=50)]) for _, t in [(0, " ".join(list(items.terms)[t] for t in s)) for s in items.seq]]
        ids, begin = items.ids_of(pa.array(texts))
        near = set(zip(*(v.tolist() for v in items.sharing(ids, begin)), strict=True))
        for width, members, _ in items.classes:
            for t, a, b in zip(*(v.tolist() for v in windows(begin, width)), strict=True):
                for k in members.tolist():
                    n = common_length(items.masks[k], len(items.seq[k]), ids[a:b].tolist()) / len(items.seq[k])
                    assert n < 0.65 or (k, t, a, b) in near


def test_search_is_brute_force_over_all_windows(spark, docs_of):
    """Recall and precision of the whole search against every window of every text and every item."""
    some = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    bench = [(i, " ".join(some.choice(words) for _ in range(some.choice([2, 9, 20, 45]))) + ". " + " ".join(some.choice(words) for _ in range(5)) + ".") for i in range(20)]
    bench.append((20, " ".join(["again"] * 90 + [f"n{i}" for i in range(13)])))  # most of its places are one word
    rows = [(0, " ".join(["again"] * 90 + ["other"] * 13))]
    for i in range(1, 120):
        source = bench[some.randrange(20)][1].split()
        kept = [w for w in source if some.random() < some.choice([0.5, 0.75, 0.95])]
        text = [some.choice(words) for _ in range(some.choice([0, 10, 150]))]
        at = some.randint(0, len(text))
        rows.append((i, " ".join([*text[:at], *kept, *text[at:]])))
    items = Items(bench)
    items.weigh(np.zeros(len(items.terms)), 1)
    items.basis = np.eye(len(items.terms))
    items.prepare()
    ids, begin = items.ids_of(pa.array([t for _, t in rows]))
    want = {}
    for width, members, _ in items.classes:
        for t, a, b in zip(*(v.tolist() for v in windows(begin, width)), strict=True):
            for k in members.tolist():
                share = lcs(items.seq[k], ids[a:b].tolist()) / len(items.seq[k])
                answer = lcs(items.answer[k], ids[a:b].tolist()) / len(items.answer[k])
                if share >= 0.8 or (share >= 0.65 and answer >= 0.8):
                    want[rows[t][0], k] = max(share, want.get((rows[t][0], k), 0))
    got = search(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.common, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert (0, 20) in want and 50 < len(want) < 110


def fitted(rows, bench):
    """Items fitted in plain numpy on every passage of every row."""
    items = Items(bench)
    ids, begin = items.ids_of(pa.array([t for _, t in rows], pa.string()))
    spans = list(zip(begin, begin[1:]))
    items.weigh(np.array([sum(t in ids[a:b] for a, b in spans) for t in range(len(items.terms))], dtype=float), len(rows))
    passages = np.zeros((0, len(items.terms)))
    for _, a, b in zip(*windows(begin, 64), strict=True):
        n = np.bincount(ids[a:b][ids[a:b] >= 0], minlength=len(items.terms)) * (items.weight > 0)
        passages = np.vstack([passages, n * items.weight / max(n.sum(), 1) ** 0.5])
    own = items.matrix()
    own /= np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    q = np.random.default_rng(10).normal(size=(len(items.terms), min(DIMENSIONS, len(items.terms))))
    for _ in range(PASSES):
        y, z = passages.T @ (passages @ q), own.T @ (own @ q)
        q = np.linalg.qr(y / np.linalg.norm(y) + z / np.linalg.norm(z))[0]
    items.basis = q
    items.prepare()
    return items


def many_rows():
    """More rows than any sample had (3,000), of no word to several passages, and items of their words."""
    some = random.Random(21)
    words = [f"v{i}" for i in range(600)]
    rows = [(i, None if i == 5 else " ".join(some.choices([*words, "x", "y"], k=some.choice([0, 1, 6, 6, 6, 6, 32, 33, 65, 130])))) for i in range(3_400)]
    rows += [(None, " ".join(some.choices(words, k=40))), rows[9]]
    bench = [(i, " ".join(some.sample(words, 20))) for i in range(12)]
    return rows + [(4_000 + i, "y " * (31 + i) + t) for i, t in bench], bench


def test_fit_is_over_all_documents(spark, docs_of):
    """Latent space and cosines against a fit on every passage: no row is left out."""
    rows, bench = many_rows()
    want = fitted(rows, bench)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    (got,) = detectors(docs_of(rows), frame)
    assert np.allclose(got.weight, want.weight) and np.allclose(got.basis, want.basis, atol=1e-6)
    hits = {(r.doc_id, r.item_id): r.cosine for r in search(docs_of(rows), frame).collect()}
    plain = {(rows[t][0], want.ids[k]): v[0] for t, found in enumerate(want.find(pa.array([t for _, t in rows], pa.string()))) for k, v in found.items()}
    assert len(hits) == len(bench) and hits.keys() == plain.keys() and all(abs(hits[k] - plain[k]) < 1e-5 for k in hits)


def test_common_subsequence():
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert common_length(masks_of(a), len(a), b) == lcs(a, b)


def test_windows_contain_every_stretch():
    for n in (0, 1, 15, 16, 17, 32, 33, 100):
        _, start, stop = windows(np.array([0, n, n + 5]), 32)
        assert all(any(a <= x and x + min(16, n) <= b for a, b in zip(start, stop, strict=True)) for x in range(max(n - 15, 1) if n else 0))


def test_odd_rows(spark, odd_docs, docs_of):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "... !!"), (None, "word word"), (4, "one"), (5, "mixed case line two"), (5, "mixed case line two")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in search(odd_docs, bench).collect())
    assert got == [("10", 5), ("10", 5), ("4", 4), ("4", 4), ("5", 4)]
    assert search(docs_of([]), bench).count() == 0 and search(odd_docs, bench.where("item_id = 1")).count() == 0
    assert clean(odd_docs, bench.where("item_id = 1")).count() == odd_docs.count()
    assert isinstance(detectors(odd_docs, bench)[0], Items) and words_of("A, (b) -- c!") == ["a", "b", "c"]
