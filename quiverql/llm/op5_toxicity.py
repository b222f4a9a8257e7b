"""Toxicity by weak supervision.

Many voters look at a text: words of fixed lexicons in four languages, shapes of
the text, and word beginnings that the corpus itself suggests without any label.
The last come from a regularity: a word that is put into a text where a sentence
should begin stands there in lower case. Beginnings of words that open sentences
mostly in lower case, in a share of all documents, are voters, at several
strengths (the share of a text's different words that have one).

A generative label model is fitted to their votes by expectation maximisation:
a class, for each voter how often it fires under either class, and correlations,
as a tree of voters in which each voter's rate also depends on its parent's
vote, chosen by what the class leaves unexplained. A row's given label is one
more voter, from which the fit starts and whose accuracy is estimated like the
others'; without labels it starts from the votes alone. A linear classifier is then trained on the posterior labels, and
scores every text.

Word beginnings are counted over all documents. The fit uses a bounded sample of
labelled rows (``LABELLED``, those with the smallest hashes of their id); what
leaves the executors are beginnings with their counts, and one line of votes for
each row of the sample. Scoring is one narrow pass over whole texts.

Defined results: a null or empty text gets the score of a text in which no
voter fires; labels that are null or disagree for an id are not used; without
labels the votes alone decide, without any row that has a label the lexicons'
prior weights; a null id is not held out; repeated rows give repeated results;
columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, document_texts, map_batches, slices, texts

#: Most labelled rows that the fit looks at.
LABELLED = 20_000
#: Word beginnings: lengths, least documents (and share of all documents) in which one opens a sentence in lower case, least share of its openings that do, and which share of a text's different words makes each of its voters fire.
LENGTHS, SUPPORT, SHARE, LOWERED, STRENGTHS = range(4, 11), 4, 1e-4, 0.6, (0, 1 / 200, 1 / 60)
#: A beginning goes on to a longer one that holds this share of its documents.
CLOSED = 0.8
#: Insults in English, German, French and Spanish, each a voter.
LEXICON = (
    "bastard", "clown", "crap", "creep", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumb", "filth", "fool", "garbage", "hate", "idiot", "imbecile",
    "jerk", "loser", "lunatic", "maggot", "moron", "parasite", "pathetic", "pig", "scum", "shut", "stupid", "subhuman", "trash", "ugly", "vermin", "worthless",
    "abschaum", "arschloch", "dreck", "dumm", "ekelhaft", "trottel", "versager", "wertlos",
    "abruti", "connard", "crétin", "dégueulasse", "imbécile", "minable", "ordure", "salaud",
    "asqueroso", "basura", "escoria", "estúpido", "idiota", "inútil", "patético", "tonto",
)
SHAPES = ("shouting", "exclaiming", "address", "lowered")
WORD = re.compile(r"[^\W\d_]+")
OPENING = re.compile(r"[.!?]\s+([^\W\d_]+)")
#: Weight, as log odds, of a lexicon voter before anything is learnt, and of every text.
PRIOR_WEIGHT, PRIOR_BIAS = 4.0, -3.0
#: What the fit first takes a row for, by whether a lexicon or a beginning votes; and the first accuracy of given labels.
FIRST, RIGHT = (0.05, 0.9), 0.9
#: Texts that are Python objects at a time.
TEXTS = 1_024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def openings(text: str) -> tuple[set[str], set[str]]:
    """Words that open a sentence in lower case, and otherwise (all as lower case)."""
    low, other = set(), set()
    for word in OPENING.findall(text):
        (low if word[0].islower() else other).add(word.lower())
    return low, other


@dataclass
class Voters:
    """Which voters fire on a text: lexicon words, shapes, then word beginnings at each strength."""

    stems: tuple[str, ...]
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.names = [*LEXICON, *SHAPES, *(f"{s}{k}" for s in self.stems for k in range(len(STRENGTHS)))]
        self.words = {w: i for i, w in enumerate(LEXICON)}
        self.starts = {s: i for i, s in enumerate(self.stems)}
        self.lengths = sorted({len(s) for s in self.stems})
        #: Voters that say something of toxicity before anything is learnt.
        self.telling = np.array([n not in SHAPES for n in self.names])

    def of_word(self, word: str) -> tuple[int, ...]:
        hit = self.seen.get(word)
        if hit is None:
            hit = tuple(i for n in self.lengths if len(word) >= n and (i := self.starts.get(word[:n])) is not None)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = hit
        return hit

    def votes(self, text: str) -> list[int]:
        low = text.lower()
        out: set[int] = set()
        begun: Counter = Counter()
        words = set(WORD.findall(low))
        for word in words:
            if word in self.words:
                out.add(self.words[word])
            if hit := self.of_word(word):
                begun.update(hit)
        base = len(LEXICON) + len(SHAPES)
        for stem, n in begun.items():
            out.update(base + stem * len(STRENGTHS) + k for k, least in enumerate(STRENGTHS) if n >= least * len(words))
        shapes = (text.isupper(), text.count("!") * 40 > len(text) > 0, "you are" in low or "you're" in low, bool(openings(text)[0]))
        out.update(len(LEXICON) + k for k, fires in enumerate(shapes) if fires)
        return sorted(out)


@dataclass
class LabelModel:
    """P(class), and for each voter P(fires | class, vote of its parent); a voter that is its own parent has none."""

    prior: float
    parent: np.ndarray
    fires: np.ndarray  # voters x class x parent's vote

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        above = votes[:, self.parent]
        root = self.parent == np.arange(len(self.parent))
        above = np.where(root, 0, above).astype(np.int64)
        p = [self.fires[np.arange(len(root)), y, above] for y in (0, 1)]
        each = np.where(votes > 0, np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])))
        return np.log(self.prior / (1 - self.prior)) + each.sum(axis=1)


def dependence(votes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mutual information of every two voters within the classes (rows weigh ``w``, a column for each class)."""
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for y in range(w.shape[1]):
        n = w[:, y].sum()
        if n < 1e-9:
            continue
        both = (votes * w[:, y : y + 1]).T @ votes / n
        one = np.diag(both)
        cells = ((both, one[:, None] * one), (one[:, None] - both, one[:, None] * (1 - one)), (one - both, (1 - one[:, None]) * one), (1 - one[:, None] - one + both, (1 - one[:, None]) * (1 - one)))
        for joint, apart in cells:
            ok = (joint > 1e-12) & (apart > 1e-12)
            total[ok] += n / len(votes) * joint[ok] * np.log(joint[ok] / apart[ok])
    np.fill_diagonal(total, 0)
    return total


def strongest_tree(weight: np.ndarray, least: float) -> np.ndarray:
    """Parents in a maximum spanning forest of the edges that weigh ``least`` or more; a root is its own parent."""
    m = len(weight)
    parent = np.arange(m)
    best, by, open_ = np.full(m, -1.0), np.arange(m), np.ones(m, dtype=bool)
    for _ in range(m):
        k = int(np.argmax(np.where(open_, best, -2)))
        open_[k] = False
        parent[k] = by[k] if best[k] >= least else k
        better = open_ & (weight[k] > best)
        best[better], by[better] = weight[k][better], k
    return parent


def fit_label_model(votes: np.ndarray, given: np.ndarray | None, telling: np.ndarray, rounds: int = 30) -> tuple[LabelModel, np.ndarray]:
    """EM over the voters and, if ``given`` is not None, given labels as one more voter. Returns the posterior too.

    The tree of correlations is chosen anew in every fifth round; its edges
    carry at least what two independent voters show by chance in as many rows.
    """
    n, m = votes.shape
    said = np.zeros(n)
    q = np.where(votes[:, telling].any(axis=1), FIRST[1], FIRST[0]) if given is None else np.where(given == 1, RIGHT, 1 - RIGHT)
    parent = np.arange(m)
    for k in range(rounds):
        prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        w = np.stack([1 - q, q], axis=1)
        if k % 5 == 0:
            parent = strongest_tree(dependence(votes, w), 6 / n)
        above = np.where(parent == np.arange(m), 0, votes[:, parent])
        fires = np.zeros((m, 2, 2))
        for y in (0, 1):
            # rates without a parent steady those with one, and a rate of the voters at large those
            rate = (votes.T @ w[:, y] + (0.5 if y else 0.01)) / (w[:, y].sum() + 1)
            for up in (0, 1):
                weight = w[:, y : y + 1] * (above == up)
                fires[:, y, up] = ((votes * weight).sum(axis=0) + 2 * rate) / (weight.sum(axis=0) + 2)
        model = LabelModel(prior, parent, np.clip(fires, 1e-5, 1 - 1e-5))
        if given is not None:  # how often labels are right under either class
            right = [np.clip(((given == y) * w[:, y]).sum() / max(w[:, y].sum(), 1e-9), 0.5, 0.999) for y in (0, 1)]
            said = np.where(given == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        q = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + said, -30, 30)))
    return model, q


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - q) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    linear: np.ndarray

    def features(self, votes: np.ndarray) -> np.ndarray:
        odds = np.clip(self.labels.log_odds(votes), -6, 6)
        return np.concatenate([votes, odds[:, None]], axis=1)

    def score(self, found: list[list[int]]) -> np.ndarray:
        """Scores from lists of the voters that fired."""
        x = np.concatenate([self.features(dense(found, len(self.voters.names))), np.ones((len(found), 1))], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.linear, -30, 30)))


def dense(found: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(found), width))
    for row, hit in enumerate(found):
        out[row, hit] = 1
    return out


def fixed_model() -> Model:
    voters = Voters(())
    m = len(voters.names)
    linear = np.zeros(m + 2)
    linear[: len(LEXICON)], linear[-1] = PRIOR_WEIGHT, PRIOR_BIAS
    return Model(voters, LabelModel(0.05, np.arange(m), np.full((m, 2, 2), 0.01)), linear)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    ids = ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where(F.col("toxic") == F.col("most"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", "toxic")
    return document_texts(docs).join(F.broadcast(ids), "doc_id")  # at most LABELLED rows


def _beginnings(docs: DataFrame) -> list[str]:
    """Word beginnings that open sentences mostly in lower case, from all documents."""

    def prefixes(words: set[str]) -> set[str]:
        return {w[:n] for w in words for n in LENGTHS if len(w) >= n}

    def counted(found, columns: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for b in slices(batches, TEXTS):
                for text in texts(b.column(1)):
                    n.update(found(text))
                if len(n) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["stem", "n"])
                    n.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["stem", "n"])

        return map_batches(docs, run, columns).groupBy("stem").agg(F.sum("n").alias("n"))

    least = max(SUPPORT, SHARE * docs.count())
    low = {r.stem: r.n for r in counted(lambda t: prefixes(openings(t)[0]), "stem string, n long").where(F.col("n") >= least).collect()}  # at most 1 / SHARE for each opening of a document
    if not low:
        return []
    high = {r.stem: r.n for r in counted(lambda t: prefixes(openings(t)[1]) & low.keys(), "stem string, n long").collect()}
    good = {s: n for s, n in low.items() if n >= LOWERED * (n + high.get(s, 0))}
    longest: Counter = Counter()
    for s, n in good.items():
        longest[s[:-1]] = max(longest[s[:-1]], n)
    closed = sorted((s for s, n in good.items() if longest[s] < CLOSED * n), key=lambda s: (len(s), s))
    out: set[str] = set()
    for s in closed:
        if not any(s[:n] in out for n in LENGTHS):
            out.add(s)
    return sorted(out)


def _votes(rows: DataFrame, voters: Voters) -> list[tuple[int, list[int]]]:
    """(label, voters that fire) of each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TEXTS):
            found = [voters.votes(t) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "votes"])

    return [(r.toxic, r.votes) for r in map_batches(rows.select("text", "toxic"), run, "toxic int, votes array<int>").collect()]


def fit(docs: DataFrame, labels: DataFrame, gold: bool = True) -> Model:
    """``gold=False`` leaves given labels out of the label model: they only choose the rows of the sample then."""
    voters = Voters(tuple(_beginnings(document_texts(docs))))
    sample = Written(_sample(docs, labels))
    try:
        rows = _votes(sample.df, voters)
    finally:
        sample.drop()
    if not rows:
        return fixed_model()
    x, given = dense([hit for _, hit in rows], len(voters.names)), np.array([y for y, _ in rows])
    labels_too = gold and {0, 1} <= set(given.tolist())
    model, q = fit_label_model(x, given if labels_too else None, voters.telling)
    out = Model(voters, model, np.zeros(0))
    out.linear = fit_linear(out.features(x), q)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, TEXTS):
            s = model.score([model.voters.votes(t) for t in texts(part.column(1))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    return map_batches(document_texts(docs), run, "doc_id long, score double")


def below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, TEXTS):
            yield part.filter(pa.array(model.score([model.voters.votes(t) for t in texts(part.column(text))]) < threshold))

    return map_batches(docs, run, docs.schema)


def digests(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
