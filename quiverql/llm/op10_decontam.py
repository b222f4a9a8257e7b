"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of words, twice as long as the items they are
held against) are TF-IDF vectors over the words of the benchmark. A randomised
SVD, whose products with the passage matrix are summed over the partitions of all
documents, gives a latent space; windows are projected and
compared by cosine with the items. Pairs above a low cosine are confirmed by
their longest common subsequence of words: nearly all of the item, or most of it
together with its answer (its last sentence), so that paraphrases count and
chance does not.

Weights and the latent space cannot lose a leak, because a bound on the windows is
exact: a window that can be confirmed has all but a few words of the item, so it
holds at least ``SHARED`` of the item's rarest words once those that may be
missing are added to their number. Windows of every document are held against
that bound; those that pass it for some item are projected, and an item for
which they pass it is a candidate whatever the cosine.

Document frequencies are counted, and the latent space is fitted, over all documents:
they are parsed once for a block of items, and the places of the block's words are
written for the passes of the fit. All blocks of items are searched for in one
pass over the documents; the items of a block share one fit. The window grid contains
every stretch as long as an item in full, whatever its place.

Defined results: a null or empty text has no windows; null, empty or word-less
items are not searched for; equal items are each reported; repeated rows give
repeated results; texts are searched whole; columns other than ``doc_id`` and
``text`` (``item_id`` and ``text`` of the benchmark) are ignored; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, document_texts, map_batches

#: Dimensions of the latent space, and passes over the documents that fit it.
DIMENSIONS, PASSES = 96, 2
#: Words of half a passage of the fit, passages that are summed together, terms of a row of partial sums.
HALF, PASSAGES, TERMS = 32, 1_024, 256
#: Items that share a latent space, documents that are looked at together, cells (documents x terms) of a block, windows that are compared together.
ITEMS, CHUNK, CELLS, WINDOWS = 1_024, 256, 8_000_000, 4_096
#: A word in more than this share of the documents carries no weight, unless an item has too few others.
COMMON, LEAST_TERMS = 0.1, 4
#: Cosine of a candidate; share of an item's words in common order: alone, or with as much of the answer.
COSINE, ALONE, WITH_ANSWER, ANSWER = 0.4, 0.8, 0.65, 0.8
#: Of an item's rarest words (as many as may be missing and this many more), a window of the exact candidates holds this many.
SHARED = 5
PUNCTUATION = ".,;:!?\"'()[]{}|%&$*#-"


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased and without punctuation around them, and where each text's begin."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat = pc.utf8_trim(lists.flatten(), characters=PUNCTUATION)
    begin = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    real = pc.greater(pc.binary_length(flat), 0)  # bare punctuation is no word
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return flat.filter(real), before[begin]


def words_of(text: str) -> list[str]:
    return split_words(pa.array([text], pa.string()))[0].to_pylist()


def answer_of(text: str) -> list[str]:
    """The words of the last sentence that has at least three, else the last eight words."""
    for part in reversed(text.replace("!", ".").replace("?", ".").split(".")):
        if len(w := words_of(part)) >= 3:
            return w
    return words_of(text)[-8:]


def common_length(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, one machine operation for each word of ``other``."""
    full = (1 << size) - 1
    row = full
    for x in other:
        if m := masks.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for k, i in enumerate(ids):
        out[i] |= 1 << k
    return dict(out)


class Items:
    """A block of benchmark items, and what is learnt for them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.terms = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.names = pa.array(list(self.terms), pa.string())
        self.seq = [[self.terms[w] for w in ws] for ws in words]
        self.answer = [[self.terms[w] for w in answer_of(t)] for _, t in rows]
        self.weight = np.zeros(len(self.terms))
        self.basis = np.zeros((len(self.terms), 0))

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Terms of all words of the texts (-1 for words that no item has), and where each text begins."""
        flat, begin = split_words(column)
        return pc.fill_null(pc.index_in(flat, value_set=self.names), -1).to_numpy(zero_copy_only=False), begin

    def weigh(self, df: np.ndarray, documents: int) -> None:
        idf = np.log((documents + 1) / (df + 0.5))
        keep = df <= COMMON * documents
        for seq in self.seq:  # an item of common words keeps its rarest
            if keep[seq].sum() < LEAST_TERMS:
                keep[sorted(set(seq), key=lambda t: (df[t], t))[:LEAST_TERMS]] = True
        self.weight = np.where(keep, np.maximum(idf, 0.05), 0.0)
        self.sign(df)

    def sign(self, df: np.ndarray) -> None:
        """The items that each term is a rare word of, and how many places of rare words a window of an item must have."""
        self.missing = [len(seq) - math.ceil(WITH_ANSWER * len(seq) - 1e-9) for seq in self.seq]
        self.least = np.array([min(SHARED, len(seq) - m) for seq, m in zip(self.seq, self.missing, strict=True)])
        rare = [sorted(seq, key=lambda t: (df[t], t))[: m + n] for seq, m, n in zip(self.seq, self.missing, self.least.tolist(), strict=True)]
        pairs = np.array(sorted({(t, k) for k, ts in enumerate(rare) for t in ts}))
        self.rare_in = pairs[:, 1]
        self.rare_at = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def matrix(self) -> np.ndarray:
        a = np.zeros((len(self.seq), len(self.terms)))
        for k, seq in enumerate(self.seq):
            np.add.at(a[k], seq, self.weight[seq])
        return a

    def prepare(self) -> None:
        """Vectors of the items, by length class; the window of a class is twice as long as its longest item."""
        self.table = (self.weight[:, None] * self.basis).astype(np.float32)
        latent = self.matrix() @ self.basis
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
        self.latent = latent
        sizes = [max(16, 1 << math.ceil(math.log2(len(s)))) for s in self.seq]
        self.width = 2 * np.array(sizes)
        self.classes = [(2 * n, np.flatnonzero(np.array(sizes) == n), latent[np.array(sizes) == n].astype(np.float32).T.copy()) for n in sorted(set(sizes))]
        self.masks = [masks_of(s) for s in self.seq]
        self.answer_masks = [masks_of(s) for s in self.answer]
        self.counts = [Counter(s) for s in self.seq]
        self.needed = [n - m for n, m in zip(map(len, self.seq), self.missing, strict=True)]

    def find(self, column: pa.Array) -> list[dict[int, tuple[float, float, int]]]:
        """For each text: items found (by place in the block), with cosine, common share and first word of the window.

        Only windows that hold enough of some item's rare words are projected:
        no other can be confirmed. They are compared with all items of their
        width, and those near enough are candidates beside the items whose rare
        words they hold.
        """
        ids, begin = self.ids_of(column)
        out: list[dict[int, tuple[float, float, int]]] = [{} for _ in range(len(column))]
        shared = self.sharing(ids, begin)
        for width, members, vectors in self.classes:
            of = np.isin(shared[0], members)
            if not of.any():
                continue
            item, spot = shared[0][of], np.stack([v[of] for v in shared[1:]], axis=1)
            spot, which = np.unique(spot, axis=0, return_inverse=True)
            place = np.zeros(len(self.seq), dtype=np.int64)
            place[members] = np.arange(len(members))
            for at in range(0, len(spot), WINDOWS):
                text, start, stop = spot[at : at + WINDOWS].T
                x = self.project(ids, start, stop)
                cos = x @ vectors
                near = cos >= COSINE
                mine = (which.ravel() >= at) & (which.ravel() < at + WINDOWS)
                near[which.ravel()[mine] - at, place[item[mine]]] = True
                for w, m in zip(*np.nonzero(near), strict=True):
                    k, t, a, b = int(members[m]), int(text[w]), int(start[w]), int(stop[w])
                    share = self.confirm(k, ids[a:b].tolist())
                    if share and (k not in out[t] or share > out[t][k][1]):
                        out[t][k] = (float(cos[w, m]), share, a - int(begin[t]))
        return out

    def project(self, ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Latent unit vectors of windows."""
        n = stop - start
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        rows = np.where((ids[where] >= 0)[:, None], self.table[ids[where]], np.float32(0))
        x = np.add.reduceat(rows, np.cumsum(n) - n, axis=0)
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]

    def sharing(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, text, start, stop) of all windows that hold enough of an item's rare words to be confirmed."""
        n = np.where(ids >= 0, self.rare_at[ids + 1] - self.rare_at[ids], 0)
        at = np.flatnonzero(n)
        n = n[at]
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        item = self.rare_in[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.rare_at[ids[at]], n)]
        key = np.sort(item * len(ids) + np.repeat(at, n))
        item, at = key // len(ids), key % len(ids)
        last = np.minimum(np.arange(len(key)) + self.least[item] - 1, len(key) - 1)
        text = np.searchsorted(begin, at, side="right") - 1
        close = (np.arange(len(key)) + self.least[item] - 1 == last) & (item[last] == item) & (text[last] == text) & (at[last] - at < self.width[item])
        item, text, first, last = item[close], text[close], at[close], at[last[close]]
        width = self.width[item]
        half, length = width // 2, begin[text + 1] - begin[text]
        most = np.maximum(-(-(length - width) // half), 0)  # of the grid in windows()
        low = np.maximum((last - begin[text] - width) // half + 1, 0)
        high = np.minimum((first - begin[text]) // half, most)
        parts = []
        for more in range(2):
            some = low + more <= high
            start = (begin[text] + (low + more) * half)[some]
            parts.append(np.stack([item[some], text[some], start, np.minimum(start + width[some], begin[text + 1][some])], axis=1))
        return tuple(np.unique(np.concatenate(parts), axis=0).T)

    def confirm(self, k: int, window: list[int]) -> float:
        """The common share of item ``k`` and a window if that makes it a leak, else 0."""
        size, own = len(self.seq[k]), self.counts[k]
        if sum(min(n, own[t]) for t, n in Counter(window).items() if t in own) < self.needed[k]:  # words in any order bound words in order
            return 0.0
        share = common_length(self.masks[k], size, window) / size
        if share >= ALONE:
            return share
        if share >= WITH_ANSWER and common_length(self.answer_masks[k], len(self.answer[k]), window) >= ANSWER * len(self.answer[k]):
            return share
        return 0.0


def windows(begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of windows at every half width; the last of a text reaches its end."""
    length = np.diff(begin)
    half = width // 2
    n = np.where(length > 0, np.maximum(-(-(length - width) // half), 0) + 1, 0)
    text = np.repeat(np.arange(len(length)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[text] + k * half
    return text, start, np.minimum(start + width, begin[text + 1])


def _parts(b: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _binary(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Rows of 32-bit integers as bytes; row k has ``values[begin[k]:begin[k + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((4 * begin).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all rows of ``_binary``, and where each row begins."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    begin = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset) // 4
    return np.frombuffer(data or b"", np.int32, begin[-1])[begin[0] :], begin - begin[0]


def _hits(docs: DataFrame, items: Items) -> DataFrame:
    """For each document the terms of its words, in order, and how many of them are in each stretch of ``HALF`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, CHUNK):
                ids, begin = items.ids_of(part.column(0))
                n = -(-np.diff(begin) // HALF)
                first = np.r_[0, np.cumsum(n)]
                start = np.repeat(begin[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * HALF
                before = np.r_[0, np.cumsum(ids >= 0)]
                yield pa.RecordBatch.from_arrays([_binary(ids[ids >= 0], before[begin]), _binary(np.diff(before[np.r_[start, len(ids)]]), first)], ["terms", "halves"])

    return map_batches(docs.select("text"), run, "terms binary, halves binary")


def _frequencies(hits: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents."""
    size = len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        rows = max(1, min(CHUNK, CELLS // size))
        for b in batches:
            n += b.num_rows
            for part in _parts(b, rows):
                term, begin = _flat(part.column(0))
                met = np.zeros((part.num_rows, size), dtype=bool)
                met[np.repeat(np.arange(part.num_rows), np.diff(begin)), term] = True
                df += met.sum(axis=0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, df[some]].astype(np.int64))], ["term", "n"])

    out, documents = np.zeros(size), 0
    for r in map_batches(hits.select("terms"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each benchmark word
        if r.term < 0:
            documents = r.n
        else:
            out[r.term] = r.n
    return out, documents


def _add(total: np.ndarray, table: np.ndarray, weight: np.ndarray, term: np.ndarray, halves: np.ndarray, first: np.ndarray) -> None:
    """Add A'A omega of the passages of some documents to ``total``; a passage is two halves side by side, or a short text's only one."""
    half = np.repeat(np.arange(len(halves)), halves)
    real = weight[term] > 0
    term, half = term[real], half[real]
    halves = np.bincount(half, minlength=len(halves))
    begin = np.r_[0, np.cumsum(halves)]
    last = np.zeros(len(halves), dtype=bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    only = np.zeros(len(halves), dtype=bool)
    only[first[:-1][np.diff(first) == 1]] = True
    left = np.flatnonzero(~last | only)
    for at in range(0, len(left), PASSAGES):
        one = left[at : at + PASSAGES]
        two = one[~only[one]] + 1
        low, high = one[0], max(one[-1], two[-1] if len(two) else 0) + 1
        n = halves[low:high]
        some = slice(begin[low], begin[high])
        if not n.any():
            continue
        sums = np.zeros((high - low, table.shape[1]))
        sums[n > 0] = np.add.reduceat(table[term[some]], (begin[low:high] - begin[low])[n > 0], axis=0)
        y, size = sums[one - low], n[one - low]
        y[~only[one]] += sums[two - low]
        size[~only[one]] += n[two - low]
        y /= np.maximum(size, 1)[:, None]  # long windows weigh no more than short ones
        sums[:] = 0
        sums[one - low] = y
        sums[two - low] += y[~only[one]]
        order = np.argsort(term[some], kind="stable")
        names, where = np.unique(term[some][order], return_index=True)
        total[names] += weight[names][:, None] * np.add.reduceat(sums[half[some][order] - low], where, axis=0)


def _product(hits: DataFrame, items: Items, omega: np.ndarray) -> np.ndarray:
    """A'A omega for the passages of all documents, summed over their partitions in order."""
    weight, shape = items.weight, omega.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        table = weight[:, None] * omega
        for b in batches:
            for part in _parts(b, CHUNK):
                _add(total, table, weight, _flat(part.column(0))[0], *_flat(part.column(1)))
        at = [k for k in range(0, len(total), TERMS) if total[k : k + TERMS].any()]
        task = pa.array([TaskContext.get().partitionId()] * len(at), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), task, pa.array([total[k : k + TERMS].tobytes() for k in at], pa.binary())], ["at", "task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["at", "part"])

    total = np.zeros(shape)
    parts = map_batches(hits, run, "at int, task int, part binary").repartition("at").sortWithinPartitions("at", "task")
    for r in map_batches(parts, add, "at int, part binary").collect():  # terms x dimensions numbers, whatever the partitions
        total[r.at : r.at + TERMS] = np.frombuffer(r.part).reshape(-1, shape[1])
    return total


def _fit(docs: DataFrame, items: Items) -> None:
    hits = Written(_hits(docs, items))
    items.weigh(*_frequencies(hits.df, items))
    own = items.matrix()
    own /= np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    q = np.random.default_rng(10).normal(size=(len(items.terms), min(DIMENSIONS, len(items.terms))))
    for _ in range(PASSES):
        y = _product(hits.df, items, q)
        y = y / max(np.linalg.norm(y), 1e-12) + (z := own.T @ (own @ q)) / max(np.linalg.norm(z), 1e-12)  # items weigh as much as the documents
        q = np.linalg.qr(y)[0]
    hits.drop()
    items.basis = q
    items.prepare()


def detectors(docs: DataFrame, benchmark: DataFrame) -> list[Items]:
    """Fitted blocks of items; each has about ITEMS of them."""
    docs = document_texts(docs)
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = -(-rows.count() // ITEMS)
    out = []
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = [(r.item_id, r.text) for r in sorted(part) if words_of(r.text)]
        if found:
            items = Items(found)
            _fit(docs, items)
            out.append(items)
    return out


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common share and first word of the best window, for every item found in a document."""
    slim = document_texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(detectors(docs, benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, CHUNK):
                for items in shared.value:
                    rows = [(r, items.ids[k], *v) for r, hits in enumerate(items.find(part.column(1))) for k, v in sorted(hits.items())]
                    doc = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3)), pa.array([r[4] for r in rows], pa.int64())],
                        ["doc_id", "item_id", "cosine", "common", "first_word"],
                    )

    return map_batches(slim, run, "doc_id long, item_id long, cosine double, common double, first_word long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found; other rows and all columns stay."""
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(detectors(docs, benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, CHUNK):
                leaks = np.zeros(part.num_rows, dtype=bool)
                for items in shared.value:
                    leaks |= np.array([bool(hits) for hits in items.find(part.column(place))], dtype=bool)
                yield part.filter(pa.array(~leaks))

    return map_batches(docs, run, docs.schema)
