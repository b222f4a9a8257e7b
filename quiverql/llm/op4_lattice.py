"""Language-model scores as likelihoods of a subword lattice.

A word is spelled by pieces of an existing vocabulary; its spelling probability
is the sum over all segmentations, a forward recursion in log space over its
lattice. The first piece holds the space before the word and is drawn from the
pieces that have one; others follow until the word stops. The vocabulary's
scores weight the pieces at first (by Zipf's law, as they are ranks), then
expectation maximisation over all distinct training words refines them.

Training words are pieces as a whole, too. Each keeps its count less a discount
D, and what the discount frees is shared by spelling, so that with c the count
of a word among N words of which V are distinct

    P(word) = (max(c - D, 0) + (D V + 1) spelling(word)) / (N + 1)

and the end of a text has the share of ends among all tokens. Spellings sum to
one over all words, hence words and end do; a text's score is the logarithm of a
probability over all texts. D comes from how many words occur once and twice.

Words are counted over the whole corpus. Their number grows with it, so counts
and probabilities stay in a distributed table, and the driver sees sums only.
They reach the documents in two ways: words of a bounded number that are
frequent anywhere are broadcast, all others go through a join on the word, whose
keys are rare by construction. A word's part of a score is the same either way.

Defined results: a null or empty text is the end alone; without training
documents all counts are zero and pieces keep their initial weights; a null id
is a training document; repeated rows are separate documents; words of any
length are scored whole; columns other than ``doc_id`` and ``text`` are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, document_texts, map_batches
from .trie import Trie, laid_out

#: Passes of expectation maximisation.
ROUNDS = 2
#: Most words that are broadcast, and distinct words that a task holds before it sends their counts on.
FREQUENT, HELD = 150_000, 300_000
#: Added to the expected count of single bytes and of other pieces.
FLOOR_BYTE, FLOOR_PIECE = 0.5, 1e-3
#: Bytes of one lattice block, and documents that are looked at together.
CELLS, CHUNK = 250_000, 512
WHITE = b" \t\n\x0b\x0c\r"
#: Frequent words with their counts and log probabilities.
Hot = tuple[pa.Array, np.ndarray, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece vocabulary and their scores.

    Left out is what a lower-cased word cannot hold: control pieces, capitals
    A-Z, white space but for one leading space. All single bytes are there.
    """
    from sentencepiece import SentencePieceProcessor

    vocabulary = SentencePieceProcessor(model_file=path)
    found = {bytes([b]): -math.inf for b in range(256)}
    for i in range(vocabulary.get_piece_size()):
        if vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i) or vocabulary.is_byte(i):
            continue
        piece = vocabulary.id_to_piece(i).replace("▁", " ").encode()
        found[piece] = max(found.get(piece, -math.inf), vocabulary.get_score(i))
    found.setdefault(b" ", -math.inf)
    good = {p: s for p, s in found.items() if p == b" " or p and p == p.lower() and not any(c in p[p[:1] == b" " :] for c in WHITE)}
    least = min((s for s in good.values() if s > -math.inf), default=-1.0)
    pieces = sorted(good)
    return pieces, np.array([max(good[p], least) for p in pieces])


class Block:
    """Words laid out one after the other, each with a space before and an end mark after it, and all pieces found in them."""

    def __init__(self, trie: Trie, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """``data``: bytes of the words; word i has ``length[i]`` of them from ``begin[i]``."""
        size = length + 2
        flat, self.head = laid_out(data, begin, length, lead=32)
        self.tail = self.head + length + 1
        place = np.flatnonzero(flat != Trie.END)
        node, n = np.zeros(len(place), dtype=np.int32), 0
        starts, stops, pieces = [], [], []
        while len(place):
            node = trie.step(node, flat[place + n])
            n += 1
            place, node = place[node >= 0], node[node >= 0]
            piece = trie.piece[node]
            some = piece >= 0
            starts.append(place[some])
            stops.append(place[some] + n)
            pieces.append(piece[some])
        self.size = len(flat)
        self.start, self.stop, self.piece = (np.concatenate(x) for x in (starts, stops, pieces))
        self.column = np.arange(self.size) - np.repeat(self.head, size)

    def _swept(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges by the column of the place ``at``: (edges, where a place's edges begin among them, those places)."""
        column = self.column[at]
        order = np.argsort(column * np.int64(self.size) + at, kind="stable")
        place = at[order]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        bounds = np.searchsorted(column[order], np.arange(column.max(initial=0) + 2))
        group = np.searchsorted(new, bounds)
        for c in range(len(bounds) - 1):
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                begins = new[group[c] : group[c + 1]]
                yield order[a:b], begins - a, place[begins]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """For each place, the log of the sum over all ways of spelling a word up to there."""
        alpha = np.full(self.size, -np.inf)
        alpha[self.head] = 0
        w = weight[self.piece]
        for edges, begins, place in self._swept(self.stop):
            alpha[place] = _log_sums(alpha[self.start[edges]] + w[edges], begins)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.full(self.size, -np.inf)
        beta[self.tail] = 0
        w = weight[self.piece]
        for edges, begins, place in reversed(list(self._swept(self.start))):
            beta[place] = _log_sums(beta[self.stop[edges]] + w[edges], begins)
        return beta


def _log_sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials over stretches."""
    top = np.maximum.reduceat(x, begins)
    safe = np.where(np.isfinite(top), top, 0)
    width = np.diff(np.r_[begins, len(x)])
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, width)), begins))


class Lattice:
    """Piece weights (natural logs) and sums over all segmentations of words."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.pieces, self.trie = pieces, Trie(pieces)
        self.opens = np.array([p[:1] == b" " for p in pieces])
        self.floor = np.where(np.fromiter(map(len, pieces), dtype=np.int64) == 1, FLOOR_BYTE, FLOOR_PIECE)
        self.normalise(1 / (1 - scores), 0.5)

    def normalise(self, mass: np.ndarray, stops: float) -> None:
        """Weights from the masses of pieces and of the stop; a space alone is no word, so what would stop there is shared by the others."""
        with np.errstate(divide="ignore"):
            opening, going = mass[self.opens].sum(), mass[~self.opens].sum() + stops
            self.weights = np.log(mass) - np.log(np.where(self.opens, opening, going))
            self.stop = math.log(stops / going)
        bare = sum(math.exp(self.weights[i] + self.stop) for i, p in enumerate(self.pieces) if p == b" ")
        self.stop -= math.log1p(-bare)

    def blocks(self, words: pa.Array) -> Iterator[tuple[np.ndarray, Block]]:
        """(which words, their lattices), words of similar lengths together."""
        words = words.cast(pa.binary())
        length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        offset, data = (np.frombuffer(x, dtype=t) if x else np.zeros(1, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
        begin = offset[words.offset : words.offset + len(words)].astype(np.int64)
        order = np.argsort(length, kind="stable")
        total, at = np.r_[0, np.cumsum(length[order] + 2)], 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, side="right")) - 1)
            yield order[at:to], Block(self.trie, data, begin[order[at:to]], length[order[at:to]])
            at = to

    def spelling(self, words: pa.Array) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for which, block in self.blocks(words):
            out[which] = block.forward(self.weights)[block.tail] + self.stop
        return out

    def uses(self, words: pa.Array) -> np.ndarray:
        """Expected number of uses of each piece in these words, one of each."""
        total = np.zeros(len(self.pieces))
        for _, block in self.blocks(words):
            alpha, beta = block.forward(self.weights), block.backward(self.weights)
            word = np.searchsorted(block.head, block.start, side="right") - 1
            x = alpha[block.start] + self.weights[block.piece] + beta[block.stop] - alpha[block.tail][word]
            total += np.bincount(block.piece, weights=np.exp(x), minlength=len(total))
        return total

    def learn(self, uses: np.ndarray, words: int) -> None:
        self.normalise(uses + self.floor, words + FLOOR_BYTE)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(column)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return flat.filter(real).cast(pa.binary()), np.bincount(text[real.to_numpy(zero_copy_only=False)], minlength=len(column))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often a word is in training documents, and in all. ``docs`` has doc_id, text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
            return t.select(["word", "c_sum", "n_sum"]).rename_columns(["word", "c", "n"])

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                flat, per = split_words(part.column(1))
                found = flat.dictionary_encode()
                code = found.indices.to_numpy(zero_copy_only=False)
                out = np.repeat(part.column(2).to_numpy(zero_copy_only=False), per)
                n = np.bincount(code, minlength=len(found.dictionary))
                c = n - np.bincount(code[out], minlength=len(n))
                held.append(pa.table({"word": found.dictionary, "c": pa.array(c.astype(np.int64)), "n": pa.array(n.astype(np.int64))}))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from merged().combine_chunks().to_batches()

    return map_batches(docs, run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def train(words: DataFrame, path: str) -> Lattice:
    """The lattice, its weights learnt from the words (``word``), each taken once. In a round one number for each piece reaches the driver."""
    lattice = Lattice(*pieces_of(path))
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(shared.value.pieces)), 0
            for b in batches:
                total += shared.value.uses(b.column(0))
                n += b.num_rows
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, total[some]])], ["piece", "x"])

        found = map_batches(words.select("word"), run, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
        piece, x = (found.column(k).to_numpy() for k in (0, 1))
        uses = np.zeros(len(lattice.pieces))
        uses[piece[piece >= 0]] = x[piece >= 0]
        if n := x[piece < 0].sum():
            lattice.learn(uses, n)
        shared.unpersist()
    return lattice


def weighed(counts: DataFrame, lattice: Lattice, total: int, distinct: int, discount: float) -> DataFrame:
    """(word, c, n, q): q is the natural log of a word's probability among words."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c - discount, 0))
            q = np.logaddexp(own, math.log(discount * distinct + 1) + shared.value.spelling(b.column(0))) - math.log(total + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q)], ["word", "c", "n", "q"])

    return map_batches(counts.select("word", "c", "n"), run, "word binary, c long, n long, q double")


def frequent(counts: DataFrame, most: int = FREQUENT) -> Hot:
    """The words, with counts and q, that are most frequent anywhere: as many eighths of octaves of the count as hold ``most`` words together. Which words these are changes no score."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 512 rows
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r.step
    if least is None:
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64), np.zeros(0)
    found = counts.where(step >= least).select("word", "c", "q").toArrow().combine_chunks()
    return pa.concat_arrays(found.column(0).chunks), found.column(1).to_numpy(), found.column(2).to_numpy()


def scored(hot: Hot, column: pa.Array) -> tuple[np.ndarray | pa.Array, ...]:
    """Of each text: words, sums over its frequent words of q, log10(c + 0.5) and known words, and its other words."""
    flat, per = split_words(column)
    found = flat.dictionary_encode()
    words, counts, weights = hot
    at = pc.fill_null(pc.index_in(found.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)
    c, q = np.r_[counts, -1][at], np.r_[weights, 0.0][at]  # -1: the entry after the last, for words that are not among them
    code = found.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(column)), per)
    total = lambda x: np.bincount(text, weights=x[code], minlength=len(column))
    other = (c < 0)[code]
    offsets = np.r_[0, np.cumsum(np.bincount(text[other], minlength=len(column)))]
    rare = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.filter(pa.array(other)))
    return per, total(q), total(np.where(c < 0, 0, np.log10(np.maximum(c, 0) + 0.5))), total(c > 0).astype(np.int64), rare


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) of every row."""
    spark = docs.sparkSession
    slim = document_texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    counted = Written(word_counts(slim))
    ends = slim.where(~F.col("held_out")).count()
    one = lambda k: F.count_if(F.col("c") == k)
    words, distinct, once, twice = counted.df.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), one(1), one(2)).first()
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
    share = math.log10(words + ends + 0.5 * (distinct + (ends > 0) + 1))
    lattice = train(counted.df.where("c > 0"), path)
    counts = Written(weighed(counted.df, lattice, words, distinct, discount)).df
    counted.drop()
    shared = spark.sparkContext.broadcast(frequent(counts, FREQUENT))
    word10, end10 = (math.log10((x + 0.5) / (words + ends + 1)) for x in (words, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                n, q, base, known, rare = scored(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n.astype(np.int64) + 1), pa.array(q / math.log(10) + n * word10 + end10), pa.array(base + math.log10(ends + 0.5)), pa.array(known + (ends > 0)), rare],
                    ["doc_id", "held_out", "n_tokens", "score", "base", "known", "rare"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, score double, base double, known long, rare array<binary>"
    # written with a row number of its own, which the join of the other words comes back to
    rows = Written(map_batches(slim, run, schema).withColumn("row", F.monotonically_increasing_id())).df
    met = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").count()
    found = met.join(counts.select("word", "c", "q"), "word")
    extra = found.groupBy("row").agg(
        F.sum(F.col("count") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("count")).otherwise(0)).alias("also"), F.sum(F.col("count") * F.col("q") / math.log(10)).alias("drawn")
    )
    whole = rows.drop("rare").join(extra, "row", "left")
    zero = F.lit(0)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", zero)).cast("long").alias("n_known"), F.lit(words + ends).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero.cast("double")) - F.col("n_tokens") * share).alias("base_score"), (F.col("score") + F.coalesce("drawn", zero.cast("double"))).alias("score"),
    )
