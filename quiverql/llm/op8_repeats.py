"""Removal of repeated byte strings, by prefix-free parsing.

A rolling hash over SEED bytes picks triggers: a place is one if its hash is
the least in some stretch of LENGTH bytes. So every string of LENGTH bytes
contains a trigger, and equal strings contain the same ones. The triggers parse
the text; each string of LENGTH bytes belongs to the first of its least
triggers (its anchor), and the strings of an anchor are a contiguous run, its
phrase. Two orders together decide which strings occur twice, as the corpus
order of all suffixes would, down to LENGTH bytes:

* the order of the parse, a range partition of all phrases by seed and content:
  a phrase that occurs twice is repeated as a whole, and a seed that occurs once
  has no repeated string;
* the suffix array of the dictionary: a seed that goes with different phrases
  may begin strings that agree across them. One occurrence of each such phrase
  goes into the dictionary with its bytes, its anchored suffixes are sorted as
  bytes to the depth of LENGTH, and those that agree with a neighbour to that
  depth are repeated.

Highly repetitive text has few distinct phrases, so it costs no more than its
dictionary. The distinct phrases of a seed are sorted together; a seed with more
than MOST of them has its strings sorted by two 64-bit hashes over range
partitions instead, so that a seed with very many phrases spans tasks. Suffixes of phrases
that no other phrase shares a seed with are never sorted, nor any past LENGTH
bytes, where the answer does not depend on it. Phrases are told apart by two
64-bit hashes, of the seed and of the whole.

Defined results: a null or empty text has no bytes; matches never cross
documents; rows with equal id and text are documents of their own, so their
long enough strings are repeated; texts of any length are parsed whole, in
overlapping blocks; columns other than ``doc_id`` and ``text`` are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, document_texts, map_batches, slices
from .op3_lines import frequent_rows

#: Bytes of a repeated string and of a trigger's seed.
LENGTH, SEED = 200, 64
#: Bytes of text that are parsed together (their places take PLACE bits) and strings that are sorted together.
CHUNK, PLACE, SORTED = 120_000, 20, 30_000
#: Texts that are Python objects at a time.
TEXTS = 500
#: Most phrases of a seed that are sorted together; those of other seeds are spread over tasks.
MOST = 20_000

#: What is said of a phrase: all its strings are repeated; its seed's other phrases are in the same partition; there may be more anywhere.
REPEATED, TOGETHER, APART = 1, 2, 4


@lru_cache(maxsize=8)
def _tables(size: int) -> tuple[np.ndarray, ...]:
    """Random words for bytes, and powers of an odd number and of its inverse modulo 2**64, for two hashes."""
    rng = np.random.default_rng(8)
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        out += [letters, np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


class Rolling:
    """A hash of any stretch of one byte array."""

    def __init__(self, data: np.ndarray, which: int = 0):
        letters, self.up, down = _tables(1 << max(17, len(data).bit_length()))[3 * which : 3 * which + 3]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(letters[data] * down[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.up[begin] + (end - begin).astype(np.uint64))

    def seeds(self) -> np.ndarray:
        """For every place, an unmixed hash of the SEED bytes that begin there."""
        h = self.sums[SEED:] - self.sums[:-SEED]
        h *= self.up[: len(h)]
        return h


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of ``width`` entries."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def parse(rolling: Rolling, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts that stand one after the other; text i, of at least LENGTH bytes, is from begin[i] to begin[i + 1].

    Returns for each phrase: its text, its anchor, and the first and last
    string (by its first byte).
    """
    mask = np.uint64((1 << PLACE) - 1)
    h = rolling.seeds()
    # the place in the low bits makes the first of equal hashes the least
    h &= ~mask
    h |= np.arange(len(h), dtype=np.uint64)
    least = _slide(h, LENGTH - SEED + 1)
    first = np.unique(np.r_[begin[:-1], np.flatnonzero(least[1:] != least[:-1]) + 1])
    text = np.searchsorted(begin, first, side="right") - 1
    end = begin[text + 1] - LENGTH
    last = np.minimum(np.r_[first[1:], begin[-1]] - 1, end)
    inside = first <= end
    text, first, last = text[inside], first[inside], last[inside]
    return text, (least[first] & mask).astype(np.int64), first, last


def raw_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _blocks(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least LENGTH bytes, in blocks of about CHUNK bytes: (text of each piece, where it begins in its text, all bytes, where pieces begin).

    A longer text is cut into pieces that overlap so that each string is whole
    in just one of them.
    """
    texts, offsets, parts, size = [], [], [], 0

    def block() -> tuple[np.ndarray, ...]:
        return np.array(texts), np.array(offsets), np.frombuffer(b"".join(parts), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]

    for row, x in enumerate(raw):
        for at in range(0, len(x) - LENGTH + 1, CHUNK):
            part = x[at : at + CHUNK + LENGTH - 1]
            if parts and size + len(part) > CHUNK:
                yield block()
                texts, offsets, parts, size = [], [], [], 0
            texts.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield block()


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - 2**63


def phrases(docs: DataFrame) -> DataFrame:
    """(seed, phrase, doc_id, th, first, last) of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TEXTS):
            raw = raw_of(b.column(1))
            th = np.array([text_hash(x) for x in raw], dtype=np.int64)
            for owner, offset, data, begin in _blocks(raw):
                rolling = Rolling(data)
                text, place, first, last = parse(rolling, begin)
                seed = rolling.of(place, place + SEED)
                phrase = rolling.of(first, last + LENGTH) ^ _mix((place - first).astype(np.uint64))
                shift = offset[text] - begin[text]
                row = owner[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(phrase.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(th[row]), pa.array((first + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32))],
                    ["seed", "phrase", "doc_id", "th", "first", "last"],
                )

    return map_batches(docs, run, "seed long, phrase long, doc_id long, th long, first int, last int")


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks for the phrases of one partition, in order of (seed, phrase).

    Of the seed that a batch ends with, one row for each phrase is held until
    the seed is over, and beyond MOST of them none. One occurrence of each
    phrase is marked APART where the seed's run may go on in another partition
    or has more than MOST phrases, TOGETHER where it has several.
    """
    held: list[pa.RecordBatch] = []  # first rows of the phrases of the open seed
    key: tuple[int, int] | None = None  # of the last row
    tail: pa.RecordBatch | None = None  # first row of the last phrase
    kinds, repeated, edge = 0, False, True  # phrases of the open seed, whether the last one has been met twice, whether the seed is the partition's first

    def marked(rows: pa.RecordBatch, mark: int | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), *rows.columns[2:], pa.array(np.broadcast_to(mark, rows.num_rows).astype(np.int8))], ["seed", "doc_id", "th", "first", "last", "mark"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        seed, phrase = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        goes_on = key is not None and key[0] == seed[0]
        same = goes_on and key[1] == phrase[0]
        if held and not goes_on:
            if edge or kinds > 1:
                for rows in held:
                    yield marked(rows, APART if edge or kinds > MOST else TOGETHER)
            held = []
        if key is not None and not goes_on:
            kinds, edge = 0, False
        new_seed = np.r_[not goes_on, seed[1:] != seed[:-1]]
        new_phrase = new_seed | np.r_[not same, phrase[1:] != phrase[:-1]]
        run, kind = np.cumsum(new_seed), np.cumsum(new_phrase)  # 0: goes on from the batch before
        copies = np.bincount(kind, minlength=kind[-1] + 1)
        copies[0] *= 2
        if same and not repeated:
            yield marked(tail, REPEATED)
        of = np.bincount(run[new_phrase], minlength=run[-1] + 1)
        if goes_on:
            of[0] += kinds
        first_run = edge & (run == run[0])
        open_run = run == run[-1]
        mark = np.where(copies[kind] > 1, REPEATED, 0)
        over = new_phrase & ~open_run & (first_run | (of[run] > 1))
        mark += np.where(over, np.where(first_run | (of[run] > MOST), APART, TOGETHER), 0)
        if held and run[-1] > run[0]:  # the open seed ends in this batch
            if first_run[0] or of[0] > 1:
                for rows in held:
                    yield marked(rows, APART if first_run[0] or of[0] > MOST else TOGETHER)
            held = []
        if run[-1] > run[0]:
            edge = False
        kinds = int(of[run[-1]])
        late = np.flatnonzero(new_phrase & open_run)
        if kinds <= MOST:
            held.append(b.take(pa.array(late)))
        else:  # too many to hold: these will be APART whatever follows
            for rows in held:
                yield marked(rows, APART)
            held = []
            mark[late] += APART
        repeated = bool(copies[kind[-1]] > 1)
        key = int(seed[-1]), int(phrase[-1])
        if new_phrase.any():
            tail = b.slice(int(np.flatnonzero(new_phrase)[-1]), 1)
        some = np.flatnonzero(mark)
        yield marked(b.take(pa.array(some)), mark[some])
    for rows in held:
        yield marked(rows, APART)


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc_id, th, z): texts packed for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TEXTS):
            raw = raw_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_hash(x) for x in raw], pa.int64()), pa.array([zlib.compress(x, 1) for x in raw], pa.binary())], ["doc_id", "th", "z"])

    return map_batches(docs, run, "doc_id long, th long, z binary")


def _joined(zipped: DataFrame, found: DataFrame, how: str) -> DataFrame:
    on = zipped["doc_id"].eqNullSafe(found["doc_id"]) & (zipped["th"] == found["th"])
    return zipped.join(found.hint("shuffle_hash"), on, how).drop(found["doc_id"]).drop(found["th"])


def dictionary(marked: DataFrame, zipped: DataFrame) -> DataFrame:
    """(seed, together, doc_id, th, first, bytes) of the phrases whose strings have to be compared."""
    # seeds that partitions could not judge alone and that have too many phrases together
    wide = marked.where(F.col("mark") >= APART).groupBy("seed").count().where(F.col("count") > MOST).select("seed", F.lit(True).alias("wide"))
    wanted = marked.where(F.col("mark") >= TOGETHER).join(wide, "seed", "left")
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_set(F.struct("seed", F.col("wide").isNull().alias("together"), "first", "last")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()  # rows with equal id and text: one of them is enough
        for b in slices(batches, TEXTS):
            lists = b.column(3)
            flat = lists.flatten()
            seed, together, first, last = (flat.field(k) for k in range(4))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            begins, stops = first.to_pylist(), last.to_pylist()
            of, out = [], []
            for row, (doc_id, th, z, at, to) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), [0, *ends[:-1]], ends, strict=True)):
                if (doc_id, th) not in met:
                    met.add((doc_id, th))
                    raw = zlib.decompress(z)
                    of += [(row, k) for k in range(at, to)]
                    out += [raw[begins[k] : stops[k] + LENGTH] for k in range(at, to)]
            rows, places = pa.array([r for r, _ in of], pa.int64()), pa.array([k for _, k in of], pa.int64())
            yield pa.RecordBatch.from_arrays([seed.take(places), together.take(places), b.column(0).take(rows), b.column(1).take(rows), first.take(places), pa.array(out, pa.binary())], ["seed", "together", "doc_id", "th", "first", "bytes"])

    return map_batches(_joined(zipped, wanted, "inner").select("doc_id", "th", "z", "runs"), run, "seed long, together boolean, doc_id long, th long, first int, bytes binary")


def _laid_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the pieces, and for every string of LENGTH bytes its piece and where it begins."""
    raw = pieces.to_pylist()
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    strings = size - LENGTH + 1
    piece = np.repeat(np.arange(len(raw)), strings)
    inner = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), piece, inner + (np.cumsum(size) - size)[piece]


def repeated_suffixes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which of the suffixes that begin at these places agree with another to LENGTH bytes: neighbours in their sorted order."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin])
    order = np.argsort(rows.view(f"S{LENGTH}").ravel(), kind="stable")
    words = rows.view(np.uint64)[order]
    same = (words[1:] == words[:-1]).all(axis=1)
    out = np.zeros(len(begin), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_strings(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated strings: piece, and the first and last string by their places in it. Pieces of one seed are all there.

    Strings that agree have their anchor in the same place, so those of one
    distance from it are sorted together, and memory stays bounded.
    """
    data, piece, begin = _laid_out(pieces)
    head = begin[np.r_[True, piece[1:] != piece[:-1]]]  # a piece's first string
    h = Rolling(data).seeds() & ~np.uint64((1 << PLACE) - 1)
    anchor = np.lib.stride_tricks.sliding_window_view(h, LENGTH - SEED + 1)[head].argmin(axis=1)
    inner = begin - head[piece]
    distance = anchor[piece] - inner
    order = np.argsort(distance, kind="stable")
    stops = np.r_[np.flatnonzero(np.diff(distance[order])) + 1, len(order)]
    hit, at = np.zeros(len(begin), dtype=bool), 0
    while at < len(order):
        to = int(stops[max(np.searchsorted(stops, at + SORTED, side="right") - 1, np.searchsorted(stops, at, side="right"))])
        hit[order[at:to]] = repeated_suffixes(data, begin[order[at:to]])
        at = to
    some = np.flatnonzero(hit)
    new = np.r_[True, (some[1:] != some[:-1] + 1) | (piece[some[1:]] != piece[some[:-1]])][: len(some)]
    return piece[some[new]], inner[some[new]], inner[some[np.r_[new[1:], True][: len(some)]]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, first, last) of the runs of repeated strings in a partition of the dictionary that is sorted by seed."""
    held: pa.Table | None = None

    def settle(t: pa.Table) -> pa.RecordBatch:
        piece, start, stop = repeated_strings(t.column("bytes").combine_chunks())
        rows = t.select(["doc_id", "th", "first"]).take(pa.array(piece)).combine_chunks()
        first = rows.column("first").to_numpy()
        ids = [pa.concat_arrays(rows.column(k).chunks) if rows.num_rows else pa.array([], pa.int64()) for k in ("doc_id", "th")]
        return pa.RecordBatch.from_arrays([*ids, pa.array((first + start).astype(np.int32)), pa.array((first + stop).astype(np.int32))], ["doc_id", "th", "first", "last"])

    for b in slices(batches, 2_000):
        t = pa.Table.from_batches([b])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        seed = held.column("seed").to_numpy()
        strings = np.r_[0, np.cumsum(pc.binary_length(held.column("bytes")).to_numpy() - LENGTH + 1)]
        ends = np.flatnonzero(seed[1:] != seed[:-1]) + 1  # of whole groups of equal seeds; the last group may go on
        at = 0
        while len(ends) and strings[ends[-1]] - strings[at] >= SORTED:
            to = int(ends[np.searchsorted(strings[ends], strings[at] + SORTED)])
            yield settle(held.slice(at, to - at))
            at = to
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield settle(held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, th, pos) of every string of the dictionary's phrases."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            data, piece, begin = _laid_out(part.column(5))
            origin = np.searchsorted(piece, piece)  # the first string of each piece
            pos = part.column(4).to_numpy(zero_copy_only=False)[piece] + np.arange(len(piece)) - origin
            h = [pa.array(Rolling(data, k).of(begin, begin + LENGTH).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*h, part.column(2).take(pa.array(piece)), part.column(3).take(pa.array(piece)), pa.array(pos.astype(np.int32))], ["h1", "h2", "doc_id", "th", "pos"])


def repeated_runs(docs: DataFrame, zipped: DataFrame) -> DataFrame:
    """(doc_id, th, runs): for each text, runs (first, last) of places where a repeated string begins."""
    order = ["seed", "phrase", "doc_id", "th", "first"]
    parsed = Written(phrases(docs))  # the range step samples its input first: from the file, not by parsing twice
    ordered = parsed.df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = Written(map_batches(ordered, judge, "seed long, doc_id long, th long, first int, last int, mark byte")).df
    parsed.drop()
    words = Written(dictionary(marked, zipped)).df
    together = words.where("together").repartition("seed").sortWithinPartitions("seed")
    shared = map_batches(together, _suffixes, "doc_id long, th long, first int, last int")
    single = frequent_rows(map_batches(words.where("not together"), _hashed, "h1 long, h2 long, doc_id long, th long, pos int"), 2, by_rows=True)
    runs = marked.where(F.col("mark") % 2 == REPEATED).select("doc_id", "th", "first", "last").unionAll(shared)
    runs = runs.unionAll(single.select("doc_id", "th", F.col("pos").alias("first"), F.col("pos").alias("last")))
    return runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def spans_of(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that the strings beginning from ``first`` to ``last`` cover."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.r_[True, first[1:] > end[:-1]]
    return list(zip(first[new].tolist(), end[np.r_[new[1:], True]].tolist(), strict=True))


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))


def _apply(docs: DataFrame, each, schema: str) -> DataFrame:
    """Rows that ``each`` makes of (raw text, spans that go) of every document."""
    slim = document_texts(docs)
    zipped = _zipped(slim)
    joined = _joined(zipped, repeated_runs(slim, zipped), "left").select("doc_id", "z", "runs")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, TEXTS):
            rows, lists = [], b.column(2)
            flat = lists.flatten()
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            for z, at, to in zip(b.column(1).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                rows.append(each(zlib.decompress(z), spans_of(first[at:to], last[at:to])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return map_batches(joined, run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes and runs removed, SHA-256 of the bytes that stay."""

    def each(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        kept = without(raw, spans)
        return len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _apply(docs, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` without repeated strings; a code point that is cut apart becomes U+FFFD."""
    return _apply(docs, lambda raw, spans: (without(raw, spans).decode("utf-8", "replace"),), "doc_id long, text string")
