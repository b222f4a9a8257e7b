"""SimHash near-dedup by anchor points of a covering code.

A fingerprint has 64 bits. Two blocks of 23 of them are each covered by the
binary Golay code, whose words lie within 3 bits of every point: the anchors
are pairs of code words. A fingerprint's home is its nearest anchor. Of two
fingerprints that differ in at most two bits, the second lies within 3 + i bits
of the first's home in one block and 3 + j in the other, with i + j at most 2;
so each distinct fingerprint is sent to its home and, as a candidate, to all
anchors within that reach (about 61), and compared there with those at home.
With 2**24 anchors a pair meets once, at the home of the smaller fingerprint.

Equal fingerprints are one row from the start, so a group of copies never
meets itself. Links go through ``connected_components``.

Texts whose five-word shingles have a similarity of 0.8 differ in about 15 % of
a fingerprint's bits, far beyond two. A ball of that radius holds more anchors
than a search can visit, for any code. ``similar`` therefore takes fingerprints
of 256 bits and, as anchors, the points of TABLES subcubes: each fixes BITS
coordinates, so its code has radius zero and a fingerprint is sent to one anchor
of each, its home. Two texts meet if they share one of their homes, and are
linked if they differ in at most CLOSE bits. At a home each arrival is compared
with leaders only: it is linked to the first one near enough, or becomes one.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other; rows with equal ids are separate rows of one
id; rows with a null id get a fingerprint and a component (null if no row of
the component has an id); texts are hashed whole; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from .common import Written, connected_components, document_texts, map_batches, slices, texts
from .op4_lattice import split_words

#: Fixed values of the Golay code: length, generator polynomial, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b101011100011, 3
#: Bits by which linked fingerprints may differ.
THRESHOLD = 2
SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence if there are fewer words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), SEED)], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``th`` (a hash of the text) and ``fp`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in texts(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "th", "fp"])

    return map_batches(document_texts(docs).withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, fp long")


def remainder(v: np.ndarray) -> np.ndarray:
    """Syndromes: the remainders of 23-bit polynomials by the generator."""
    v = v.copy()
    for k in range(LENGTH - 1, 10, -1):
        v ^= np.where(v >> k & 1, GENERATOR << (k - 11), 0)
    return v


@lru_cache(maxsize=1)
def cosets() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of up to RADIUS + THRESHOLD bits by syndrome.

    Returns the patterns, ordered by syndrome and excess weight, and for each
    syndrome where those of excess 0, 1, 2 begin and end (2048 x 4).
    """
    patterns = np.array([sum(1 << b for b in c) for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(LENGTH), w)], dtype=np.int64)
    excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    key = remainder(patterns) * (THRESHOLD + 1) + excess
    order = np.argsort(key, kind="stable")
    begins = np.searchsorted(key[order], np.arange(2048 * (THRESHOLD + 1) + 1))
    return patterns[order], np.stack([begins[k : k + 2048 * 3 : 3] if k < 3 else begins[3::3] for k in range(4)], axis=1)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges, one after the other, and which range each is of."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n), of


def homes(fp: np.ndarray) -> np.ndarray:
    patterns, at = cosets()
    x, y = fp & 0x7FFFFF, fp >> np.uint64(LENGTH) & np.uint64(0x7FFFFF)
    x, y = x.astype(np.int64), y.astype(np.int64)
    return (x ^ patterns[at[remainder(x), 0]]) << LENGTH | (y ^ patterns[at[remainder(y), 0]])


def reach(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, which fingerprint each is of): all anchors at which a fingerprint is a candidate."""
    patterns, at = cosets()
    x, y = (fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(LENGTH) & np.uint64(0x7FFFFF)).astype(np.int64)
    ax, ay = at[remainder(x)], at[remainder(y)]
    anchors, owners = [], []
    for used in range(THRESHOLD + 1):  # excess in the first block; the second may use the rest
        i, of = _ranges(ax[:, used], ax[:, used + 1])
        j, of_i = _ranges(ay[of, 0], ay[of, THRESHOLD - used + 1])
        owner = of[of_i]
        anchors.append((x[owner] ^ patterns[i[of_i]]) << LENGTH | (y[owner] ^ patterns[j]))
        owners.append(owner)
    return np.concatenate(anchors), np.concatenate(owners)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), u < v, for all pairs of the distinct fingerprints ``fp`` that differ in at most THRESHOLD bits, each once."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(homes(fp.view(np.uint64))), b.column(0)], ["anchor", "u"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(k, 4096).to_numpy(zero_copy_only=False)
                anchors, of = reach(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fp[of])], ["anchor", "v"])

    home = map_batches(distinct.select("fp"), at_home, "anchor long, u long")
    near = map_batches(distinct.select("fp"), around, "anchor long, v long")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= THRESHOLD
    return home.join(near.hint("merge"), "anchor").where((F.col("u") < F.col("v")) & close).select("u", "v")


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``th``, ``fp``, ``root`` (a fingerprint of the component) and ``component_id`` (the smallest id that is reachable) of every row."""
    marked = Written(fingerprints(docs, words)).df
    distinct = Written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))).df
    roots = connected_components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that both sides of the last join are plain exchanges and a fingerprint with very many rows can be split
    ids = Written(rooted.join(least, "root").select("fp", "root", "component_id")).df
    return marked.join(ids, "fp").select("doc_id", "th", "fp", "root", "component_id")


#: Bits of the fingerprints in ``similar``, subcubes, coordinates that each fixes, and bits by which linked fingerprints may differ (those of a similarity of 0.8 differ in 39 on average, in 46 or fewer nine times in ten).
WIDE, TABLES, BITS, CLOSE = 256, 64, 22, 46
#: Words that are hashed together.
PART = 1 << 16


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in words.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def wide_fingerprints(column: pa.Array, words: int) -> np.ndarray:
    """WIDE bits of each text, as rows of 64-bit words; zero for texts without words."""
    flat, per = split_words(column)
    found = flat.dictionary_encode()
    h = word_hashes(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(per), WIDE // 64), dtype=np.uint64)
    ends = np.cumsum(per)
    for text, n in enumerate(per.tolist()):
        if not n:
            continue
        own = h[ends[text] - n : ends[text]]
        size = min(words, n)
        ones = np.zeros(WIDE, dtype=np.int64)
        for at in range(0, n - size + 1, PART):
            part = own[at : at + PART + size - 1]
            shingle = np.zeros(len(part) - size + 1, dtype=np.uint64)
            for k in range(size):
                shingle = shingle * np.uint64(0xD6E8FEB86659FD93) + part[k : len(part) - size + 1 + k]
            bits = np.stack([_mixed(shingle, k + 1) for k in range(WIDE // 64)], axis=1)
            ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[text] = np.packbits(ones * 2 > n - size + 1, bitorder="little").view(np.uint64)
    return out


@lru_cache(maxsize=1)
def coordinates() -> np.ndarray:
    rng = np.random.default_rng(64)
    return np.stack([rng.permutation(WIDE)[:BITS] for _ in range(TABLES)])


def subcubes(fp: np.ndarray) -> np.ndarray:
    """The home of each fingerprint in every table (rows x TABLES)."""
    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
    weights = 1 << np.arange(BITS, dtype=np.int64)
    return np.stack([bits[:, c] @ weights + (t << BITS) for t, c in enumerate(coordinates())], axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def led(fp: np.ndarray, node: np.ndarray, leaders: list[np.ndarray], nodes: list[int], links: list[tuple[int, int]]) -> None:
    """Link arrivals at one anchor to its leaders; those that none is near to become leaders."""
    left = np.arange(len(fp))
    for lead, at in zip(leaders, nodes, strict=True):
        near = distance(fp[left], lead) <= CLOSE
        links += [(at, x) for x in node[left[near]].tolist()]
        left = left[~near]
        if not len(left):
            return
    while len(left):
        lead, at = fp[left[0]], int(node[left[0]])
        leaders.append(lead)
        nodes.append(at)
        left = left[1:]
        near = distance(fp[left], lead) <= CLOSE
        links += [(at, x) for x in node[left[near]].tolist()]
        left = left[~near]


FP = ", ".join(f"f{k} long" for k in range(WIDE // 64))


def _at_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within a partition sorted by anchor; leaders (with their anchor) of the partition's first and last anchors, which others may hold too."""
    leaders: list[np.ndarray] = []
    nodes: list[int] = []
    key, first = None, True
    schema = pa.schema([(n, pa.int64()) for n in ("u", "v", "anchor", *(f"f{k}" for k in range(WIDE // 64)))])

    def edge() -> pa.RecordBatch:
        fps = np.array(leaders, dtype=np.uint64).reshape(-1, WIDE // 64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.int64()), pa.array([key] * len(nodes), pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        anchor, node = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        fp = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 2 + WIDE // 64)], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        stops = np.r_[starts[1:], len(anchor)]
        links: list[tuple[int, int]] = []
        inner = np.arange(len(starts))[1:-1]
        size = stops - starts
        two = inner[size[inner] == 2]
        near = distance(fp[starts[two]], fp[starts[two] + 1]) <= CLOSE
        links += zip(node[starts[two[near]]].tolist(), node[starts[two[near]] + 1].tolist(), strict=True)
        for k in inner[size[inner] > 2].tolist():
            led(fp[starts[k] : stops[k]], node[starts[k] : stops[k]], [], [], links)
        for k in sorted({0, len(starts) - 1}):
            if key != anchor[starts[k]]:
                if key is not None and first:
                    yield edge()
                first = first and key is None
                key, leaders, nodes = int(anchor[starts[k]]), [], []
            led(fp[starts[k] : stops[k]], node[starts[k] : stops[k]], leaders, nodes, links)
        u, v = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *(pa.nulls(len(u), pa.int64()) for _ in range(1 + WIDE // 64))], schema=schema)
    if key is not None:
        yield edge()


def similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id``, ``th`` and ``root`` (equal within a group of near duplicates) of every row."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000):
            fp = wide_fingerprints(b.column(1), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["doc_id", "th", *(f"f{k}" for k in range(WIDE // 64))])

    def homes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1_000):
            fp = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
            of = pa.array(np.repeat(np.arange(len(fp)), TABLES))
            yield pa.RecordBatch.from_arrays([pa.array(subcubes(fp.view(np.uint64)).ravel()), *(c.take(of) for c in b.columns)], ["anchor", "node", *b.schema.names[1:]])

    names = [f"f{k}" for k in range(WIDE // 64)]
    marked = Written(map_batches(document_texts(docs).withColumn("th", F.xxhash64("text")), marks, f"doc_id long, th long, {FP}")).df.withColumn("node", F.xxhash64(*names))
    distinct = Written(marked.select("node", *names).distinct())
    sent = Written(map_batches(distinct.df, homes_of, f"anchor long, node long, {FP}"))
    order = ["anchor", *names]
    columns = f"u long, v long, anchor long, {FP}"
    met = Written(map_batches(sent.df.repartitionByRange(*order).sortWithinPartitions(*order), _at_anchors, columns))
    sent.drop()
    distinct.drop()
    leaders = met.df.where("v is null").select("anchor", F.col("u").alias("node"), *names).repartition("anchor").sortWithinPartitions(*order)
    again = map_batches(leaders, _at_anchors, columns).where("v is not null")
    # written, so that both sides of the last join are plain exchanges and a fingerprint with very many rows can be split
    roots = Written(connected_components(met.df.where("v is not null").select("u", "v").unionAll(again.select("u", "v")))).df
    met.drop()
    return marked.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group (``doc_id``, ``th``, ``root``), with all its columns: that of the smallest id (of no id only if no row has one); of rows that also share the id, that of the smallest hash of the text."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.col("th").alias("t"))
    keep = groups.groupBy("root").agg(F.min(order).alias("x")).select("x")
    key = docs["doc_id"].cast("long")
    # the whole row is one column, so no name of its columns can clash
    whole = F.struct(*(col(c) for c in docs.columns))
    rows = docs.select(F.struct(key.isNull().alias("n"), F.coalesce(key, F.lit(0).cast("long")).alias("k"), F.xxhash64(docs["text"].cast("string")).alias("t")).alias("x"), whole.alias("row"))
    kept = rows.join(keep, "x", "left_semi").dropDuplicates(["x"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` as 16 hex digits, ``component_id``."""
    return components(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
