"""Line dedup over range-partitioned line hashes.

Every line becomes a row (hash, document, position). The rows are partitioned
by range over all of these columns and sorted, so a hash with very many rows
spans several partitions. Each partition is streamed once: a run of equal
hashes is counted in documents and its rows are marked as soon as the count is
known. Only a run that may go on in a neighbouring partition and that has not
reached the limit by itself is left open: fewer than ``min_docs`` documents of
it for each partition's edge. These few are settled in a small second step.
What comes back is, for each document with something to drop, a compressed
bitmap of the lines to keep; texts never enter the exchange of the hashes.

Defined results: a null or empty text is one empty line; white-space-only
lines have an empty key and always stay; rows with equal id and text are one
document, rows with equal id and different text count as one document for the
limit but have bitmaps of their own; a null id is an id like any other; columns
other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.expressions import col
from .common import Written, document_texts, map_batches, texts

#: Keep nothing of a repeated line, or its first occurrence by document and position.
NONE, FIRST = "none", "first"
#: Rows that one emitted batch of lines holds at most, beyond a single document.
LINES = 50_000

#: What a streamed partition says about a line: drop it; drop it if its run proves frequent; the run is frequent.
DROP, OPEN, REACHED = 0, 1, 2


def key_of(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def line_rows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of every line with a key; ``th`` tells texts of equal id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, hashes, rows, positions, held = b.column(0), [], [], [], []
            for row, text in enumerate(texts(b.column(1))):
                raw = text.encode("utf-8", "surrogatepass")
                th = xxhash.xxh3_64_intdigest(raw)
                keys = [k.strip() for k in raw.lower().split(b"\n")]
                found = [(p, digest(k)) for p, k in enumerate(keys) if k]
                positions += [p for p, _ in found]
                hashes += [h for _, h in found]
                rows += [row] * len(found)
                held += [th] * len(found)
                if len(rows) >= LINES:
                    yield _line_batch(ids, hashes, rows, positions, held)
                    hashes, rows, positions, held = [], [], [], []
            yield _line_batch(ids, hashes, rows, positions, held)

    return map_batches(document_texts(docs), run, "h1 long, h2 long, doc_id long, th long, pos int")


def _line_batch(ids: pa.Array, hashes: list[bytes], rows: list[int], positions: list[int], held: list[int]) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    th = np.array(held, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(pa.array(rows, pa.int64())), pa.array(th), pa.array(positions, pa.int32())], ["h1", "h2", "doc_id", "th", "pos"]
    )


class _Run:
    """One hash's rows in a partition, as far as they are held back."""

    def __init__(self, key: tuple[int, int], edge: bool):
        self.key, self.edge, self.docs, self.last = key, edge, 0, object()
        self.held: list[pa.RecordBatch] = []
        self.reached = False


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep: str, by_rows: bool) -> Iterator[pa.RecordBatch]:
    """Marks for the rows of one sorted partition; ``_Run`` goes across Arrow batches."""
    run: _Run | None = None
    first_run = True

    def marks(rows: pa.RecordBatch, kind: int, lead: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, kind, np.int8)), pa.array(np.full(rows.num_rows, lead))], [*rows.schema.names, "kind", "lead"])

    def close(r: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        if r.held and not r.reached and (r.edge or last):
            for k, part in enumerate(r.held):
                if k == 0:
                    yield marks(part.slice(0, 1), OPEN, lead=True)
                    part = part.slice(1)
                yield marks(part, OPEN)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        doc = b.column(2)
        ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
        null = doc.is_null().to_numpy(zero_copy_only=False)
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = np.full(b.num_rows, True) if by_rows else new_key | np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]
        starts = np.flatnonzero(new_key)
        stops = np.r_[starts[1:], b.num_rows]
        docs_in = np.add.reduceat(new_doc.astype(np.int64), starts)
        if len(starts) > 2:  # runs with both ends in this batch are settled together
            often = docs_in >= min_docs
            often[0] = often[-1] = False
            gone = np.repeat(often, stops - starts)
            if keep == FIRST:
                gone[starts] = False
            if gone.any():
                yield marks(b.take(pa.array(np.flatnonzero(gone))), DROP)
        for k in sorted({0, len(starts) - 1}):
            at, to, n = int(starts[k]), int(stops[k]), int(docs_in[k])
            key = (int(h1[at]), int(h2[at]))
            if run is not None and run.key != key:
                yield from close(run, last=False)
                run, first_run = None, False
            if run is None:
                run = _Run(key, edge=first_run)
            doc_at = None if null[at] else int(ids[at])
            run.docs += n - (not by_rows and run.last == doc_at)
            run.last = None if null[to - 1] else int(ids[to - 1])
            run.held.append(b.slice(at, to - at))
            if run.docs < min_docs:
                continue
            if not run.reached:
                run.reached = True
                lead = run.held[0].slice(0, 1)
                yield marks(lead, REACHED, lead=True)  # the run's first row here; whether it stays is for the next step to say
                run.held[0] = run.held[0].slice(1)
                if keep == NONE:
                    yield marks(lead, DROP)
            for part in run.held:
                if part.num_rows:
                    yield marks(part, DROP)
            run.held = []
    if run is not None:
        yield from close(run, last=True)


def dropped_lines(docs: DataFrame, min_docs: int, keep: str = NONE) -> DataFrame:
    """(doc_id, th, pos) of every line whose key is found in at least ``min_docs`` documents.

    With ``keep='first'`` the first occurrence, by document and position, stays.
    """
    if min_docs < 1 or keep not in (NONE, FIRST):
        raise ValueError("min_docs is at least 1, keep is 'none' or 'first'")
    return frequent_rows(line_rows(docs), min_docs, keep)


def frequent_rows(rows: DataFrame, min_docs: int, keep: str = NONE, by_rows: bool = False) -> DataFrame:
    """(doc_id, th, pos) of the rows (h1, h2, doc_id, th, pos) whose hash is found in ``min_docs`` documents, or rows, at least."""
    order = ["h1", "h2", "doc_id", "th", "pos"]
    parsed = Written(rows)  # the range step samples its input first: from the file, not by parsing twice
    rows = parsed.df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = map_batches(rows, lambda it: _stream(it, min_docs, keep, by_rows), "h1 long, h2 long, doc_id long, th long, pos int, kind byte, lead boolean")
    table = Written(marked).df
    parsed.drop()
    sure = table.where(F.col("kind") == DROP).select("doc_id", "th", "pos")
    # edges of partitions: a REACHED row for each frequent run, open rows of fewer than min_docs documents each
    edge = table.where((F.col("kind") == OPEN) | F.col("lead"))
    runs = edge.groupBy("h1", "h2").agg(
        F.max((F.col("kind") == REACHED).cast("int")).alias("reached"),
        (F.count_if(F.col("kind") == OPEN) if by_rows else F.countDistinct(F.when(F.col("kind") == OPEN, F.struct("doc_id")))).alias("docs"),
        F.min(F.when(F.col("lead"), F.struct("doc_id", "th", "pos"))).alias("first"),
    )
    frequent = runs.where((F.col("reached") == 1) | (F.col("docs") >= min_docs)).select("h1", "h2", "first")
    open_rows = table.where(F.col("kind") == OPEN).join(frequent, ["h1", "h2"])
    here = F.struct("doc_id", "th", "pos")
    if keep == NONE:
        return sure.unionAll(open_rows.select("doc_id", "th", "pos"))
    leads = table.where(F.col("kind") == REACHED).join(frequent, ["h1", "h2"])
    late = open_rows.unionByName(leads).where(~here.eqNullSafe(F.col("first"))).select("doc_id", "th", "pos")
    return sure.unionAll(late)


def keep_bitmaps(docs: DataFrame, min_docs: int, keep: str = NONE) -> DataFrame:
    """(doc_id, th, bitmap) for each text that loses lines: bit ``pos`` of the inflated bitmap is 0 where a line goes.

    The bitmap ends with the last dropped line; lines after it stay.
    """
    gone = dropped_lines(docs, min_docs, keep).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [pack(np.array(x, dtype=np.int64)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["doc_id", "th", "bitmap"])

    return map_batches(gone, run, "doc_id long, th long, bitmap binary")


def pack(gone: np.ndarray) -> bytes:
    bits = np.ones(int(gone.max()) + 1, dtype=np.uint8)
    bits[gone] = 0
    return zlib.compress(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes(), 6)


def unpack(bitmap: bytes, lines: int) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=8))[: int.from_bytes(raw[:8], "little")]
    return np.r_[bits, np.ones(max(lines - len(bits), 0), dtype=np.uint8)][:lines].astype(bool)


def kept_lines(text: str, bitmap: bytes | None) -> list[str]:
    lines = text.split("\n")
    return lines if bitmap is None else [x for x, stays in zip(lines, unpack(bitmap, len(lines)).tolist(), strict=True) if stays]


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, text_hash: DataFrame) -> DataFrame:
    on = text_hash["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (text_hash["th"] == bitmaps["th"])
    return text_hash.join(bitmaps.hint("shuffle_hash"), on, "left").drop(bitmaps["doc_id"]).drop(bitmaps["th"])


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``th`` before its own columns."""
    names = docs.columns
    schema = docs.select(F.lit(0).cast("long").alias("th"), *names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts(b.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(held, dtype=np.uint64).view(np.int64)), *b.columns], ["th", *names])

    return map_batches(docs, run, schema)


def dedup_lines(docs: DataFrame, min_docs: int, keep: str = NONE) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` (and ``n_chars``, if there, set anew); all rows and columns stay."""
    names = docs.columns
    base = docs.select("doc_id", "text", F.struct(*map(col, names)).alias("row"))
    joined = _with_bitmaps(docs, keep_bitmaps(docs, min_docs, keep), _hashed(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, maps = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("bitmap"))
            out = [t if m is None else "\n".join(kept_lines(t or "", m)) for t, m in zip(source.to_pylist(), maps.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(b.schema.get_field_index("row"))], ["kept", "row"])

    slim = joined.select("text", "bitmap", F.struct(*(F.col("row").getField(c).alias(c) for c in names if c != "text")).alias("row"))
    kept = map_batches(slim, run, StructType([StructField("kept", StringType()), slim.schema["row"]]))
    value = {"text": F.col("kept")}
    if "n_chars" in names:
        value["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*((value[c] if c in value else F.col("row").getField(c)).alias(c) for c in names))


def digests(docs: DataFrame, min_docs: int) -> DataFrame:
    """Per document: lines before, lines dropped, SHA-256 of what is kept."""
    slim = document_texts(docs)
    joined = _with_bitmaps(slim, keep_bitmaps(slim, min_docs), _hashed(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dropped, sha = [], [], []
            for t, m in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines = t.count("\n") + 1
                kept = kept_lines(t, m) if m is not None else None
                n.append(lines)
                dropped.append(0 if kept is None else lines - len(kept))
                sha.append(hashlib.sha256((t if kept is None else "\n".join(kept)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_batches(joined.select("doc_id", "text", "bitmap"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The same result in DuckDB.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE k IN (SELECT k FROM often)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
