"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match against the
vocabulary. A token sequence is the one that merging in rank order gives if
and only if every adjacent pair of tokens is: so the distinct adjacent pairs
of a batch are tested together, in numpy, and only words in which a pair fails
are merged exactly.

Defined results: a null text counts as empty, which has no tokens; repeated
rows give repeated results; texts of any length are encoded whole; columns
other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty
table. Special tokens that occur literally in a text become their id, as the
library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import document_texts, map_batches
from .trie import Trie, laid_out

#: Fixed value: the splitting rule of byte-level BPE as published with the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What makes a text one for the full rule: no text, white space other than space and line feed, or either at an end or beside another.
ODD = r"\A\z|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A[ \n]|[ \n]\z|[ \n][ \n]"
#: Pairs whose test a worker remembers.
REMEMBERED = 300_000
#: Bytes of text that are split into words and guessed together.
CHUNK = 3_000_000
#: Words of up to this many bytes are merged together, as rows of a matrix.
MATRIX_WIDTH = 32
#: Marks that are a word of their own after letters, at the end of a text without white space.
MARKS = frozenset(".,;:!?")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def gathered(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of a flat array, one after the other, and their lengths."""
    n = (offsets[1:] - offsets[:-1])[at]
    where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[at], n)
    return values[where], n


def offsets_of(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n)]


class BytePairCodec:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        names = spec["model"]["vocab"]
        raw = {name: bytes(to_byte[c] for c in name) for name in names}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*names.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for name, i in names.items():
            self.token_bytes[i] = raw[name]
            self.ids[raw[name]] = i
        for name, i in self.special.items():
            self.token_bytes[i] = name.encode()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.never = len(merges)  # a rank that no merge has
        self.rank_of: dict[tuple[int, int], tuple[int, int]] = {}
        left, right, made_at = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for rank, (a, b) in enumerate(merges):
            x, y, z = names[a], names[b], self.ids[raw[a] + raw[b]]
            self.rank_of.setdefault((x, y), (rank, z))
            if made_at[z] < 0:
                left[z], right[z], made_at[z] = x, y, rank
        self.left, self.right, self.made_at = left, right, made_at
        keys = np.fromiter((x << 32 | y for x, y in self.rank_of), dtype=np.int64, count=len(self.rank_of))
        ranks = np.fromiter((r for r, _ in self.rank_of.values()), dtype=np.int64, count=len(keys))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        #: Only tokens that merging makes out of their own bytes can be guessed.
        whole = sorted((b, i) for b, i in self.ids.items() if len(b) == 1 or made_at[i] >= 0)
        self.trie, self.guessable = Trie([b for b, _ in whole]), np.array([i for _, i in whole], dtype=np.int64)
        self.token_offsets = offsets_of(np.array(list(map(len, self.token_bytes))))
        self.token_flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.byte_pair_rank = self.merge_ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.merged_at = np.full(len(merges) + 1, -1)
        for rank, made in self.rank_of.values():
            self.merged_at[rank] = made
        self.split = regex.compile(SPLIT)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.verdicts: dict[int, bool] = {}
        self.counts = {"guessed": 0, "merged": 0}

    def guess(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: tokens of all words, and how many each has."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat, head = laid_out(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length, length)
        best, step = np.full(len(flat), -1), np.zeros(len(flat), dtype=np.int64)
        place, n = np.flatnonzero(flat != Trie.END), 0
        node = np.zeros(len(place), dtype=np.int32)
        while len(place):
            node = self.trie.step(node, flat[place + n])
            n += 1
            place, node = place[node >= 0], node[node >= 0]
            found = self.trie.piece[node]
            some = found >= 0
            best[place[some]], step[place[some]] = found[some], n
        taken, at = np.zeros(len(flat), dtype=bool), head
        while len(at):
            taken[at] = True
            at = at + step[at]
            at = at[flat[at] != Trie.END]
        where = np.flatnonzero(taken)
        return self.guessable[best[where]], np.bincount(np.searchsorted(head, where, side="right") - 1, minlength=len(words))

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of two tokens gives these two tokens.

        The merges inside ``a`` and inside ``b`` are undone together, latest
        first. While both sides show a piece at the seam, the seam's pair must
        not have a merge that would have come before the merges still undone:
        the left part's merge wins a tie of equal rank, because merging runs
        from the left.
        """
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        # the earliest merge that consumed the piece shown at the seam, on either side
        until_x, until_y = np.full(len(a), self.never), np.full(len(a), self.never)
        while len(live):
            rank = self.merge_ranks(x, y)
            # the seam's pair stands from when both pieces exist until one of them is consumed;
            # of equal ranks the leftmost goes first: x's own consumer lies to the left, y's to the right
            clash = (rank < self.never) & (rank < until_x) & (rank <= until_y)
            ok[live[clash]] = False
            made_x, made_y = self.made_at[x], self.made_at[y]
            going = ~clash & ((made_x >= 0) | (made_y >= 0))
            live, x, y, until_x, until_y, made_x, made_y = (v[going] for v in (live, x, y, until_x, until_y, made_x, made_y))
            undo_x = made_x >= made_y
            until_x = np.where(undo_x, made_x, until_x)
            until_y = np.where(undo_x, until_y, made_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, of those the leftmost."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := self.rank_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.rank_of.get((made, ids[k])):
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.rank_of.get((ids[h], made))):
                heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return [i for i in ids if i >= 0]

    def merge_together(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many short words at once: each round does the next merge of every word."""
        n, lengths = len(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(lengths.max()) + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        col = np.arange(width)
        ids = np.where(col < lengths[:, None], self.byte_id[raw], -1)
        rank = np.full((n, width), self.never)
        rank[:, :-1] = np.where(col[1:] < lengths[:, None], self.byte_pair_rank[raw[:, :-1], raw[:, 1:]], self.never)
        out: list[list[int]] = [[]] * n
        rows = np.arange(n)
        while len(rows):
            at = rank.argmin(axis=1)
            each = np.arange(len(rows))
            best = rank[each, at]
            ended = best == self.never
            if ended.any():
                for k, done in zip(rows[ended].tolist(), ids[ended].tolist(), strict=True):
                    out[k] = [i for i in done if i >= 0]
                ids, rank, rows, at, best = (v[~ended] for v in (ids, rank, rows, at, best))
                each = np.arange(len(rows))
            if not len(rows):
                break
            shift = col[:-1] > at[:, None]  # what stands right of the merged pair moves one to the left
            ids = np.concatenate([np.where(shift, ids[:, 1:], ids[:, :-1]), np.full((len(rows), 1), -1)], axis=1)
            rank = np.concatenate([np.where(shift, rank[:, 1:], rank[:, :-1]), np.full((len(rows), 1), self.never)], axis=1)
            made = self.merged_at[best]
            ids[each, at] = made
            right = ids[each, np.minimum(at + 1, width - 1)]
            rank[each, at] = np.where(right >= 0, self.merge_ranks(made, np.maximum(right, 0)), self.never)
            has_left = at > 0
            rank[each[has_left], at[has_left] - 1] = self.merge_ranks(ids[each[has_left], at[has_left] - 1], made[has_left])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and how many each has: guess all, test all new pairs at once, merge where a test failed."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, lengths = self.guess(raw)
        word = np.repeat(np.arange(len(words)), lengths)
        inner = word[:-1] == word[1:]  # no pair across two words
        pairs, where = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        unseen = np.fromiter((p not in self.verdicts for p in pairs.tolist()), dtype=bool, count=len(pairs))
        fresh = pairs[unseen]
        if len(self.verdicts) > REMEMBERED:
            self.verdicts.clear()
            fresh = pairs
        self.verdicts.update(zip(fresh.tolist(), self.compatible(fresh >> 32, fresh & 0xFFFFFFFF).tolist(), strict=True))
        good = np.fromiter((self.verdicts[p] for p in pairs.tolist()), dtype=bool, count=len(pairs))
        failed = np.unique(word[:-1][inner][~good[where]])
        self.counts["guessed"] += len(words)
        self.counts["merged"] += len(failed)
        new: dict[int, list[int]] = {}
        short = [k for k in failed.tolist() if len(raw[k]) <= MATRIX_WIDTH]
        for at in range(0, len(short), 4096):
            new |= zip(part := short[at : at + 4096], self.merge_together([raw[k] for k in part]), strict=True)
        new |= {k: self.merge(raw[k]) for k in failed.tolist() if len(raw[k]) > MATRIX_WIDTH}
        new |= {k: [self.special[w]] for k, w in enumerate(words) if w in self.special}
        if not new:
            return flat, lengths
        # the guesses of these words give way to what merging made
        k = np.array(sorted(new))
        kept = ~np.isin(word, k)
        lengths = lengths.copy()
        lengths[k] = [len(new[i]) for i in k.tolist()]
        out = np.empty(int(lengths.sum()), dtype=np.int64)
        mine = np.isin(np.repeat(np.arange(len(words)), lengths), k)
        out[~mine] = flat[kept]
        out[mine] = [i for x in k.tolist() for i in new[x]]
        return out, lengths

    def pieces(self, text: str) -> list[str]:
        """Words and literal special tokens, in order."""
        if not self.parts or not any(s in text for s in self.special):
            return self.split.findall(text)
        out = []
        for k, part in enumerate(self.parts.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def words_of(self, unit: str, lead: str) -> list[str]:
        """Words of a text without white space inside, with ``lead`` before it."""
        if unit == "\n":
            return [unit]
        if unit[-1] in MARKS and unit[:-1].isalpha():
            return [lead + unit[:-1], unit[-1]]
        return self.split.findall(lead + unit)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has.

        Texts in which white space is single spaces and line feeds, with
        something around each, are taken apart there, as no word goes across;
        the others follow the full rule.
        """
        odd = pc.match_substring_regex(column, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        odd = odd.to_numpy(zero_copy_only=False)
        index: dict[str, int] = {}
        place = lambda words: [index.setdefault(w, len(index)) for w in words]
        rest = [place(self.pieces(t)) for t in column.filter(pa.array(odd)).to_pylist()]
        lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~odd)), "\n", " \n "), " ")
        items = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = lists.flatten().dictionary_encode()
        names, code = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        feed = np.array([n == "\n" for n in names], dtype=bool)[code] if len(names) else np.zeros(0, dtype=bool)
        bare = np.r_[True, feed[:-1]][: len(code)]
        bare[(np.cumsum(items) - items)[items > 0]] = True
        key = code * 2 + (bare | feed)
        met = np.zeros(2 * len(names), dtype=bool)
        met[key] = True
        unit_words: list[int] = []
        per_unit_words: list[int] = []
        have = index.setdefault
        for k in np.flatnonzero(met).tolist():
            unit, lead = names[k >> 1], "" if k & 1 else " "
            if unit.isalpha():  # most of them
                unit_words.append(have(lead + unit, len(index)))
                per_unit_words.append(1)
                continue
            words = self.words_of(unit, lead)
            unit_words += place(words)
            per_unit_words.append(len(words))
        if not index:
            return np.zeros(0, dtype=np.int64), np.zeros(len(column), dtype=np.int64)
        ids, n = self.encode_words(list(index))
        ends = offsets_of(n)
        # ids of distinct units, then of the texts they are in
        unit_ids, per_word = gathered(ids, ends, np.array(unit_words, dtype=np.int64))
        unit_offsets = offsets_of(per_word)[offsets_of(np.array(per_unit_words, dtype=np.int64))]
        flat, per_unit = gathered(unit_ids, unit_offsets, (np.cumsum(met) - 1)[key])
        whole = offsets_of(per_unit)[offsets_of(items)]
        others = [gathered(ids, ends, np.array(ws, dtype=np.int64))[0] for ws in rest]
        count = np.zeros(len(column), dtype=np.int64)
        count[~odd], count[odd] = np.diff(whole), list(map(len, others))
        if not others:
            return flat, count
        out = np.empty(int(count.sum()), dtype=np.int64)
        mine = np.repeat(odd, count)
        out[~mine], out[mine] = flat, np.concatenate(others)
        return out, count

    def encode_batch(self, batch: list[str]) -> list[list[int]]:
        ids, n = self.encode_column(pa.array(batch, pa.string()))
        ends = offsets_of(n).tolist()
        return [ids[a:b].tolist() for a, b in pairwise(ends)]

    def decode_bytes(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Bytes of texts that have ``n`` ids each."""
        flat, size = gathered(self.token_flat, self.token_offsets, ids)
        raw, ends = flat.tobytes(), offsets_of(size)[offsets_of(n)].tolist()
        return [raw[a:b] for a, b in pairwise(ends)]

    def decode(self, ids: list[int]) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (the second column) have about CHUNK bytes together."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
            yield b.slice(at, to - at)
            at = to


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """The vocabulary at a path that every machine has; read once in a process."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for part in chunks(batches):
            ids, n = bpe.encode_column(filled(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets_of(n).astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_batches(document_texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ``ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in batches:
            back = [bpe.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, then decode, and return sizes and SHA-256 of both sides for every document.

    One narrow pass: neither ids nor texts leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for part in chunks(batches):
            ids, n = bpe.encode_column(filled(part.column(1)))
            ends = (4 * offsets_of(n)).tolist()
            raw = ids.astype("<u4").tobytes()
            ids_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in pairwise(ends)]
            text_sha = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in bpe.decode_bytes(ids, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(document_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
