import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quiverql.llm.op2_bpe import codec, decode, digests, encode

from .conftest import ODD_ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_random_texts_and_every_plane():
    rng = random.Random(2)
    alphabet = "ab thein'sé \n\t 0129日本😀<|endoftext|>!!  \x85\xa0　\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endof<|endoftext|>text|>", "a" * 3000, "ab" * 5000, " " * 700, "a  b\tc", "a\n\nb \nc", "it's we'll I'D"]
    texts += ["".join(map(chr, range(i, i + 64))) + " x" for i in range(0, 0xD800, 64)] + ["y " + "z ".join(map(chr, range(i, i + 64))) for i in range(0xE000, 0x20000, 64)]
    assert codec(PATH).encode_batch(texts) == library(texts)


def test_pairs_are_judged_right():
    bpe, rng = codec(PATH), np.random.default_rng(2)
    a, b = (rng.integers(0, 50000, 4000) for _ in range(2))
    ok = bpe.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        if bpe.merge(bpe.token_bytes[x]) == [x] and bpe.merge(bpe.token_bytes[y]) == [y]:
            assert good == (bpe.merge(bpe.token_bytes[x] + bpe.token_bytes[y]) == [x, y])


def test_merging_together_is_merging():
    bpe, rng = codec(PATH), random.Random(3)
    words = ["".join(rng.choice("thernadoin é") for _ in range(rng.randint(1, 15))).encode() for _ in range(2000)]
    assert bpe.merge_together(words) == [bpe.merge(w) for w in words]


def test_queries(docs_of, odd_docs):
    rows = [(100 + i, f"Document {i} says: thereafter, naïve façades!") for i in range(50)] + ODD_ROWS
    docs = docs_of(rows)
    want = {}
    for (i, t), ids in zip(rows, library([t or "" for _, t in rows]), strict=True):
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = digests(docs, PATH).collect()
    assert len(got) == len(rows) and all(want[r.doc_id] == (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    back = sorted((str(r.doc_id), r.text) for r in decode(encode(docs, PATH), PATH).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert digests(docs_of([]), PATH).count() == 0
