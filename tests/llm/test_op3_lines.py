import hashlib
from collections import defaultdict

import pytest

from quiverql.llm.op3_lines import dedup_lines, digests, key_of

from .conftest import ODD_ROWS


def brute(rows, min_docs, keep="none"):
    docs = defaultdict(set)
    first = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            k = key_of(line.encode())
            docs[k].add(i)
            first[k] = min(first.get(k, (i, p)), (i, p)) if i is not None else first.get(k, (i, p))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep_line = [not (k := key_of(x.encode())) or len(docs[k]) < min_docs or (keep == "first" and first[k] == (i, p)) for p, x in enumerate(lines)]
        out.append((i, len(lines), len(lines) - sum(keep_line), "\n".join(x for x, ok in zip(lines, keep_line, strict=True) if ok)))
    return out


ROWS = [(i, "\n".join([f"only {i}", " Common LINE\t", "a", "", f"group {i % 7}", f"pair {i // 12}", "twice here", "twice here"])) for i in range(100)]


@pytest.mark.parametrize("min_docs", [2, 10, 12, 13])
def test_against_brute_force(docs_of, min_docs):
    rows = ROWS + [(5000 + i, "last line") for i in range(11)] + [(6000, "last line\nlast line")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in digests(docs_of(rows).repartition(5), min_docs).collect())
    assert got == sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows, min_docs))


def test_first_stays_and_columns_stay(docs_of):
    docs = docs_of(ROWS)
    got = {r.doc_id: r for r in dedup_lines(docs, 2, "first").collect()}
    assert {i: r.text for i, r in got.items()} == {i: k for i, _, _, k in brute(ROWS, 2, "first")}
    assert dedup_lines(docs, 2).columns == docs.columns and all(r.n_chars == len(r.text) and r.u == "x" for r in got.values())


def test_odd_rows(odd_docs, docs_of):
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in digests(odd_docs, 2).collect())
    assert got == sorted((str(i), n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(ODD_ROWS, 2))
    assert dedup_lines(odd_docs, 2).count() == odd_docs.count()
    assert digests(docs_of([]), 2).count() == 0 and digests(docs_of([(1, None)]), 1).first().n_dropped == 0
