import hashlib
import re

from quiverql.llm.op9_pii import digests, find

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "a@b.co_x@c.d.e and x@y z@@w.com q@1.2", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 1 2 3",
    "+1 (017) 555-7713 +44 20 7946 0958 +1 +12345678 +1234567890123456", "é日 mail é@x.com a.b+c@d-e.fr. 😀 x@y.zz", "write to IBAN DE89370400440532013000 now", "ssn 123-45-6789 ok 123-45-6789",
    "+1 555 0123 4567@a.b 4111111111111111.1.1.1", "a@b.c@d.e", "", None, "+" * 50 + "1(" * 3000, "1 " * 20000, "." * 9 + "9" * 40,
]


def test_against_brute_force(docs_of):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in digests(docs_of(rows)).collect()}
    for i, t in rows:
        want = brute(t)
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == sum(x[0] == kind for x in want), (i, t, kind)
        listing = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in PATTERNS] == [x for x in listing.split(",") if x], (i, t)
        assert got[i].base_sha256 == hashlib.sha256(listing.encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and x.split(":")[0] in PATTERNS] == ([x for x in listing.split(",") if x])


def test_added_kinds(docs_of):
    got = {r.doc_id: r for r in find(docs_of([(1, "my IBAN is DE89 3704 0044 0532 0130 00, thanks"), (2, "IBAN DE88370400440532013000"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")])).collect()}
    assert [x.m for x in got[1].iban] == ["DE89 3704 0044 0532 0130 00"] and got[2].iban == [] and len(got[3].ssn) == 1 and got[4].ssn == []


def test_secrets(docs_of):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [f'x token = "{key}" y', f"sha1 {key}", "token aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "the key is in incomprehensibilities-of-words", f"api_key:{key.upper()}é", f"password for serial {key}"]
    got = {r.doc_id: [x.m for x in r.secret] for r in find(docs_of(list(enumerate(rows)))).collect()}
    assert got == {0: [key], 1: [], 2: [], 3: [], 4: [key.upper()], 5: []}


def test_very_many_matches(docs_of):
    texts = ["é" + "😀 a@b.c 1.2.3.4\n" * 9000, " ".join(f"DE89370400440532013000 +1 (017) 555-{i:04d}" for i in range(3000))]
    got = {r.doc_id: r for r in digests(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        listing = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert got[i].base_sha256 == hashlib.sha256(listing.encode()).hexdigest() and got[i].spans.startswith(listing)
    assert got[1].spans.count("iban") == 3000


def test_account_numbers_before_other_words(docs_of):
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    cases = [
        (f"IBAN {gb} The rest", [gb]), (f"IBAN {de} BIC COBADEFF", [de]), (f"IBAN {de} 5 euros", [de]), (f"bank {de} {gb} {de}, x", [de, gb, de]), ("IBAN GB82 WEST 1234 5698 7654 32 A 1 B", ["GB82 WEST 1234 5698 7654 32"]),
        (f"IBAN {de}x", []), (f"IBAN {de}A", []), (f"IBAN x{de}", []), (f"\u00e9\U0001f600 IBAN {de} EUR", [de]), ("IBAN DE88370400440532013000 EUR 5", []), (f"bank DE12 {de}", [de]), ("IBAN " + "AB12 " * 3000, []),
    ]
    got = {r.doc_id: r.iban for r in find(docs_of([(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, want) in enumerate(cases):
        assert [x.m for x in got[i]] == want, text
        assert all(text[x.s : x.e] == x.m for x in got[i])


def test_odd_rows(odd_docs, docs_of):
    assert digests(odd_docs).count() == odd_docs.count()
    assert digests(docs_of([])).count() == 0
    assert "Python" not in digests(odd_docs)._jdf.queryExecution().toString()
