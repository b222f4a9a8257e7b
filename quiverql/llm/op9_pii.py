"""Personal data: patterns propose spans, checks confirm them, nearby words adjust a score.

Built from SQL functions only: one narrow projection per batch of rows, no
shuffle and no Python on the executors. Positions come from splitting a text
at the very matches that are extracted: the lengths of the gaps and of the
matches add up to code-point offsets.

The patterns are written so that a scan is linear in the text: quantifiers are
possessive where the next character cannot belong to them, and a run is only
entered at its start (or where the match before ended), which gives the same
leftmost non-overlapping matches. An account number may be followed by
capitals or digits after a space, so its pattern proposes the start only; it
ends at a word's end within the longest number, at the length of its country
if the check digits hold there, else at the last word for which they hold; one
that begins within the account number before it does not count. Secrets (keys,
tokens, passwords) are long runs of mixed characters, kept where a word nearby
says so.

Defined results: a null text counts as empty and has no spans; repeated rows
give repeated results; texts are scanned whole; columns other than ``doc_id``
and ``text`` are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_texts

#: Kinds of the base rules, in output order, then the kinds that this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")

#: The base rules' patterns, in linear form.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]", "iban": "[0-9]{2}", "ssn": "-", "secret": "(?i)token|secret|key|passw|credential"}
#: Fewest and most characters of an account number without spaces, and how many those of a country have.
IBAN_LEAST, IBAN_MOST = 15, 34
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
        "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
#: Different characters that a secret has at least.
VARIETY = 10
#: Matches whose offsets are summed together.
BLOCK = 256
#: Score of a confirmed span before its context is looked at; of the added kinds those that reach KEEP stay.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
KEEP, WORDS_UP, WORDS_DOWN = 0.6, 0.2, 0.3
#: Characters on either side that count as context, and code points of the pieces in which a text is looked up.
NEAR, PIECE = 48, 256
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|client|address",
    "card": "card|visa|master|credit|payment|cvv",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|swift|transfer",
    "ssn": "ssn|social|security|tax",
    "secret": "token|secret|api.?key|key|passw(?:or)?d|credentials?",
}
AGAINST = "version|isbn|example only|order no|serial"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(each, lambda c: c != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (without spaces) passes the mod-97 check."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda r, c: F.when(code(c) >= 65, (r * 100 + code(c) - 55) % 97).otherwise((r * 10 + code(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":  # letters and digits, and many different ones
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= VARIETY)
    return F.lit(True)


SPANS = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def proposed(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``doc_id``, ``text`` and for each kind all matches: array of (s, e, m), offsets in code points.

    Offsets are running sums. They are taken in blocks of matches, then over the
    blocks, so the work stays nearly linear in the number of matches. Each step
    is a projection of its own, as what an expression names twice is else
    computed twice.
    """

    def step(df: DataFrame, make) -> DataFrame:
        return df.select("doc_id", "text", *(make(k, F.col(k)).alias(k) for k in kinds))

    text = F.col("text")
    found = df.select("doc_id", "text", *(F.when(text.rlike(NEEDS[k]), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")).alias(k) for k in kinds))

    def with_gaps(kind: str, m: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("g"), x.alias("m")))
        return F.when(F.size(m) > 0, pairs)

    def in_blocks(kind: str, pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        sized = F.transform(blocks, lambda x: F.struct(x.alias("x"), F.aggregate(x, F.lit(0), lambda a, p: a + p["g"] + F.length(p["m"])).alias("n")))
        return F.when(F.size(pairs) > 0, sized)

    def placed(kind: str, blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["n"])))
        return F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), lambda x, at: F.struct(at.alias("at"), x["x"].alias("x")))

    def add(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).alias("out"))

    def spans(kind: str, blocks: Column) -> Column:
        each = F.transform(blocks, lambda x: F.aggregate(x["x"], F.struct(x["at"].alias("at"), F.expr(SPANS).alias("out")), add, lambda acc: acc["out"]))
        return F.coalesce(F.flatten(each), F.expr(SPANS))

    return step(step(step(step(found, with_gaps), in_blocks), placed), spans)


def cut(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def stretch(pieces: Column, begin: Column, size: Column | int) -> Column:
    """``size`` code points (at most PIECE) from ``begin``, without counting from the start of the text."""
    first = F.floor(begin / PIECE).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, F.lit(2)), ""), begin - first * PIECE + 1, F.lit(size) if isinstance(size, int) else size)


def accounts(pieces: Column, starts: Column) -> Column:
    """Account numbers that begin at ``starts``: array of (s, e, m)."""
    fixed = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    # one step after the other, as what a lambda names twice is computed twice; ``near`` reaches one character past the longest number
    near = F.transform(starts, lambda x: F.struct(x["s"].alias("s"), stretch(pieces, x["s"], 2 * IBAN_MOST).alias("near")))
    runs = F.transform(near, lambda x: x.withField("run", F.length(F.regexp_extract(x["near"], r"^[A-Z0-9]++(?: [A-Z0-9]++)*+", 0))))
    runs = F.filter(runs, lambda x: x["run"] >= IBAN_LEAST)

    def heads(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(IBAN_LEAST), x["run"]), lambda p: F.substr(x["near"], p, F.lit(2)).rlike("^[A-Z0-9]([^A-Za-z0-9]|$)"))
        all_heads = F.transform(places, lambda p: F.substr(x["near"], F.lit(1), p))
        bare = F.transform(all_heads, lambda m: F.struct(m.alias("m"), F.replace(m, F.lit(" "), F.lit("")).alias("bare")))
        return F.filter(bare, lambda y: F.length(y["bare"]).between(IBAN_LEAST, IBAN_MOST) & mod97(y["bare"]))

    good = F.transform(runs, lambda x: F.struct(x["s"].alias("s"), heads(x).alias("heads")))
    good = F.filter(good, lambda x: F.size(x["heads"]) > 0)

    def chosen(x: Column) -> Column:
        own = F.filter(x["heads"], lambda y: F.length(y["bare"]) == fixed[F.substring(y["bare"], 1, 2)])
        return F.coalesce(F.get(own, F.lit(0)), F.element_at(x["heads"], -1))["m"]

    found = F.transform(good, lambda x: F.struct(x["s"].alias("s"), chosen(x).alias("m")))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))


def apart(spans: Column) -> Column:
    """Spans that do not begin within the one before them."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    return F.transform(F.filter(F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda y: y["x"]["s"] >= y["e"]), lambda y: y["x"])


def _score(kind: str, pieces: Column, span: Column) -> Column:
    begin = F.greatest(span["s"] - NEAR, F.lit(0))
    near = F.lower(F.concat(stretch(pieces, begin, span["s"] - begin), F.lit(" "), stretch(pieces, span["e"], NEAR)))
    up = F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), WORDS_UP).otherwise(0.0)
    down = F.when(near.rlike(rf"\b(?:{AGAINST})\b"), WORDS_DOWN).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + up - down))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, for each kind, an array of its confirmed spans (s, e, m, score).

    Base kinds keep every confirmed span; added kinds only those whose score,
    after the words nearby are counted, reaches ``KEEP``.
    """
    df = document_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    df = proposed(df, kinds)

    def good(kind: str) -> Column:
        return accounts(F.col("pieces"), F.col(kind)) if kind == "iban" else F.filter(F.col(kind), lambda x: confirmed(kind, x["m"]))

    def scored(kind: str) -> Column:
        spans = apart(F.col(kind)) if kind == "iban" else F.col(kind)
        spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _score(kind, F.col("pieces"), x).alias("score")))
        return spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= KEEP)

    some = F.greatest(*(F.size(k) for k in kinds)) > 0
    df = df.select("doc_id", F.when(some, cut(F.col("text"))).alias("pieces"), *kinds)
    df = df.select("doc_id", "pieces", *(good(k).alias(k) for k in kinds))
    return df.select("doc_id", *(scored(k).alias(k) for k in kinds))


def redact(docs: DataFrame) -> DataFrame:
    """``doc_id`` and every span as a row: kind, start, end, score, match."""
    spans = find(docs)

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["score"].alias("score"), x["m"].alias("match")))

    return spans.select("doc_id", F.explode(F.concat(*map(tagged, (*BASE_KINDS, *ADDED_KINDS)))).alias("x")).select("doc_id", "x.*")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans, SHA-256 of their listing, and the listing of all spans."""

    def listing(kinds: tuple[str, ...]) -> Column:
        def part(kind: str) -> Column:
            return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

        return F.array_join(F.concat(*map(part, kinds)), ",")

    return find(docs).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(listing(BASE_KINDS), 256).alias("base_sha256"),
        listing((*BASE_KINDS, *ADDED_KINDS)).alias("spans"),
    )
