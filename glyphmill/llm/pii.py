"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Base kinds (email, ip, card, phone) are reported whenever their pattern and
validator accept; further kinds (iban: mod-97; ssn: context; shortcard: 13 to 15 digits with an
issuer's first digits passing Luhn) only from a score
of ``MIN_SCORE``.  Spans are code point offsets, end exclusive.  Null and empty
texts have no spans; each input row gives one row, repeated rows included.

Every pattern is scanned in time linear in the text: local parts are found
from their ``@``, digit runs are possessive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, read
from ._text import binary_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "shortcard")
CONTEXT_CHARS, MIN_SCORE = 48, 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: First digits of issuers of cards of 13 to 15 digits.
_SHORT_CARDS = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37")}

#: The length of an IBAN by country; elsewhere every end of a token is tried.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
        26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in countries.split()
}

#: Words on either side of a span that speak for or against a kind.
CONTEXT = {
    "email": ({"email", "e-mail", "mail", "contact", "write"}, set()),
    "ip": ({"ip", "address", "host", "server", "from"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "mastercard", "credit", "debit", "payment"}, {"order", "invoice", "tracking", "isbn"}),
    "phone": ({"phone", "tel", "call", "mobile", "fax", "whatsapp"}, {"order", "invoice", "part"}),
    "iban": ({"iban", "account", "bank", "konto", "transfer"}, {"part", "serial"}),
    "ssn": ({"ssn", "social", "security"}, {"part", "serial", "order", "isbn"}),
    "shortcard": ({"card", "visa", "amex", "diners", "credit", "debit", "payment"}, {"order", "invoice", "tracking", "isbn"}),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.4, "shortcard": 0.2}
CHECKED, NEAR = 0.3, 0.2


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@``: a local part reaches back to the last match or ``@``."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Non-overlapping IBANs: each ends with the first token that gives its country's length and passes mod-97."""
    floor = 0
    for m in _IBAN.finditer(text):
        if m.start() < floor:
            continue
        most, want = m.end(1), IBAN_LENGTHS.get(m[0][:2])
        for end in range(m.start() + 15, most + 1):
            if text[end - 1] == "\x20" or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            iban = text[m.start() : end].replace("\x20", "")
            if (len(iban) == want if want else len(iban) >= 15) and mod97(iban):
                yield m.start(), end
                floor = end
                break


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans whose validator accepts, and whether that was a checksum."""
    for s, e in _emails(text):
        yield "email", s, e, False
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                yield "ip", *m.span(), False
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[\x20-]", "", m[0])) <= 19 and luhn(d):
                if len(d) >= 16:
                    yield "card", *m.span(), True
                elif d.startswith(_SHORT_CARDS[len(d)]) and text[m.start() - 1 : m.start()] != "+":
                    yield "shortcard", *m.span(), True
        for m in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                yield "phone", *m.span(), False
        for s, e in _ibans(text):
            yield "iban", s, e, True
        for m in _SSN.finditer(text):
            yield "ssn", *m.span(), False


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    """The kind's prior, moved by a checksum and by the words within ``CONTEXT_CHARS`` on either side of the span."""
    around = (text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS])
    near = {w for side in around for w in re.findall("[a-z-]+", side.lower())}
    good, bad = CONTEXT[kind]
    return round(min(1.0, max(0.0, PRIOR[kind] + CHECKED * checked + NEAR * bool(near & good) - NEAR * bool(near & bad))), 3)


def find_pii(text: str) -> list[Span]:
    """All spans by kind as listed in KINDS, then start."""
    found = [Span(k, s, e, score(text, k, s, e, c)) for k, s, e, c in _proposals(text)]
    found = [x for x in found if x.kind in BASE_KINDS or x.score >= MIN_SCORE]
    return sorted(found, key=lambda x: (KINDS.index(x.kind), x.start))


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``spans`` array<struct<kind, start, end, score>>."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in binary_rows(batches, "_text"):
            spans = [[x._asdict() for x in find_pii(t.decode("utf-8", "replace"))] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=[key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), as_bytes(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind string, start long, end long, score double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_spans(read(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return spans.select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def digest(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{x.kind}:{x.start}:{x.end}" for x in find_pii(text) if x.kind in BASE_KINDS).encode()).hexdigest()


def _oracle_sql() -> str:
    """The query's base columns in DuckDB: where its pattern's matches lie follows from what is between them."""
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    luhn_ = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i]::INT ELSE 2 * d[i]::INT - CASE WHEN d[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 999) > 255)) = 0"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"len(d) BETWEEN 16 AND 19 AND {luhn_}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(d) BETWEEN 8 AND 15"),
    )
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS rank, '{name}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, m, string_split({digits("m")}, '') AS d,
            (sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m))::BIGINT AS s FROM (
            SELECT doc_id, rid, generate_subscripts(h, 1) AS i, unnest(h) AS m, unnest(p[1:len(h)]) AS p FROM (SELECT doc_id, rid, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS p FROM docs))) WHERE {test}"""
        for k, (name, pattern, test) in enumerate(kinds)
    )
    count = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), spans AS ({each})
    SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(told, '')) AS base_sha256
    FROM docs LEFT JOIN (SELECT doc_id, {count}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS told FROM spans GROUP BY doc_id) USING (doc_id)"""


#: Base columns only; tests compare the query's with it.
BASE_SQL = _oracle_sql()
