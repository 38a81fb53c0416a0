"""Personal data: expressions propose, checksums confirm, context scores.

Every kind has an expression that proposes spans in time linear in the text.
Card numbers must pass Luhn, IBANs mod 97, addresses and numbers their ranges.
A confirmed span starts from its kind's score; context words within
``CONTEXT`` code points raise or lower it. The four base kinds (email, ip,
card, phone) are always reported; the further kinds (iban, ssn) only with a
score of ``THRESHOLD`` or more.

Spans are in code points, end exclusive, leftmost and non-overlapping within a
kind; an expression's match that fails its check is dropped, not retried.

Defined cases: a null text counts as empty; rows are judged one by one, so
repeated rows give repeated results; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT, THRESHOLD = 48, 0.5

#: Start score by kind, and words nearby that change it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISE = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
REDUCE = {"ip": ("version", "release"), "card": ("order", "isbn", "serial", "tracking"), "phone": ("order", "serial"), "iban": ("serial",), "ssn": ("order", "part", "serial"), "email": ()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match cannot begin inside a run of digits: the run's start would match too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + int(c)) % 97 if c.isdigit() else (rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is the whole run
    before it (back to the end of the match before), so no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, by kind and start."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


_WORDS = re.compile(r"[a-z]+")


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORDS.findall((text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()))
    value = SCORES[kind] + 0.3 * any(w in near for w in RAISE[kind]) - 0.3 * any(w in near for w in REDUCE[kind])
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by kind as listed, then start."""
    if not text:
        return []
    scored = ((k, s, e, score(text, k, s, e)) for k, s, e in propose(text))
    return [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]


SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
SPANS_DDL = "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS.field(1).type)], schema=SPANS)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and an array of scored spans per input row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SPANS_DDL)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by ``<KIND>``; overlaps merge."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def brute(text: str | None) -> tuple[list[int], str]:
    """Base kinds by plain expressions: counts and digest, for tests."""
    text = text or ""
    spans, counts = [], []
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in plain.items():
        kept = []
        for m in re.finditer(pattern, text):
            d = _digits(m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            kept.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(kept))
        spans += kept
    return counts, hashlib.sha256(",".join(spans).encode()).hexdigest()
