"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Patterns propose e-mail addresses, IPv4 addresses, card numbers, phone numbers, IBANs
and US social security numbers over the whole text. Range, Luhn, digit-count and
mod-97 checks confirm a proposal or drop it. A confirmed span has a base score per
kind; a context word of its kind within ``CONTEXT_CHARS`` raises it. The four base
kinds always stay; the added kinds stay at ``min_score`` or more.

Offsets are code points, the end exclusive. The patterns never go back over a run
of characters that they have read, so the time grows with the text even for one long run
of digits or letters.

Cases: null and empty texts have no spans; repeated rows give equal rows; an empty table
gives an empty result; other columns pass through untouched where a function says so and are
ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, base scores, and words that speak for a kind.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
MIN_SCORE = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        while True:  # the next capital letters may be another word: cut at the last blank
            got = text[start:end].replace(" ", "")
            if len(got) >= 15 and mod97(got):
                yield start, end
                at = end
                break
            if (end := text.rfind(" ", start, end)) < 0:  # none: go on with the next group, which this proposal may have read
                at = text.find(" ", start, m.end()) + 1 or m.end()
                break
        m = _IBAN.search(text, at)


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind."""
    if "@" in text:
        yield from (("email", *x) for x in _emails(text))
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", *x) for x in _ibans(text))
    yield from (("ssn", m.start(), m.end()) for m in _SSN.finditer(text))


def spans_of(text: str | None, min_score: float = MIN_SCORE) -> list[dict]:
    """Spans of one text by start, then kind."""
    out = []
    for kind, start, end in propose(text or ""):
        near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
        score = BASE_SCORE[kind] + CONTEXT_BONUS * any(w in near for w in CONTEXT_WORDS[kind])
        if kind in BASE_KINDS or score >= min_score:
            out.append({"kind": kind, "start": start, "end": end, "score": min(1.0, score)})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """(id, spans): every span of every whole text."""

    def run(batches):
        for b in batches:
            spans = [spans_of(t.as_py(), min_score) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPAN)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), "text")
            .mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
            .withColumnRenamed("id", id_col))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
