"""Secrets: all rules as one minimal automaton, one pass over the bytes of every text.

The rules' patterns are reversed, joined and compiled (``automaton``) on the driver; tasks get the transition
arrays by broadcast. A text's UTF-8 bytes are read once from the end to the beginning: the state tells at each
byte which rules have a match that *starts* there. Of a rule's starts the leftmost is taken and followed to
the longest match by the rule's own small automaton; starts inside that match are skipped. A check per
rule (length of the value, a length of the whole) then keeps or drops the match, without another try.

Only hits are followed forward, and a rule's hits do not overlap, so the time grows with the text, also
for one long run of digits or letters.

The three base kinds are those of the contract. ``hex`` is written with its least length, which finds the same runs.
The added kinds have prefixes of their own: tokens of code hosts, chat and payment services, cloud keys, signed web
tokens and private key headers. Offsets are code points, the end exclusive.

Cases: null and empty texts have no spans; repeated rows give equal rows; an empty table gives an empty result;
bytes outside ASCII end every match; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from operator import length_hint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules

BASE_KINDS = ("assign", "access", "hex")


def _long_value(match: bytes) -> bool:
    """Six characters or more behind the separator, its blanks and a quote."""
    sep = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[sep + 1:].lstrip(b" ")
    return len(value) - (value[0] in b"\"'") >= 6


def _at_least(n: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= n


#: Kind, pattern, check of a match.
RULES: tuple[tuple[str, str, Callable[[bytes], bool]], ...] = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", _long_value),
    ("access", r"AKIA[A-Z0-9]+", _at_least(20)),
    ("hex", r"[0-9a-f]{24,}", _at_least(24)),
    ("code_host", r"gh[oprsu]_[A-Za-z0-9]+", _at_least(40)),
    ("chat", r"xox[abprs]-[A-Za-z0-9\-]+", _at_least(20)),
    ("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", _at_least(24)),
    ("cloud", r"AIza[A-Za-z0-9_\-]+", _at_least(39)),
    ("web_token", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", _at_least(40)),
    ("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", _at_least(1)),
)
KINDS = tuple(r[0] for r in RULES)


class Scanner:
    """Spans of texts; built once per task from the compiled arrays."""

    def __init__(self, starts: Automaton, rules: list[Automaton], checks: list[Callable[[bytes], bool]]):
        self.start = starts.rows()[0]
        self.rules = [(rows[0], rows[a.dead()]) for a in rules for rows in [a.rows()]]
        self.checks = checks

    def longest(self, rule: int, data: bytes, at: int) -> int:
        (row, dead), end = self.rules[rule], at
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is dead:
                break
            if row[256]:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        row, hits, rest = self.start, [], reversed(data)
        for b in rest:
            row = row[b]
            if row[256]:
                hits.append((length_hint(rest), row[256]))  # the bytes not read yet are those before this one
        out, done = [], defaultdict(int)
        for start, mask in reversed(hits):
            for r, check in enumerate(self.checks):
                if mask >> r & 1 and start >= done[r]:
                    done[r] = self.longest(r, data, start)
                    if check(data[start:done[r]]):
                        out.append((start, r, done[r]))
        return out


def compiled(rules=RULES) -> tuple[Automaton, list[Automaton]]:
    """The automaton of all starts, read from the end of a text, and one of each rule."""
    patterns = [p for _, p, _ in rules]
    return compile_rules(patterns, backward=True), [compile_rules([p], anywhere=False) for p in patterns]


def spans_of(scanner: Scanner, text: str | None, kinds=KINDS) -> list[dict]:
    """Spans of one text in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = scanner.spans(data)
    if len(data) == len(text or ""):
        return [{"kind": kinds[r], "start": s, "end": e} for s, r, e in found]
    out, at, chars = [], 0, 0
    for s, r, e in found:  # matches are ASCII: only what lies before them needs counting
        chars += sum(b & 0xC0 != 0x80 for b in data[at:s])
        at = s
        out.append({"kind": kinds[r], "start": chars, "end": chars + e - s})
    return out


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, rules=RULES, id_col: str = "doc_id") -> DataFrame:
    """(id, spans): every span of every whole text, by start, then kind in the order of the rules."""
    starts, single = compiled(rules)
    shared = docs.sparkSession.sparkContext.broadcast((starts, single))  # some hundred kilobytes of transitions
    kinds, checks = tuple(r[0] for r in rules), [r[2] for r in rules]

    def run(batches):
        scanner = Scanner(*shared.value, checks)
        for b in batches:
            spans = [spans_of(scanner, t.as_py(), kinds) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPAN)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), "text")
            .mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("id", id_col))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
