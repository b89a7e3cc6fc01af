"""Helpers that run without Spark, against plain rewritings of their contracts."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import licenses, pii, quality_rules, simhash, tokens, warc

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("alphabet", ["a.@1-", "12 .-", "+1 ().-2", "0123456789 -.", "ab@.é1", "4111 -"])
def test_base_spans_equal_the_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(t) if s["kind"] in pii.BASE_KINDS]
        assert got == plain_spans(t)


def test_added_spans_need_checksum_or_context():
    found = {s["kind"]: s for s in pii.spans_of("pay to IBAN DE89 3704 0044 0532 0130 00 NOW please")}
    assert found["iban"]["start"] == 12 and found["iban"]["end"] == 39 and found["iban"]["score"] == 1.0
    assert not any(s["kind"] == "iban" for s in pii.spans_of("DE88370400440532013000"))
    assert [s["kind"] for s in pii.spans_of("her ssn is 123-45-6789.")] == ["ssn"]
    assert pii.spans_of("part 123-45-6789.") == []
    assert pii.spans_of(None) == pii.spans_of("") == []


@pytest.mark.parametrize("text, want", [
    ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("INV AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("AB12 CD34 EF56 DE89370400440532013000 X", ["DE89370400440532013000"])])
def test_ibans_next_to_each_other_and_after_codes(text, want):
    assert [text[s["start"]:s["end"]] for s in pii.spans_of(text) if s["kind"] == "iban"] == want


def test_iban_groups_take_linear_time():
    assert pii.spans_of("AB12 " * 40_000) == []


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000 + "@", "+" * 200_000, "1.1" * 80_000, "@" * 200_000, "a@a" * 50_000])
def test_long_runs_take_linear_time(text):
    pii.spans_of(text)


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\x0b\x1c#é ", max_size=90))
def test_measures_equal_the_contract(text):
    assert quality_rules.measure(text)[:5] == plain_measures(text)


def test_measures_of_null_are_zero():
    assert set(quality_rules.measure(None)) == {0}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBÉ \nc ", max_size=60))
def test_fingerprint_equals_the_contract(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_forest_connects_what_links_connect():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    a = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in r.integers(0, 63, 12)]))
    u, v = simhash._forest(a, a, 2)
    root = {int(x): int(x) for x in a}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        root[find(x)] = find(y)
    want = {int(x): int(x) for x in a}
    for x in a.tolist():
        for y in a.tolist():
            if (x ^ y).bit_count() <= 2:
                lo, hi = sorted((want[x], want[y]))
                want = {k: lo if p == hi else p for k, p in want.items()}
    assert all((find(x) == find(y)) == (want[x] == want[y]) for x in root for y in root)
    assert len(u) <= len(a)


def test_tile_steps_cover_half_of_the_near_tiles():
    steps = simhash._neighbours(2)
    assert len(steps) == 21 and len({tuple(map(abs, s)) for s in steps}) > 4
    assert all(tuple(-x for x in s) not in steps for s in steps if any(s))


def test_warc_record_round_trip():
    body = "é<p>\r\n\r\nWARC/1.1</p>".encode()
    member = warc.encode_record(7, "http://a.b/ü\n?q=1", body, "d" * 64)
    fields, http, payload = warc.decode_record(member)
    assert payload == body and fields["WARC-Type"] == "response" and "\n" not in fields["WARC-Target-URI"]
    again = warc.encode_record(9, None, body, "d" * 64, refers_to=7, revisit=True)
    fields, http, payload = warc.decode_record(again)
    assert payload == b"" and fields["WARC-Refers-To"] == "<urn:tillwise:page:7>" and "WARC-Target-URI" not in fields
    both = zlib.decompressobj(31)
    assert both.decompress(member + again).endswith(b"\r\n\r\n") and both.unused_data == again


def test_ranges_coalesce_neighbours_only():
    rows = [{"archive": a, "offset": o, "length": n} for a, o, n in
            [("x", 0, 10), ("x", 10, 5), ("x", warc.READ_GAP + 16, 1), ("y", 0, 4), ("y", 4, warc.READ_BYTES)]]
    assert [len(g) for g in warc._ranges(rows)] == [2, 1, 1, 1]


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return tokens.load_tokenizer(f.read())


def test_token_counts_add_up_over_pieces():
    t, r = tokenizer(), random.Random(2)
    for _ in range(3000):
        x = "".join(r.choice("ab. ,\"!?ABé-_)É́e  \x1c\x85\t\n'sré1٣<|endoftext|>ΣςİK中文😀 ") for _ in range(r.randint(0, 30)))
        x += r.choice(["", "<|endoftext|>", " <|startoftext|>x", "a<|endoftext|>'s "])
        pieces = x.encode().split()
        got, words = {}, {}
        tokens.learn(t, sorted(set(pieces)), got, words)
        assert sum(got[p] for p in pieces) == len(t.encode(x, add_special_tokens=False).ids)


def test_every_template_is_most_like_its_own_licence():
    grams = [set(licenses.template_bigrams(t)) for _, t in licenses.TEMPLATES]
    assert all(grams)
    for i, a in enumerate(grams):
        best = max(range(len(grams)), key=lambda j: 2 * len(a & grams[j]) / (len(a) + len(grams[j])))
        assert licenses.TEMPLATES[best][0] == licenses.TEMPLATES[i][0]


def test_words_part_from_closing_punctuation():
    t, r = tokenizer(), random.Random(8)
    for _ in range(4000):
        word = "".join(r.choice("abcXYZéÉßΣςİß中́") for _ in range(r.randint(1, 8)))
        piece = (word + "".join(r.choice(tokens.CLOSING.decode()) for _ in range(r.randint(0, 4)))).encode()
        got = {}
        tokens.learn(t, [piece], got, {})
        assert got[piece] == len(t.encode(piece.decode(), add_special_tokens=False).ids), piece
