"""Token counts per document by a two-tier lookup inside the map tasks.

A text is cut at ASCII white space, which no token of the vocabulary crosses (the tokenizer
drops white space before it applies its merges), so a text's token count is the sum over
its pieces. Tier one is a broadcast table of the lengths of the corpus's frequent
pieces: a first pass lets each task count its pieces in a bounded table and send its
most frequent ones, of which the best are encoded once on the driver; the table only saves
time, no result depends on it. Tier two is a cache in each Python worker, which lives on from
task to task, for pieces and for the words in them: a piece of letters and closing punctuation has
the tokens of the word and those of the punctuation, as the tokenizer parts letters from
other characters before its merges. What is in neither tier is encoded together per batch
and kept up to ``cache_entries``. No piece is ever shuffled for counting.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give equal rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048
FREQUENT = 65_536
FREQUENT_PER_TASK = 1024
CACHE_ENTRIES = 600_000
#: Longer pieces are encoded whenever they come, so that a table entry stays small.
PIECE_BYTES = 64
BATCH_BYTES = 4 << 20

#: Characters after a word that are no letters, digits, apostrophes or parts of a special string.
CLOSING = b".,;:!?%&*#$)]}\"/+=-_"

_WORKER: dict[str, tuple] = {}  # one entry per call of count_tokens: tokenizer, lengths of tier one, of pieces, of words


def load_tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(definition)
    t.no_truncation()
    t.no_padding()
    return t


def lengths(tokenizer, pieces: list[bytes]) -> dict[bytes, int]:
    """Token counts of pieces; special strings inside them are the tokenizer's own affair."""
    got = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
    return {p: len(e) for p, e in zip(pieces, got, strict=True)}


def word_parts(piece: bytes) -> tuple[bytes, bytes] | None:
    """(word, closing punctuation) of a piece whose token count is the sum of both, else None.

    ASCII words are lowered, as the tokenizer does, so that all their cases share an entry.
    """
    word = piece.rstrip(CLOSING)
    if word.isalpha():  # of bytes: ASCII letters only
        return word.lower(), piece[len(word):]
    if len(word) < len(piece) and normalize("NFC", word.decode("utf-8", "replace")).lower().isalpha():
        return word, piece[len(word):]  # normal form and lower case leave no mark at its end that would join what follows
    return None


def learn(tokenizer, pieces: list[bytes], known: dict[bytes, int], words: dict[bytes, int]) -> None:
    """Add the lengths of ``pieces`` to ``known``, by their words where they part."""
    parted = {p: w for p in pieces if (w := word_parts(p))}
    new = {x for w in parted.values() for x in w if x}.difference(words)
    whole = [p for p in pieces if p not in parted]
    got = lengths(tokenizer, list(new.union(whole)))
    words.update((x, got[x]) for x in new)
    known.update((p, got[p]) for p in whole)
    known.update((p, words[a] + (words[b] if b else 0)) for p, (a, b) in parted.items())


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8, some megabytes at a time, with the row they begin at."""
    texts, size, begin = [], 0, 0
    for i, t in enumerate(batch.column(column).cast(pa.large_binary())):
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= BATCH_BYTES:
            yield begin, texts
            texts, size, begin = [], 0, i + 1
    if texts:
        yield begin, texts


def frequent_pieces(docs: DataFrame, most: int = FREQUENT, per_task: int = FREQUENT_PER_TASK) -> list[bytes]:
    """The most frequent pieces of all documents, at most ``most``; each task sends at most ``per_task``."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for _, texts in _slices(b, "text"):
                for t in texts:
                    counts.update(t.split())
                if len(counts) > CACHE_ENTRIES:
                    counts = Counter(dict(counts.most_common(CACHE_ENTRIES // 2)))
        top = [(p, n) for p, n in counts.most_common(per_task) if len(p) <= PIECE_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
                                         names=["piece", "n"])

    sent = docs.select("text").mapInArrow(run, "piece binary, n bigint")
    top = sent.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)
    return [bytes(r[0]) for r in top.collect()]  # bounded by ``most`` short pieces


def count_tokens(docs: DataFrame, tokenizer_path: str, token_limit: int = TOKEN_LIMIT, frequent: int = FREQUENT,
                 cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every whole text."""
    spark = docs.sparkSession
    definition = Path(tokenizer_path).read_text(encoding="utf-8")  # on the driver; tasks get it by broadcast
    table = lengths(load_tokenizer(definition), frequent_pieces(docs, frequent))
    shared = spark.sparkContext.broadcast((definition, table))

    call = uuid.uuid4().hex

    def run(batches):
        if call not in _WORKER:
            _WORKER.clear()
            text, first = shared.value
            _WORKER[call] = (load_tokenizer(text), first, dict(first), {})
        tokenizer, first, known, words = _WORKER[call]
        for b in batches:
            n_bytes, n_tokens = [], []
            for _, texts in _slices(b, "text"):
                pieces = [t.split() for t in texts]
                missing = list(set().union(*pieces).difference(known))
                if len(known) + len(missing) > len(first) + cache_entries:
                    known.clear()
                    known.update(first)
                    missing = list(set().union(*pieces).difference(known))
                if len(words) > cache_entries:
                    words.clear()
                learn(tokenizer, missing, known, words)
                n_bytes += map(len, texts)
                n_tokens += [sum(map(known.__getitem__, p)) for p in pieces]
                for p in missing:
                    if len(p) > PIECE_BYTES:
                        del known[p]
                        words.pop((word_parts(p) or (p,))[0], None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > token_limit)
