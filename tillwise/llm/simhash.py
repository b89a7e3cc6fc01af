"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint sets a bit where over half the hashes of its word shingles do. Equal
fingerprints are grouped first. Fingerprints are then dealt to tiles by the population
counts of their four 16-bit quarters. Two fingerprints within ``radius`` bits have quarter counts
that differ by ``radius`` in all at most, so only tile pairs within that distance
are compared and all others are skipped, without losing a link. A tile is cut
into blocks of about ``block`` fingerprints; a pair of blocks is one row for a task, which
compares them by numpy exclusive-or and bit counts and sends a spanning forest of the
links it finds, so a dense group gives as many rows as it has fingerprints and not
their square. Components are joined from these edges.

Cases: null and word-free texts have fingerprint zero, which links like any other; rows
with a null doc_id are linked but do not name a component unless it has no other; repeated rows
share a component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import islice, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
BLOCK = 1024
QUARTERS, QUARTER_BITS = 4, 16


def fingerprint(text: str | None, n_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the XXH64 hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n_words)), strict=False)) if len(words) >= n_words else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(s, HASH_SEED) for s in shingles)
    ones, n = np.zeros(64, dtype=np.int64), 0
    while len(h := np.fromiter(islice(hashes, 1 << 16), dtype="<u8")):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the linked fingerprints of two blocks, at most one per fingerprint."""
    at, other = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    apart = a[at] != b[other]
    u, v = a[at[apart]], b[other[apart]]
    if not len(u):
        return u, v
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    pu, pv = place[:len(u)], place[len(u):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[pu], root[pv])
        new = root.copy()
        np.minimum.at(new, pu, least)
        np.minimum.at(new, pv, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite steps between tiles whose counts differ by ``radius`` at most, and the step to itself."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in steps if d >= (0,) * QUARTERS]


def _tile(fp: Column) -> Column:
    side = QUARTER_BITS + 1
    counts = [F.bit_count(F.shiftrightunsigned(fp, QUARTER_BITS * q).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1)))
              for q in range(QUARTERS)]
    return sum((c * side ** q for q, c in enumerate(counts)), F.lit(0)).cast("int")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within ``radius`` bits of each other."""
    side = QUARTER_BITS + 1
    tiled = fps.select("fp", _tile(F.col("fp")).alias("tile"))
    counts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("bigint").alias("n_blocks"))  # 17**4 rows at most
    blocks = write_shared(
        tiled.join(F.broadcast(counts), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")))
        .groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")
    digits = [F.floor(F.col("tile") / side ** q).cast("int") % side for q in range(QUARTERS)]
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{q}") for q, x in enumerate(d)]) for d in _neighbours(radius)])
    stepped = (blocks.select(F.col("tile").alias("home"), F.col("block").alias("home_block"), F.col("fps").alias("a"),
                             *[d.alias(f"p{q}") for q, d in enumerate(digits)], F.explode(steps).alias("d")))
    for q in range(QUARTERS):
        stepped = stepped.where((F.col(f"p{q}") + F.col(f"d.d{q}")).between(0, QUARTER_BITS))
    to = sum(((F.col(f"p{q}") + F.col(f"d.d{q}")) * side ** q for q in range(QUARTERS)), F.lit(0)).cast("int")
    pairs = (stepped.withColumn("tile", to).join(blocks.select("tile", "block", F.col("fps").alias("b")), "tile")
             .where("home != tile OR home_block <= block").select("a", "b"))

    def run(batches):
        for batch in batches:
            u, v = [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = _forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
                u.append(x)
                v.append(y)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (u, v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _rooted(docs: DataFrame, n: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, least_id, root) of every distinct fingerprint."""
    doc_fp = write_shared(fingerprints(docs, n), "simhash-fingerprints")
    fps = doc_fp.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    fps = write_shared(fps, "simhash-distinct")
    parts = connected_components(links(fps, radius), "simhash-components")
    return doc_fp, write_shared(fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
                                .select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id that is reachable over links."""
    doc_fp, rooted = _rooted(docs, n, radius)
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return (doc_fp.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the first by doc_id, then text hash; of equal ones the first as JSON.

    A component without any doc_id stays whole.
    """
    doc_fp, rooted = _rooted(docs, n, radius)
    keys = (doc_fp.join(rooted.select("fp", "root"), "fp").groupBy("root", "doc_id", "text_hash")
            .agg(F.count("*").alias("copies")))
    first = keys.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    is_first = F.struct("doc_id", "text_hash").eqNullSafe(F.col("first"))
    # all but the rows that stay as they are: few, and nothing but keys
    marked = write_shared(keys.join(first, "root").where(~is_first | (F.col("copies") > 1))
                          .select(F.col("doc_id").alias("_g_id"), F.col("text_hash").alias("_g_hash"), is_first.alias("_g_first")),
                          "simhash-marked")
    on = docs["doc_id"].eqNullSafe(F.col("_g_id")) & (F.xxhash64(docs["text"]) == F.col("_g_hash"))
    row = F.struct(*[docs[c] for c in docs.columns])
    repeated = (docs.join(marked.where("_g_first"), on).groupBy("_g_id", "_g_hash")
                .agg(F.min_by(row, F.to_json(row)).alias("_g_row")).select("_g_row.*"))
    return docs.join(marked, on, "left_anti").union(repeated)
