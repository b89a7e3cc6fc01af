"""Source divergence: brute force in plain integers, blocks of all sizes, awkward frames, oracle SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import divergence, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top=10):
    docs = [(x or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")))
            for _, t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, k in df.items() if k >= min_docs}
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            counts[s].update(x for x in w if x in kept)
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            return {w: 1 + 10 ** 9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, got, n in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(got)[:n])]
    return sorted(out)


def rows_of(n, seed, sources=9):
    r = random.Random(seed)
    words = ["the", "É", "été", "Zebra"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(n):
        s = "hot" if r.random() < 0.4 else f"s{r.randrange(sources)}"
        k = min(int(r.expovariate(0.05)), 120)
        rows.append((i, ",".join(words[int(len(words) * r.random() ** 3)] for _ in range(k)), r.choice(["en", "en", "fr", None]), s))
    return rows + [(None, None, None, None), (1, "", "xx", "empty"), (1, "", "xx", "lone"), rows[0], rows[0], (7, "in no group", "yy", "one")]


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("seed,min_docs,block", [(1, 3, 1024), (2, 10, 7), (3, 1, 40)])
def test_audit_equals_plain_integers(spark, seed, min_docs, block):
    rows = rows_of(260, seed)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("z") for c in ("term", "n", "d", "block", "band", "rank", "item", "total")})
    got = collected(divergence.audit(df.repartition(4), min_docs=min_docs, block_terms=block))
    assert got == plain(rows, min_docs)
    assert {x[0] for x in got} >= {"en", "fr", "", "xx"}


def test_more_groups_than_a_block_holds(spark):
    rows = rows_of(700, 4, sources=110)
    df = spark.createDataFrame(rows, DOCS)
    assert collected(divergence.audit(df, min_docs=2, block_terms=30)) == plain(rows, 2)
    blocks = divergence.groups_of(df, divergence.kept_cells(df, 2)).select("block").distinct().count()
    assert blocks > 2


def test_partial_counts_are_sent_whenever_the_table_is_full(spark):
    df = spark.createDataFrame(rows_of(200, 5), DOCS).coalesce(1)
    a, b = (sorted(map(tuple, divergence.partial_counts(df, entries=e).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("d")).collect()))
            for e in (10 ** 6, 50))
    assert a == b and divergence.partial_counts(df, entries=50).count() > len(a)


def test_shares_and_joint_tables_stay_exact_for_large_counts(spark):
    r = random.Random(6)
    totals, terms = [5 * 10 ** 17, 3 * 10 ** 9, 0], 500
    counts = [[r.choice([0, 0, 1, 5, 10 ** 15 + r.randrange(3)]), r.choice([0, 2, 10 ** 8]), 0] for _ in range(200)]
    cells = [(i, g, c) for i, row in enumerate(counts) for g, c in enumerate(row) if c]
    used = sorted({i for i, _, _ in cells})
    got, n = divergence.price_block(["a", "b", "c"], np.array([0, 0, 1]), totals, terms, np.array([used.index(i) for i, _, _ in cells]),
                                    np.array([g for _, g, _ in cells]), np.array([c for _, _, c in cells]))
    want = defaultdict(int)
    for i in used:
        p = [1 + 10 ** 9 * (c + 2) // (t + 2 * terms) for c, t in zip(counts[i], totals, strict=True)]
        for g, h in ((0, 2), (1, 2)):  # of two blocks only the pairs between them
            want["abc"[g], "abc"[h]] += (p[g] - p[h]) ** 2 // (p[g] + p[h])
    assert n == len(used) and {(a, b): v for a, b, v in got} == want
    cols = [F.col(c) for c in ("c", "t", "v")]
    rows = [(c, t, terms) for t in totals for c in (0, 1, 10 ** 15 + 1, 2 * 10 ** 17)]
    out = spark.createDataFrame(rows, "c long, t long, v long").where("c <= t").select("c", "t", divergence.share(*cols).alias("p")).collect()
    assert all(x["p"] == 1 + 10 ** 9 * (x["c"] + 2) // (x["t"] + 2 * terms) for x in out)


def test_empty_and_very_long_texts(spark):
    df = spark.createDataFrame([(1, "Ab " * 300_000, "en", "a"), (2, "é" * 100_000, "en", "b")], DOCS)
    assert collected(divergence.audit(df, min_docs=1)) == plain([tuple(r) for r in df.collect()], 1)
    assert divergence.audit(df.where("false")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(queries.ORACLE["op12_source_divergence"])
    assert [d[0] for d in cur.description] == ["lang", "source", "part", "item", "value", "rank"]
    got = collected(queries.QUERIES["op12_source_divergence"](spark, SF))
    assert got == sorted(cur.fetchall()) and len(got) > 2000
