"""Ranked lexical search: bounds, brute force over all documents, waves and batches of all sizes, oracle SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import queries, ranked_search

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"
ITEMS = "item_id long, text string"


def words(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def plain(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t, *_ in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words(text))
    for item, ts in terms.items():
        scores = []
        for i, c, size in counts:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["the", "É", "été", "Zebra", "x1"] + [f"w{i}" for i in range(400)]

    def text(k):
        return " ".join(vocab[int(len(vocab) * r.random() ** 2)] for _ in range(k))

    docs = [(i, text(r.choice([1, 3, 30, 80, 200])), "en") for i in range(n)]
    docs += [(10_000 + i, docs[5][1], "en") for i in range(60)] + [(20_000 - i, docs[6][1] + " tail", "en") for i in range(30)]
    docs += [docs[7], docs[7], (None, docs[8][1], None), (None, None, None), (30_000, "", "en"), (30_001, "., !", "en"), (30_002, "the " * 90_000, "en")]
    items = [(i, text(12)) for i in range(12)] + [(12, docs[5][1]), (13, docs[6][1]), (14, docs[7][1]), (15, docs[8][1]), (16, "the"), (17, None),
                                                  (18, "nowhere found"), (0, "zebra w3"), (0, "zebra w3"), (None, "w1 w2 été"), (19, " ,.")]
    return docs, items


@pytest.mark.parametrize("seed,wave,batch,k", [(1, 40, 1024, 10), (2, 3, 6, 3), (3, 10, 1024, 10)])
def test_search_equals_brute_force(spark, seed, wave, batch, k):
    docs, items = corpus(seed, 500)
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("z") for c in ("h1", "h2", "n", "cells", "id", "_id", "item", "rank", "score")})
    got = ranked_search.search(df.repartition(4), spark.createDataFrame(items, ITEMS), k=k, wave=wave, batch_items=batch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collected(got) == plain(docs, items, k)


def test_narrow_sketches_give_loose_bounds_and_the_same_result(spark, monkeypatch):
    docs, items = corpus(4, 400)
    df, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    index = ranked_search.build_index(df)
    # cells at their limit in every place: every text has a bound for every item, so that waves do all the work
    full = index._replace(sketches=index.sketches.withColumn("cells", F.expr("unhex(repeat('FF', 32))")))
    got = collected(ranked_search.search(df, q, index=full, wave=10))
    assert got == plain(docs, items) == collected(ranked_search.search(df, q, index=index, wave=10))


def test_items_that_end_early_are_not_opened_again(spark, monkeypatch):
    docs = [(i, f"common word{i % 7} " + "filler " * (i % 50), "en") for i in range(900)]
    items = [(0, "common"), (1, "word3 word4"), (2, "filler common word1"), (3, "common word0 word1 word2")]
    df, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    index = ranked_search.build_index(df)
    full = index._replace(sketches=index.sketches.withColumn("cells", F.expr("unhex(repeat('FF', 32))")))
    calls = []
    plain_scores = ranked_search.exact_scores
    monkeypatch.setattr(ranked_search, "exact_scores", lambda d, w, i, s: calls.append(w.count()) or plain_scores(d, w, i, s))
    monkeypatch.setattr(ranked_search, "GROWTH", 3)
    some = full._replace(sketches=full.sketches.where("n > 20").unionByName(index.sketches.where("n <= 20")))
    assert collected(ranked_search.search(df, q, index=some, wave=12)) == plain(docs, items)
    assert 2 < len(calls) < 9 and sum(calls) <= len(items) * len(docs)


def test_bounds_are_never_below_the_scores():
    r = random.Random(8)
    terms = [f"t{i}".encode() for i in range(300)]
    items = ranked_search.Items(list(range(20)), terms, [r.randrange(0, 20_000) for _ in terms],
                                [np.array(sorted(r.sample(range(300), r.randint(0, 40))), dtype=np.int64) for _ in range(20)])
    for size in (1, 4, 40, 3000):
        texts = [Counter(r.choices(terms + [f"o{i}".encode() for i in range(200)], k=size)) for _ in range(30)]
        texts = [c for c in texts if len(ranked_search.sketch(c)) == len(ranked_search.sketch(texts[0]))]
        m = [ranked_search.length_norm(c.total(), 1000, 90_000) for c in texts]
        bounds = ranked_search.block_bounds([ranked_search.sketch(c) for c in texts], np.array(m, dtype=np.float64), items, ranked_search.hashes(terms))
        tight = 0
        for q, places in enumerate(items.places):
            for i, c in enumerate(texts):
                score = sum(items.weights[p] * ranked_search.impact(c[terms[p]], m[i]) for p in places.tolist() if c[terms[p]])
                assert bounds[q][i] >= score
                tight += bounds[q][i] <= 1.2 * score + 10 ** 6
        assert tight > 0.5 * len(items.places) * len(texts)


def test_empty_tables(spark):
    docs, items = corpus(5, 20)
    df, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert ranked_search.search(df.where("false"), q).collect() == [] == ranked_search.search(df, q.where("false")).collect()
    assert ranked_search.search(df.where("text = ''"), q).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLE["op11_ranked_search"])
    assert [d[0] for d in cur.description] == ["item_id", "rank", "doc_id", "score"]
    got = collected(queries.QUERIES["op11_ranked_search"](spark, SF))
    assert got == sorted(cur.fetchall(), key=repr) and len(got) == 400
