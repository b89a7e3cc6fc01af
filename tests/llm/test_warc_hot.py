"""WARC archives of hot bodies, repeated rows and very long pages, with revisits broadcast and shuffled."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tillwise.llm import warc


def pages(spark):
    hot = "<html>" + "the same body " * 40 + "</html>"
    rows = [(i, f"http://h/{i}", hot if i % 2 else f"<p>page {i} " + "x" * (i % 300) + "</p>") for i in range(600)]
    rows += [(5000, "http://long", "é" * 1_500_000), (5001, "http://long2", "é" * 1_500_000), (7, "http://again", hot), (7, "http://again", hot),
             (None, None, hot), (None, None, None), (6000, "http://e", "")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("most", [200_000, 0])
def test_half_of_the_pages_share_a_body(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", most)
    rows, df = pages(spark)
    got = warc.read_records(warc.write_archives(df.repartition(7).withColumn("payload", F.lit(1)))).collect()
    first = {}
    for i, _, h in rows:
        d = (h or "").encode()
        if len(d) >= 100 and i is not None:
            first[d] = min(first.get(d, i), i)
    want = []
    for i, u, h in rows:
        d = (h or "").encode()
        other = len(d) >= 100 and d in first and first[d] != i and sum((x[2] or "").encode() == d for x in rows) > 1
        want.append((i, u, "revisit" if other else "response", first[d] if other else None, len(d), hashlib.sha256(d).hexdigest()))
    have = [tuple(r[c] for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_few_revisits_move_no_payload(spark):
    _, df = pages(spark)
    plan = warc.with_types(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
