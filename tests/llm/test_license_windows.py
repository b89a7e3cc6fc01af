"""Licences inside longer text: windows over the words of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from tillwise.llm import licenses

PROSE = "the river runs past old mills and quiet farms where people sell fruit in summer and mend their boats in winter".split()


def prose(r, n):
    return " ".join(r.choice(PROSE) for _ in range(n))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_w", "t", "p", "grams", "license")})
    return [tuple(r["licenses"]) for r in sorted(licenses.scan(df.repartition(3)).collect(), key=lambda r: r["doc_id"])]


def test_every_template_inside_running_prose(spark):
    r = random.Random(4)
    texts = [f"{prose(r, 60)} {text} {prose(r, 80)}" for _, text in licenses.TEMPLATES]
    got = found(spark, texts)
    assert [name in g for (name, _), g in zip(licenses.TEMPLATES, got, strict=True)] == [True] * len(texts)
    assert all(set(g) == {name} for (name, _), g in zip(licenses.TEMPLATES, got, strict=True))


def test_notices_over_several_paragraphs_of_a_longer_document(spark):
    r = random.Random(5)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "gpl-3.0" and t.startswith("This program"))
    words = gpl.split()
    parts = [" ".join(words[:30]), " ".join(words[30:55]), " ".join(words[55:])]
    apart = "\n\n".join([prose(r, 200), *parts, prose(r, 200)])
    wrapped = prose(r, 50) + "\n" + "\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7)) + "\n" + prose(r, 50)
    changed = " ".join(w if i % 25 else w + "x" for i, w in enumerate(words))
    assert found(spark, [apart, wrapped, f"{prose(r, 30)} {changed} {prose(r, 30)}"]) == [("gpl-3.0",)] * 3


def test_scattered_words_of_a_licence_are_none(spark):
    r = random.Random(6)
    mit = next(t for n, t in licenses.TEMPLATES if n == "mit" and len(t) > 100)
    scattered = " ".join(f"{a} {b} {prose(r, 6)}" for a, b in zip(mit.split(), mit.split()[1:], strict=False))
    assert found(spark, [scattered, prose(r, 500), "", "released", None]) == [()] * 5


@pytest.mark.parametrize("n", [1, 40])
def test_repeated_and_long_texts(spark, n):
    text = ("plain words here. Released under the MIT License. more of them " * n + "word " * 30_000) * 2
    assert found(spark, [text, text]) == [("mit",)] * 2
