"""Toxicity: FTRL-proximal against a plain loop, features against their definition, held-out accuracy, defined cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.llm import ftrl_toxicity as ft


def plain_fit(docs, labels, alpha, beta, l1, l2, rounds, seed) -> dict[int, float]:
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= (0 if i == ft.BUCKETS else l1):
            return 0.0
        shrunk = z[i] - math.copysign(0 if i == ft.BUCKETS else l1, z[i])
        return -shrunk / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for d in rng.permutation(len(docs)).tolist():
            at = [*docs[d].tolist(), ft.BUCKETS]
            g = 1 / (1 + math.exp(-sum(weight(i) for i in at))) - labels[d]
            for i in at:
                w, old = weight(i), n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w
    return {i: weight(i) for i in z if weight(i)}


def test_fit_against_plain_loop():
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    labels = [int(3 in d or rng.random() < 0.1) for d in docs]
    settings = {"alpha": 0.5, "beta": 1.0, "l1": 1.5, "l2": 0.2, "rounds": 3, "seed": 4}
    model = ft.fit(docs, labels, 0.5, **settings)
    want = plain_fit(docs, labels, **settings)
    assert model.intercept == pytest.approx(want.pop(ft.BUCKETS))
    assert dict(zip(model.at.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want)
    assert 0 < len(want) < 60


def test_features_stay_within_documents():
    docs = [ft.words_of(t) for t in ("One, two three.", "", "four", "one two three four FIVE", None)]
    ends = np.cumsum([len(d) for d in docs])
    found = [(first.tolist(), at.tolist()) for first, at in ft.features(ft.word_hashes(docs, {}), ends)]
    assert [len(first) for first, _ in found] == [9, 6, 4, 4, 2]  # words, pairs, pairs at 2, triples, pairs at 3
    by_kind = [dict(zip(*f, strict=True)) for f in found]
    for kind in by_kind[:3]:
        assert kind[0] == kind[4]  # "one two three" twice
    assert len({at for kind in by_kind for at in kind.values()}) == 25 - 3 - 2 - 1 - 1 - 1  # "four" twice too


def test_scores_are_sums_over_distinct_features():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(30))) for _ in range(40)] + [None, ""]
    at = np.arange(ft.BUCKETS)
    model = ft.Model(at, np.random.default_rng(2).normal(size=ft.BUCKETS) / 20, -0.3)
    got = model.scores(texts, {}, model.table())
    for t, s in zip(texts, got, strict=True):
        own = [ft.words_of(t)]
        coordinates = set().union(*[set(c.tolist()) for _, c in ft.features(ft.word_hashes(own, {}), np.array([len(own[0])]))])
        assert s == pytest.approx(1 / (1 + math.exp(0.3 - sum(model.weights[c] for c in coordinates))))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = ft.op13_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks = got["score"].rank()
    ones = got["toxic"] == 1
    area = (ranks[ones].mean() - (ones.sum() + 1) / 2) / (~ones).sum()
    assert area > 0.97
    assert got.loc[ones, "predicted"].mean() > 0.8 and got.loc[~ones, "predicted"].mean() < 0.01
    assert got["score"].between(0, 1).all()


def test_defined_cases(spark):
    rows = [(k, f"some plain words number {k % 7} here and {'scum fool' if k % 3 == 0 else 'nothing'}", "x") for k in range(300)]
    more = [(400, None, ""), (401, "", None), (402, " .,! ", "x"), (None, "you scum fool", "x"), (403, "plain " * 300_000 + "scum fool", "x")]
    docs = spark.createDataFrame(rows + more + more[-1:], "doc_id long, text string, score string")
    pairs = [(k, int(k % 3 == 0), 1) for k in range(300)] + [(400, None, 1), (401, 5, 1), (None, 1, 1)]
    labels = spark.createDataFrame(pairs, "doc_id long, toxic int, text int")
    out = ft.op13_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 306 and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got[None]["predicted"] == got[403]["predicted"] == 1 and got[None]["held_out"] is False
    assert got[400]["score"] == got[401]["score"] == got[402]["score"] < 0.5
    assert [got[k]["predicted"] for k in range(300)] == [int(k % 3 == 0) for k in range(300)]
    again = {r["doc_id"]: r["score"] for r in ft.op13_toxicity(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert ft.op13_toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in ft.op13_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.where("toxic = 1").select("doc_id", "toxic")
    assert ft.op13_toxicity(docs, one).agg(F.min("score")).first()[0] > 0.99


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 50) for k in range(500)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept, given, share = ft.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 20 * 314, 1000)
    assert 10 < len(kept) <= 40 and share == 0.5 and set(given) == {0, 1}
    none, _, _ = ft.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 20 * 314, 100)
    assert not none
