"""Language identification: forward-backward against enumeration, accuracy, defined cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.llm import crf_language as crf


def model(k: int, rng: np.random.Generator) -> crf.Crf:
    return crf.Crf([str(j) for j in range(k)], None, {}, None, rng.normal(size=(k, k)), rng.normal(size=k))


def test_posteriors_against_all_labelings():
    rng = np.random.default_rng(5)
    m = model(3, rng)
    e = rng.normal(size=(5, 3)).astype(np.float32)
    want = np.zeros((5, 3))
    for y in itertools.product(range(3), repeat=5):
        score = m.first[y[0]] + sum(e[t, y[t]] for t in range(5)) + sum(m.transitions[a, b] for a, b in zip(y, y[1:], strict=False))
        want[range(5), y] += np.exp(score)
    assert np.allclose(m.posteriors(e, np.array([5])), want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_blocks_change_nothing():
    rng = np.random.default_rng(6)
    m = model(4, rng)
    sizes = np.array([1, 63, 64, 65, 128, 129, 3000, 2])
    e = (3 * rng.normal(size=(sizes.sum(), 4))).astype(np.float32)
    got, lo = m.posteriors(e, sizes), 0
    for n in sizes.tolist():
        one = crf._forward_backward(e[None, lo : lo + n].astype(float), np.ones((1, n), bool), m.transitions, m.first)[0][0]
        assert np.abs(got[lo : lo + n] - one).max() < 1e-4
        lo += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.op9_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
    assert got.where("score < 0 or score > 1").isEmpty()


def test_code_switched_text_gets_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = docs.where("n_chars between 300 and 2000")
    one = {r["lang"]: r["text"] for r in some.groupBy("lang").agg(F.min_by("text", F.struct("doc_id")).alias("text")).collect()}
    a, b = sorted(x for x in one if x)[:2]
    mixed = spark.createDataFrame([(10**9, one[a] + " " + one[b], None, "mixed")], "doc_id long, text string, lang string, source string")
    found = crf.identify(docs.select("doc_id", "text", "lang", "source").union(mixed), with_spans=True).where("doc_id = 1000000000").first()
    assert {s["lang"] for s in found["spans"]} >= {a, b}
    assert all(x["end"] <= y["start"] for x, y in itertools.pairwise(found["spans"]))


def test_defined_cases(spark):
    train = [(k, f"the cat and the dog number {k} ran over there", "en") for k in range(20)]
    train += [(k, f"der Hund und die Katze Nummer {k} liefen dort", "de") for k in range(20, 40)]
    rows = [*train, (100, None, "en"), (101, "", "en"), (102, "12 34 ²³ !?", None), (None, "the dog", None), (103, "the cat " * 40_000, None), (103, "the cat " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in crf.op9_language_id(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == got[103][0] == "en" and got[25][0] == "de"
    assert crf.op9_language_id(docs).count() == len(rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert crf.op9_language_id(unlabelled).where("lang_pred != 'und'").isEmpty()
    assert crf.op9_language_id(docs.limit(0)).count() == 0
    kept = crf.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (100, 101, 102)").isEmpty()


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("en").alias("lang"))
    assert len(crf.training_sample(docs, "doc_id", "text", "lang", 100, 8)) == 100
    only = docs.where(crf.held_out("doc_id"))
    assert crf.training_sample(only, "doc_id", "text", "lang", 100, 8) == []


def test_many_languages_are_all_learned(spark):
    names = [f"l{k:02d}" for k in range(70)]
    rows = [(70 * n + k, " ".join(f"{name}".translate(str.maketrans("0123456789", "abcdefghij")) + "xyzuvw"[(n + w) % 6] for w in range(12)), name) for n in range(12) for k, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = crf.training_sample(docs, "doc_id", "text", "lang", 400, 600)
    assert {lang for lang, _ in sample} == set(names)
    fitted = crf.fit(sample)
    assert len(fitted.languages) == 70
    # the lexicon holds words of the languages beyond the bits of one word
    assert fitted.lexicon["lgjx"] >> 69 & 1 and [j for j, hit in crf._in_lexicon(fitted.lexicon, ["lgjx"], 70) if hit[0]] == [69]
    with pytest.raises(ValueError, match="languages"):
        crf.training_sample(docs, "doc_id", "text", "lang", 400, 600, most_languages=69)
