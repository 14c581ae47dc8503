"""The n-gram model against a plain implementation of its formulas."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from visitframe.llm import kneser_ney as kn


class Plain:
    def __init__(self, texts: list[str]):
        self.n: dict[int, Counter] = {4: Counter()}
        for t in texts:
            s = kn.START * 3 + t + kn.END
            self.n[4].update(s[i : i + 4] for i in range(len(s) - 3))
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.left = {}, {}, {}
        for k in (1, 2, 3, 4):
            c = Counter(self.n[k].values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] else None
            self.d[k] = []
            for j in (1, 2, 3):
                d = j - (j + 1) * y * c[j + 1] / c[j] if y is not None and c[j] else -1
                self.d[k].append(d if 0 < d < j else 0.5)
            self.total[k], self.left[k] = defaultdict(float), defaultdict(float)
            for g, n in self.n[k].items():
                self.total[k][g[:-1]] += n
                self.left[k][g[:-1]] += min(self.d[k][min(n, 3) - 1], n)

    def p(self, g: str) -> float:
        k = len(g)
        if not k:
            return 1 / (len(self.n[1]) + 1)
        below = self.p(g[1:])
        if g[:-1] not in self.total[k]:
            return below
        n = self.n[k].get(g, 0)
        alpha = (n - min(self.d[k][min(n, 3) - 1], n)) / self.total[k][g[:-1]] if n else 0.0
        return alpha + self.left[k][g[:-1]] / self.total[k][g[:-1]] * below

    def score(self, text: str) -> float:
        s = kn.START * 3 + text + kn.END
        return sum(math.log(self.p(s[i : i + 4])) for i in range(len(s) - 3))


def test_against_the_formulas(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("n_chars < 4000")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, " \n", "en"), (9003, "never seen 漢字", "en"), (9004, "xx", "xx"), (9005, "no language", None)], docs.schema)
    both = docs.union(odd)
    labels = docs.where("doc_id % 3 != 0").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, 0)], labels.schema))
    rows = both.withColumn("held", kn.held_out("doc_id")).collect()
    trusted = {r["doc_id"] for r in labels.collect()}
    train = defaultdict(list)
    for r in rows:
        if r["doc_id"] in trusted and not r["held"] and kn.clean(r["text"]):
            train[r["lang"]].append(kn.clean(r["text"]))
    models = {lang: Plain(texts) for lang, texts in train.items()}
    got = {r["doc_id"]: r for r in kn.classify(both, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text, g = kn.clean(r["text"]), got[r["doc_id"]]
        if not text:
            assert g["n_tokens"] == 0 and g["perplexity"] is None and not g["kept"]
        elif r["lang"] not in models:
            assert g["log_prob"] is None and g["kept"]
        else:
            want = models[r["lang"]].score(text)
            assert g["n_tokens"] == len(text) + 1 and math.isclose(g["log_prob"], want, rel_tol=1e-9)
            assert math.isclose(g["perplexity"], math.exp(-want / (len(text) + 1)), rel_tol=1e-9)
    for lang in models:
        held = sorted(got[r["doc_id"]]["perplexity"] for r in rows if r["lang"] == lang and r["held"] and r["doc_id"] in trusted and kn.clean(r["text"]))
        if held:
            limits = {g["threshold"] for g in got.values() if g["lang"] == lang}
            assert len(limits) == 1 and limits <= set(held)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (1, "abc", "en"), (None, "abd", "en"), (2, "long text " * 50_000, "en")], "doc_id long, text string, lang string")
    docs = docs.withColumn("perplexity", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert kn.classify(docs, labels).count() == 4
    assert kn.classify(docs, labels.limit(0)).where("not kept").isEmpty()
    assert kn.classify(docs.limit(0), labels).count() == 0


def test_planted_junk_scores_worse_than_trusted_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = kn.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] > 0.9 > kept[0] + 0.2


def test_no_character_is_renamed():
    """Far more characters than 65,536: every n-gram comes back as it is."""
    text = "".join(chr(c) for c in range(0x100, 0x20000) if not 0xD800 <= c < 0xE000)
    grams = kn.Grams([text])
    found, n = grams.counts()
    strings = grams.strings(found)
    padded = kn.START * 3 + text + kn.END
    assert sorted(strings) == sorted(padded[k : k + 4] for k in range(len(padded) - 3)) and n.sum() == len(text) + 1
    assert (grams.find(strings) == found).all()


def test_buckets_and_partitions_are_apart(spark):
    """Rows without an id and ids of other types; all tasks get some, and no more partitions than asked for."""
    docs = spark.range(3000).select(F.lit(None).cast("decimal(20,0)").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    packed = kn.pack_documents(docs, "doc_id", "lang", "text", 64)
    assert packed.select("bucket").distinct().count() == 64
    got = kn.classify(docs, labels)
    assert got.count() == 3000 and got.schema["doc_id"].dataType.simpleString() == "decimal(20,0)"
