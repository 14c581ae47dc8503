"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (order 4), one per language: an n-gram's probability is its
discounted count plus the context's left-over mass times the probability one order lower,
down to a uniform distribution; lower orders use continuation counts. The three discounts of
each order come from its counts of counts.

Counts are tables keyed by (language, n-gram), sharded by that key; nothing of the model is
collected or broadcast by hand. Documents lie in buckets by a hash of their id. Each bucket asks
for its distinct n-grams, the distinct requests of all buckets join the count tables order by
order, and the answers go back to the buckets, where each document adds up its log
probability. So what moves is n-gram types per bucket, not positions.

A document is kept if its perplexity is at most its language's threshold: the `quantile` of the
perplexities of trusted documents that were held out of the counts.

Defined cases: white space runs count as one space; a null or blank text has no tokens, no
perplexity and isn't kept; a language without trusted text, or without held-out trusted text,
has no threshold and its documents are kept; null is a language of its own; labels that repeat
an id count as trusted if any of them is, and null ids never are; rows that repeat an id or all of a row are
scored each; a perplexity equal to the threshold is kept; ids may be of any type, other columns of docs
don't come through, so none can clash; long texts are taken whole; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from visitframe.llm.common import checkpoint, partitions, salted_join, written

ORDER = 4
START, END = "\x02", "\x03"
QUANTILE = 0.99
#: One trusted document in so many is held out of the counts for the threshold.
HELD_OUT = 5
#: Bytes of text in a bucket, on average: at most the first, and no less than the second to give
#: every task one. A bucket asks for each n-gram once, so larger ones move less; a task holds
#: one at a time, however many fall to it.
BUCKET_BYTES, LEAST_BYTES = 16 << 20, 1 << 20


def clean(text: str | None) -> str:
    return " ".join(text.replace(START, " ").replace(END, " ").split()) if text else ""


def _pack(columns: list[pa.Array], names: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs])


def pack_documents(docs: DataFrame, id_col: str, lang: str, text: str, buckets: int) -> DataFrame:
    """(bucket, blob): documents with cleaned texts, compressed, by a hash of their id."""
    picked = docs.select(
        # rows without an id are dealt by their text
        F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col))), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(3).to_pylist()], pa.large_string())
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            found = np.unique(bucket)
            blobs = []
            for b in found:
                at = pa.array(np.flatnonzero(bucket == b))
                blobs.append(_pack([batch.column(1).take(at), batch.column(2).take(at), texts.take(at)], ["id", "lang", "text"]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return picked.mapInArrow(run, "bucket int, blob binary")


class Grams:
    """The n-grams of a set of texts as numbers: characters get codes, the pairs of codes that
    occur get ranks, and an n-gram of four characters is two ranks."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        seen = np.zeros(0x110000, np.int64)
        for points in self._points():
            seen += np.bincount(points, minlength=len(seen))
        present = np.flatnonzero(seen)
        self.chars = present
        self.code = np.zeros(0x110000, np.int64)
        self.code[present] = np.arange(len(present))
        size = len(present)
        pairs: list[np.ndarray] = []
        for points in self._points():
            c = self.code[points]
            pairs.append(np.unique(c[:-1] * size + c[1:]))
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.size = size

    def _points(self) -> Iterator[np.ndarray]:
        """Code points of about 1M characters at a time, whole texts with their paddings."""
        held, n = [], 0
        for t in self.texts:
            held.append(START * (ORDER - 1) + t + END)
            n += len(held[-1])
            if n > 1_000_000:
                yield np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
                held, n = [], 0
        if held:
            yield np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)

    def numbers(self) -> Iterator[np.ndarray]:
        """Numbers of the n-grams of whole texts, one per position, those of each text together."""
        start = self.code[ord(START)]
        ranks = None
        if self.size**2 <= 1 << 24:
            ranks = np.zeros(self.size**2, np.int64)
            ranks[self.pairs] = np.arange(len(self.pairs))
        for points in self._points():
            c = self.code[points]
            pair = c[:-1] * self.size + c[1:]
            rank = ranks[pair] if ranks is not None else np.searchsorted(self.pairs, pair)
            number = rank[:-2] * len(self.pairs) + rank[2:]
            yield number[c[ORDER - 1 :] != start]

    @property
    def dense(self) -> bool:
        return len(self.pairs) ** 2 <= 1 << 22

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and how often they occur."""
        if self.dense:
            total = np.zeros(len(self.pairs) ** 2, np.int64)
            for number in self.numbers():
                total += np.bincount(number, minlength=len(total))
            found = np.flatnonzero(total)
            return found, total[found]
        found, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for number in self.numbers():
            own, n = np.unique(number, return_counts=True)
            found, back = np.unique(np.concatenate([found, own]), return_inverse=True)
            total = np.bincount(back, np.concatenate([total, n]), len(found)).astype(np.int64)
        return found, total

    def strings(self, numbers: np.ndarray) -> list[str]:
        first, second = np.divmod(numbers, max(len(self.pairs), 1))
        quads = [c for r in (first, second) for c in np.divmod(self.pairs[r], self.size)]
        points = self.chars[np.stack(quads, axis=1)].astype("<u4")
        return points.view("<U4").ravel().tolist() if (points != 0).all() else ["".join(map(chr, p)) for p in points.tolist()]

    def find(self, grams: list[str]) -> np.ndarray:
        """Numbers of n-grams given as strings; all of them occur in the texts."""
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        c = self.code[points]
        r = [np.searchsorted(self.pairs, c[:, k] * self.size + c[:, k + 1]) for k in (0, 2)]
        return r[0] * len(self.pairs) + r[1]


def _by_language(docs: pa.Table) -> dict[str, np.ndarray]:
    langs = np.array(docs["lang"].to_pylist(), object)
    return {lang: np.flatnonzero(langs == lang) for lang in sorted(set(langs.tolist()))}


def _gram_table(rows: list[tuple[str, list[str], np.ndarray]], bucket: int | None = None) -> pa.Table:
    lang = pa.concat_arrays([pa.array([x] * len(g), pa.string()) for x, g, _ in rows] or [pa.array([], pa.string())])
    gram = pa.concat_arrays([pa.array(g, pa.string()) for _, g, _ in rows] or [pa.array([], pa.string())])
    if bucket is None:
        n = np.concatenate([c for _, _, c in rows] or [np.zeros(0, np.int64)])
        return pa.table({"lang": lang, "gram": gram, "n": pa.array(n, pa.int64())})
    return pa.table({"bucket": pa.array(np.full(len(gram), bucket, np.int32)), "lang": lang, "gram": gram})


def held_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("held out")), F.lit(HELD_OUT)) == 0


def count_grams(packed: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, gram, n): counts over the trusted documents. trusted: bucket, id; not held out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = set(right["id"].to_pylist())
        rows: list[tuple[str, list[str], np.ndarray]] = []
        if ids and left.num_rows:
            docs = _unpack(left["blob"])
            at = np.flatnonzero([i in ids for i in docs["id"].to_pylist()])
            docs = docs.take(pa.array(at))
            texts = docs["text"].to_pylist()
            for lang, own in _by_language(docs).items():
                if some := [texts[i] for i in own if texts[i]]:
                    grams = Grams(some)
                    found, n = grams.counts()
                    rows.append((lang, grams.strings(found), n))
        return _gram_table(rows)

    per_bucket = packed.groupBy("bucket").cogroup(trusted.groupBy("bucket")).applyInArrow(
        run, "lang string, gram string, n long"
    )
    return per_bucket.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_table(counts: DataFrame) -> DataFrame:
    """(order, lang, context, gram, n, d) of all orders: n is the count, below the highest order
    the continuation count, d the discount that is taken off.

    The discounts d1, d2, d3 of counts 1, 2 and above come from the counts of counts of each order
    and language. Where those don't determine a discount (tiny corpora), half a count is taken
    off."""
    own, parts = counts, []
    for order in range(ORDER, 0, -1):
        context = F.substring("gram", 1, order - 1).alias("context")
        parts.append(own.select(F.lit(order).alias("order"), "lang", context, "gram", "n"))
        own = own.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
    table = checkpoint(reduce(DataFrame.unionByName, parts))
    of_counts = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    taken = []
    for k in (1, 2, 3):
        d = F.lit(k) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        taken.append(F.when((d > 0) & (d < k), d).otherwise(F.lit(0.5)).alias(f"d{k}"))
    discounts = table.groupBy("order", "lang").agg(*of_counts).select("order", "lang", *taken)
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return salted_join(table, discounts, ["order", "lang"], "gram").select(
        "order", "lang", "context", "gram", "n", F.least(d, F.col("n")).alias("d")
    )


def probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) of distinct requests (lang, gram); logp is null where the language
    has no counts.

    All orders meet their counts in one exchange by context: alpha, the discounted share of the
    context's count, and gamma, the mass left for the order below, are windows over it. A
    context has no more n-grams than the language has characters. Then each order joins the one
    below."""
    suffixes = [
        F.struct(F.lit(k).alias("order"), F.substring("gram", ORDER - k + 1, k).alias("gram")) for k in range(1, ORDER + 1)
    ]
    asked = wanted.select("lang", F.explode(F.array(*suffixes)).alias("s")).select("s.order", "lang", "s.gram").distinct()
    both = asked.select(
        "order", "lang", F.expr("substring(gram, 1, order - 1)").alias("context"), "gram", F.lit(True).alias("asked")
    ).unionByName(gram_table(counts).withColumn("asked", F.lit(False)), allowMissingColumns=True)
    context = Window.partitionBy("order", "lang", "context")
    own = Window.partitionBy("order", "lang", "context", "gram")
    found = checkpoint(
        both.withColumn("total", F.sum("n").over(context))
        .withColumn("gamma", F.sum("d").over(context) / F.col("total"))
        .withColumn("grams", F.count("n").over(context))
        .withColumn("alpha", (F.max("n").over(own) - F.max("d").over(own)) / F.col("total"))
        .where("asked")
        .select("order", "lang", "gram", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), "gamma", "grams")
    )
    # below the single characters all are equally likely, with one more for what was never seen
    p = found.where("order = 1").select("lang", "gram", (F.col("alpha") + F.col("gamma") / (F.col("grams") + 1)).alias("p"))
    for order in range(2, ORDER + 1):
        below = p.select("lang", F.col("gram").alias("__suffix"), F.col("p").alias("__p"))
        p = (
            found.where(F.col("order") == order)
            .withColumn("__suffix", F.substring("gram", 2, order - 1))
            .join(below, ["lang", "__suffix"])
            .select("lang", "gram", (F.col("alpha") + F.coalesce("gamma", F.lit(1.0)) * F.col("__p")).alias("p"))
        )
    return p.select("lang", "gram", F.log("p").alias("logp"))


def _requests(packed: DataFrame) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        docs = _unpack(left["blob"])
        texts, rows = docs["text"].to_pylist(), []
        for lang, own in _by_language(docs).items():
            if some := [texts[i] for i in own if texts[i]]:
                grams = Grams(some)
                found, n = grams.counts()
                rows.append((lang, grams.strings(found), n))
        return _gram_table(rows, key[0].as_py())

    return packed.groupBy("bucket").applyInArrow(run, "bucket int, lang string, gram string")


def _scores(packed: DataFrame, answers: DataFrame, id_type: DataType) -> DataFrame:
    """(id, lang, n_tokens, log_prob) of every document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        docs = _unpack(left["blob"])
        texts = docs["text"].to_pylist()
        tokens, total = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
        told = np.array(right["lang"].to_pylist(), object)
        gram, logp = right["gram"].to_pylist(), right["logp"].to_numpy()
        for lang, own in _by_language(docs).items():
            own = np.array([i for i in own if texts[i]], np.int64)
            if not len(own):
                continue
            grams = Grams([texts[i] for i in own])
            at = np.flatnonzero(told == lang)
            number, value = grams.find([gram[i] for i in at]), logp[at]
            if grams.dense:
                table = np.full(len(grams.pairs) ** 2, np.nan)
                table[number] = value
                found = (table[n] for n in grams.numbers())
            else:
                order = np.argsort(number)
                number, value = number[order], value[order]
                found = (value[np.searchsorted(number, n)] for n in grams.numbers())
            tokens[own] = sizes = np.array([len(texts[i]) + 1 for i in own])
            ends, done = np.cumsum(sizes), 0
            for part in found:  # the positions of some whole texts
                more = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + len(part), "right"))
                total[own[done:more]] = np.add.reduceat(part, ends[done:more] - sizes[done:more] - ends[done] + sizes[done])
                done = more
        return pa.table(
            {
                "id": docs["id"].combine_chunks(),
                "lang": docs["lang"].combine_chunks(),
                "n_tokens": pa.array(tokens),
                "log_prob": pa.array(total, mask=np.isnan(total)),
            }
        )

    schema = f"id {id_type.simpleString()}, lang string, n_tokens long, log_prob double"
    arrow_id = to_arrow_type(id_type)
    empty = pa.table(
        {"id": pa.array([], arrow_id), "lang": pa.array([], pa.string()), "n_tokens": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64())}
    )
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
    quantile: float = QUANTILE,
) -> DataFrame:
    """(doc_id, lang, n_tokens, log_prob, perplexity, threshold, kept) per row of docs. Trusted are
    the ids that labels holds with quality 1 and toxic 0."""
    tasks = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), min(tasks, size // LEAST_BYTES), 1)
    id_type = docs.select(id_col).schema[0].dataType
    trusted = (
        labels.where("quality = 1 and toxic = 0").select(F.col(id_col).cast(id_type).alias("id")).where("id is not null").distinct()
    )
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    packed = pack_documents(docs, id_col, lang, text, buckets).repartition(tasks, "bucket")
    # two passes, counting and scoring, go over the same buckets
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    counts = checkpoint(count_grams(packed, trusted.where(~held_out("id")).select(bucket, "id")))
    # the distinct requests and the way back to the buckets read what is written here; no n-gram
    # has more than one row per bucket, of the many that a bucket asks for
    requests = written(_requests(packed))
    answers = requests.join(probabilities(requests.select("lang", "gram").distinct(), counts), ["lang", "gram"])
    scored = checkpoint(_scores(packed, answers, id_type)).withColumn(
        "perplexity", F.exp(-F.col("log_prob") / F.col("n_tokens"))
    )
    packed.unpersist()
    held = scored.where(held_out("id")).join(trusted, "id", "left_semi").where("perplexity is not null")
    thresholds = held.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    return salted_join(scored, thresholds, ["lang"], "id", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"),
        "n_tokens",
        "log_prob",
        "perplexity",
        "threshold",
        (
            (F.col("n_tokens") > 0)
            & (F.col("perplexity").isNull() | F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
        ).alias("kept"),
    )


def op1_kneser_ney(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
