"""Language identification of code-switched text by a linear-chain conditional random field.

Words (runs of letters, lower-cased) are the chain's positions, languages its labels. A word's
emission scores add up hashed weights of its prefixes, suffixes and character n-grams, and of
the lexicons it stands in (the most frequent words of each language in the sample). Transition
scores are learned with the rest, from chains that join windows of different documents, so that
switches inside a chain are seen. Forward-backward gives every word its posterior; a document's
language has the largest mean posterior, which is the score.

Fitting takes a bounded sample: `per_language` documents of each language, `window_chars`
characters of each. Prediction covers whole texts. The model that travels to the tasks is a table
of `buckets` x languages numbers, whatever the input's size.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows
everything is `und`; ties go to the first language by code point; repeated rows get the same
answer; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from visitframe.llm.common import text_slices

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
LONGEST = 32
DRAW_BITS = 30
WORDS_KEPT = 100_000
#: Words of a block of forward-backward.
BLOCK = 64
#: Languages of a model at most; more raise an error, so that none is dropped in silence.
MOST_LANGUAGES = 128
#: Windows of a fit times the languages at most: with many languages, each gets fewer windows, but 20 at least.
WINDOWS_BY_LANGUAGES = 100_000
#: Languages in one word of a bit set.
SET_BITS = 62


def words_of(text: str | None) -> list[str]:
    """Letter runs, lower-cased; none if the text has no letter (digits of other scripts
    are no letters)."""
    found = WORDS.findall(text.lower()) if text else []
    if found and not found[0].isalpha() and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def _hash(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(np.broadcast(*parts).shape, salt, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int32) & (BUCKETS - 1)


def feature_groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, features): hashed affix and n-gram features, word by word, words of equal
    length together. Of words over LONGEST letters the two ends count."""
    by_length: dict[int, list[int]] = {}
    short = [w if len(w) <= LONGEST else w[: LONGEST // 2] + w[-LONGEST // 2 :] for w in words]
    for i, w in enumerate(short):
        by_length.setdefault(len(w), []).append(i)
    groups = [(n, own[lo : lo + 20_000]) for n, own in by_length.items() for lo in range(0, len(own), 20_000)]
    for length, members in groups:
        text = "".join([short[i] for i in members])
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, length)
        m = np.zeros((len(members), length + 2), np.uint32)
        m[:, 0], m[:, -1], m[:, 1:-1] = 1, 2, raw
        found = [_hash([m[:, :-1], m[:, 1:]], 11), _hash([m[:, :-2], m[:, 1:-1], m[:, 2:]], 12)]
        for k in (2, 3, 4):
            if length >= k:
                found.append(_hash([raw[:, j] for j in range(k)], 20 + k)[:, None])
                found.append(_hash([raw[:, length - k + j] for j in range(k)], 30 + k)[:, None])
        yield np.array(members), np.concatenate(found, axis=1)


def _in_lexicon(lexicon: dict[str, int], words: list[str], languages: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each language, which of the words stand in its lexicon."""
    for low in range(0, languages, SET_BITS):
        part = np.array([lexicon.get(w, 0) >> low & (1 << SET_BITS) - 1 for w in words], np.int64)
        for j in range(low, min(low + SET_BITS, languages)):
            yield j, part >> (j - low) & 1 == 1


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    lexicon: dict[str, int]  # word -> bit set of languages
    lexicon_weights: np.ndarray  # languages (of the lexicon) x languages
    transitions: np.ndarray  # from x to
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.languages)
        out = np.zeros((len(words), k), np.float32)
        for at, features in feature_groups(words):
            for column in features.T:
                out[at] += self.weights[column]
        for j, hit in _in_lexicon(self.lexicon, words, k):
            out[hit] += self.lexicon_weights[j]
        return out

    def posteriors(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Posteriors (words x languages) of chains that lie one after the other in e.

        Chains are cut in blocks of BLOCK words. The product of a block's transfer matrices is
        found for all blocks at once, step by step; a scan over each chain's blocks gives what
        enters a block from either side; then forward and backward run in all blocks at once.
        """
        k = len(self.languages)
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        first = np.exp(self.first - self.first.max()).astype(np.float32)
        ones = np.ones(k, np.float32)

        def scaled(v: np.ndarray) -> np.ndarray:
            return v / (v @ ones)[:, None]

        blocks = -(-sizes // BLOCK)
        begin = np.concatenate([[0], np.cumsum(blocks)])
        word = np.arange(len(e)) + np.repeat(begin[:-1] * BLOCK - np.cumsum(sizes) + sizes, sizes)
        n, at, step = int(begin[-1]), word // BLOCK, word % BLOCK
        p = np.ones((BLOCK, n, k), np.float32)
        p[step, at] = np.exp(e - e.max(axis=1, keepdims=True))
        full = np.full(n, BLOCK)
        full[begin[1:] - 1] = sizes - (blocks - 1) * BLOCK
        # blocks with a word at step t are those before live[t], longest first
        order = np.argsort(-full, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        p = p[:, order]
        live = np.searchsorted(-full[order], -np.arange(BLOCK), "left")
        starts, ends = place[begin[:-1]], place[begin[1:] - 1]
        whole = np.tile(a, (n, 1, 1))
        whole[starts] = np.eye(k, dtype=np.float32)
        whole *= p[0][:, None, :]
        for t in range(1, BLOCK):
            m = live[t]
            if not m:
                break
            own = (whole[:m].reshape(-1, k) @ a).reshape(m, k, k) * p[t, :m, None, :]
            whole[:m] = own / (own.reshape(m, -1) @ np.ones(k * k, np.float32))[:, None, None]
        enters, leaves = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
        enters[starts], leaves[ends] = first, 1
        chains = np.argsort(-blocks, kind="stable")
        still = np.searchsorted(-blocks[chains], -np.arange(1, blocks.max(initial=0) + 1), "left")
        for j, m in enumerate(still.tolist(), 1):
            if m:
                c = chains[:m]
                before, here = place[begin[c] + j - 1], place[begin[c] + j]
                enters[here] = scaled(np.einsum("ni,nij->nj", enters[before], whole[before]))
                here, after = place[begin[c + 1] - 1 - j], place[begin[c + 1] - j]
                leaves[here] = scaled(np.einsum("nij,nj->ni", whole[after], leaves[after]))
        alpha = np.ones_like(p)
        now = enters @ a
        now[starts] = first
        alpha[0] = now = scaled(now * p[0])
        for t in range(1, BLOCK):
            m = live[t]
            now[:m] = scaled((now[:m] @ a) * p[t, :m])
            alpha[t, :m] = now[:m]
        beta = leaves
        for t in range(BLOCK - 1, -1, -1):
            m = live[t]
            alpha[t, :m] *= beta[:m]
            beta[:m] = scaled((p[t, :m] * beta[:m]) @ a.T)
        return scaled(alpha[step, place[at]])


def _forward_backward(
    e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    n, steps, k = e.shape
    top = transitions.max()
    a = np.exp(transitions - top).astype(e.dtype)
    p = np.exp(e - e.max(axis=2, keepdims=True))
    alpha = np.empty_like(p)
    now = p[:, 0] * np.exp(first - first.max()).astype(e.dtype)
    alpha[:, 0] = now = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (now @ a) * p[:, t]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    total = np.zeros((k, k)) if pairs else None
    beta = np.ones((n, k), e.dtype)
    for t in range(steps - 2, -1, -1):
        ahead = p[:, t + 1] * beta
        if pairs:
            joint = alpha[:, t][:, :, None] * a * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            total += joint[mask[:, t + 1]].sum(axis=0)
        beta = ahead @ a.T
        beta /= beta.sum(axis=1, keepdims=True)
        beta[~mask[:, t + 1]] = 1
        alpha[:, t] *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha, total


def _chains(windows: list[tuple[int, list[str]]], count: int, rng: np.random.Generator, steps: int):
    """Chains of `steps` words made of pieces of 3 to 24 words from random windows."""
    for _ in range(count):
        words: list[str] = []
        labels: list[int] = []
        while len(words) < steps:
            label, own = windows[int(rng.integers(len(windows)))]
            size = int(rng.integers(3, 25))
            at = int(rng.integers(max(1, len(own) - size + 1)))
            part = own[at : at + size][: steps - len(words)]
            words += part
            labels += [label] * len(part)
        yield words, labels


def fit(rows: list[tuple[str, str]], rounds: int = 40, lexicon_size: int = 200, steps: int = 40, seed: int = 7) -> Crf | None:
    """Maximum likelihood by Adam over all chains at once; rows are (language, text)."""
    by_lang: dict[str, list[list[str]]] = {}
    for lang, text in rows:
        if own := words_of(text):
            by_lang.setdefault(lang, []).append(own)
    languages = sorted(by_lang)
    k = len(languages)
    if not k:
        return None
    lexicon: dict[str, int] = {}
    for j, lang in enumerate(languages):
        common = Counter(w for own in by_lang[lang] for w in own)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << j
    rng = np.random.default_rng(seed)
    windows = [(j, own) for j, lang in enumerate(languages) for own in by_lang[lang]]
    count = max(50, 2 * len(windows))
    chains = list(_chains(windows, count, rng, steps))
    types = sorted({w for words, _ in chains for w in words})
    number = {w: i for i, w in enumerate(types)}
    x = np.array([[number[w] for w in words] for words, _ in chains])
    y = np.array([labels for _, labels in chains])
    groups = list(feature_groups(types))
    in_lexicon = np.stack([hit for _, hit in _in_lexicon(lexicon, types, k)], axis=1).astype(np.float64)
    params = [np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    mask = np.ones(x.shape, bool)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    gold = np.eye(k)[y]
    for step in range(1, rounds + 1):
        w, lex, trans, first = params
        scores = in_lexicon @ lex
        for at, features in groups:
            scores[at] += w[features].sum(axis=1)
        post, joint = _forward_backward(scores[x], mask, trans, first, pairs=True)
        error = post - gold
        by_type = np.zeros((len(types), k))
        for j in range(k):
            by_type[:, j] = np.bincount(x.ravel(), error[:, :, j].ravel(), len(types))
        grad_w = np.zeros_like(w)
        for at, features in groups:
            flat = features.ravel()
            for j in range(k):
                grad_w[:, j] += np.bincount(flat, np.repeat(by_type[at, j], features.shape[1]), BUCKETS)
        grads = [grad_w, in_lexicon.T @ by_type, joint - gold_pairs, error[:, 0].sum(axis=0)]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / len(x) + 1e-4 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, lex, trans, first = params
    return Crf(languages, w.astype(np.float32), lexicon, lex.astype(np.float32), trans, first)


def predict_texts(model: Crf, texts: list[str | None], memory: dict) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Language, score and word posteriors of whole texts. memory keeps the emissions of
    words met before."""
    k = len(model.languages)
    docs = [words_of(t) for t in texts]
    known, table = memory.setdefault("row", {}), memory.get("table")
    types = set().union(*docs)
    fresh = list(types - known.keys())
    if table is None or len(known) + len(fresh) > len(table):
        known.clear()
        fresh = list(types)
        table = memory["table"] = np.empty((max(WORDS_KEPT, len(fresh)), k), np.float32)
    if fresh:
        lo = len(known)
        table[lo : lo + len(fresh)] = model.emissions(fresh)
        known.update(zip(fresh, range(lo, lo + len(fresh)), strict=True))
    sizes = np.array([len(d) for d in docs], np.int64)
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    posteriors: list[np.ndarray] = [np.zeros((0, k), np.float32)] * len(texts)
    full = np.flatnonzero(sizes)
    if len(full):
        rows = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        post = model.posteriors(table[rows], sizes[full])
        ends = np.cumsum(sizes[full])
        mean = np.add.reduceat(post, ends - sizes[full], axis=0, dtype=np.float64) / sizes[full][:, None]
        best = mean.argmax(axis=1)
        scores[full] = np.minimum(mean[np.arange(len(full)), best], 1)
        for i, j, own in zip(full.tolist(), best.tolist(), np.split(post, ends[:-1]), strict=True):
            langs[i], posteriors[i] = model.languages[j], own
    return langs, scores, posteriors


def spans_of(model: Crf, text: str, posterior: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, language) of runs of words with the same most likely language."""
    out: list[tuple[int, int, str]] = []
    for m, j in zip(WORDS.finditer(text.lower()), posterior.argmax(axis=1).tolist(), strict=False):
        lang = model.languages[j]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(
    docs: DataFrame, id_col: str, text: str, lang: str, per_language: int, window_chars: int, most_languages: int = MOST_LANGUAGES
) -> list[tuple[str, str]]:
    """(language, window of text) of at most per_language documents of each language, fewer from 16
    languages on (WINDOWS_BY_LANGUAGES)."""
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(id_col)).select(
        F.col(lang).alias("__lang"), F.col(id_col).alias("__id"), F.col(text).alias("__text")
    )
    labelled = labelled.withColumn("__draw", F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << DRAW_BITS)))
    names = [r["__lang"] for r in labelled.select("__lang").distinct().limit(most_languages + 1).collect()]
    if len(names) > most_languages:
        raise ValueError(f"over {most_languages} languages: pass a larger most_languages, or fewer labels")
    per_language = max(min(per_language, WINDOWS_BY_LANGUAGES // max(len(names), 1) ** 2), min(per_language, 20))
    # rows with draws below 2^level, per level: the lowest level that holds enough bounds the draw
    level = F.length(F.bin("__draw"))
    below: dict[str, dict[int, int]] = {}
    for r in labelled.groupBy("__lang", level.alias("level")).count().collect():
        below.setdefault(r["__lang"], {})[r["level"]] = r["count"]
    bound = F.lit(None)
    for name, levels in sorted(below.items()):
        enough = (x for x in range(DRAW_BITS) if sum(c for at, c in levels.items() if at <= x) >= per_language)
        bound = F.when(F.col("__lang") == name, F.lit(1 << next(enough, DRAW_BITS))).otherwise(bound)
    w = Window.partitionBy("__lang").orderBy("__draw", "__id", F.xxhash64("__text"))
    start = F.pmod(F.col("__draw"), F.greatest(F.length("__text") - window_chars, F.lit(1))) + 1
    rows = (
        labelled.where(F.col("__draw") < bound)
        .select("__lang", "__id", "__draw", F.col("__text").substr(start.cast("int"), F.lit(window_chars)).alias("__text"))
        .withColumn("__no", F.row_number().over(w))
        .where(F.col("__no") <= per_language)
        .select("__lang", "__text", "__draw", "__id")
        .orderBy("__lang", "__draw", "__id", "__text")
        .collect()
    )
    return [(r["__lang"], r["__text"]) for r in rows if r["__text"]]


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    window_chars: int = 600,
    with_spans: bool = False,
    carry: bool = False,
    most_languages: int = MOST_LANGUAGES,
) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) per row of docs; spans are arrays of (start, end,
    language) in characters of the lower-cased text. With carry, all columns of docs instead of
    the id alone; columns of docs named like an output are replaced."""
    model = fit(training_sample(docs, id_col, text, lang, per_language, window_chars, most_languages))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score"] + (["spans"] if with_spans else [])
    kept = [f for f in docs.schema.fields if f.name not in added] if carry else [docs.schema[id_col]]
    n = len(kept)
    picked = docs.select(*[f"`{f.name}`" for f in kept], F.col(text).alias("__text"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for whole in batches:
            for batch in text_slices(whole, n):
                texts = batch.column(n).to_pylist()
                if model is None:
                    langs, scores, post = [UNKNOWN] * len(texts), np.zeros(len(texts)), [np.zeros((0, 0))] * len(texts)
                else:
                    langs, scores, post = predict_texts(model, texts, memory)
                arrays = [*batch.columns[:n], pa.array(langs), pa.array(scores)]
                if with_spans:
                    cut = [
                        [dict(zip(("start", "end", "lang"), s, strict=True)) for s in spans_of(model, t, p)] if len(p) else []
                        for t, p in zip(texts, post, strict=True)
                    ]
                    arrays.append(pa.array(cut, spans))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [f.name for f in kept] + added
    schema = StructType(kept).add("lang_pred", StringType()).add("score", DoubleType())
    if with_spans:
        one = StructType().add("start", IntegerType()).add("end", IntegerType()).add("lang", StringType())
        schema = schema.add("spans", ArrayType(one))
    return picked.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least_score: float = 0.3, **kw) -> DataFrame:
    """docs without the documents that identification rejects (no language, or a score below
    least_score), `lang` being what was identified."""
    found = identify(docs, carry=True, **kw).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.withColumn(kw.get("lang", "lang"), F.col("lang_pred")).select(docs.columns)


def op9_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
