"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to four code points within lower-cased words of letters; a term's weight is
its share of the document's n-grams times its inverse document frequency. Training follows the regularised
leader per coordinate (FTRL-proximal) with an elastic net, so that most weights are exactly zero; a temperature,
fitted on a part of the sample that training does not see, calibrates the probabilities.

Bounds: about ``per_language`` documents of each language are sampled by hash of the id (whole texts); every
language is learned, rare ones from all their documents. Frequencies of documents come from that sample: held-out
texts are not to be learned from.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
document everything is; with one language, that is the answer, score 1; ties go to the language first in
order; rows that repeat are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import crc_mod, free_name, in_arrow, release_memory, slices
from .ngrams import char_ngrams, split_words

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts of a learned language have over 0.9 on all sample tables, Polish 0.55 and Russian 0.1 where neither is learned.
LEAST_EVIDENCE = 0.7


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weight: object = None  # buckets x languages, idf included
    bias: object = None
    temperature: float = 1.0
    seen: object = None  # by bucket: whether an n-gram of the training texts falls into it


def _letters(words: list[str]) -> list[str]:
    import regex

    strip = regex.compile(r"[^\p{L}\p{M}]+")
    some = regex.compile(r"\p{L}")
    return [w if w.isalpha() else strip.sub("", w) if some.search(w) else "" for w in map(str.lower, words)]


def _prepared(texts: pa.Array, buckets: int) -> tuple:
    """What features and scores share: n-grams by distinct word, words by text."""
    import numpy as np

    words, index, bounds = split_words(texts)
    letters = _letters(words)
    grams, of = char_ngrams(letters, ORDERS, buckets)
    empty = np.fromiter((not w for w in letters), bool, len(letters))
    keep = ~empty[of] if len(of) else np.empty(0, bool)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return grams[keep], of[keep], index, owner, len(letters), len(bounds) - 1, ~empty


def _rows(texts: list[str | None], buckets: int) -> list[tuple]:
    """(buckets, shares) of each text."""
    import numpy as np

    out = []
    for a in range(0, len(texts), 50):
        grams, of, index, owner, n_words, n, _ = _prepared(pa.array(texts[a : a + 50], pa.string()), buckets)
        # words by text first, so that each distinct word of a text is spread once
        key, times = np.unique(owner * max(n_words, 1) + index, return_counts=True) if len(index) else (np.empty(0, np.int64), np.empty(0, np.int64))
        size = np.bincount(of, minlength=n_words)
        order = np.argsort(of, kind="stable")
        start = np.concatenate([[0], np.cumsum(size)])[:-1] if n_words else np.empty(0, np.int64)
        word, text = key % max(n_words, 1), key // max(n_words, 1)
        m = size[word] if n_words else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
        take = np.repeat(start[word] - ends[:-1], m) + np.arange(ends[-1]) if n_words else np.empty(0, np.int64)
        full = np.repeat(text, m) * buckets + grams[order][take]
        feature, where = np.unique(full, return_inverse=True)
        share = np.bincount(where, weights=np.repeat(times, m), minlength=len(feature))
        cuts = np.searchsorted(feature // buckets, np.arange(1, n))
        for f, s in zip(np.split(feature % buckets, cuts), np.split(share, cuts), strict=True):
            out.append((f.astype(np.int32), s / max(s.sum(), 1)))
    return out


def train(texts: list[str | None], labels: list[str], buckets: int = BUCKETS, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, scale: float = 30.0, seed: int = 11) -> Model:
    import numpy as np

    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((buckets, len(languages))), np.zeros(len(languages)))
    label = np.array([languages.index(x) for x in labels])
    rows = _rows(texts, buckets)
    df = np.zeros(buckets)
    for f, _ in rows:
        df[f] += 1
    idf = np.where(df > 0, np.log((1 + len(rows)) / (1 + df)) + 1, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    k = len(languages)
    z, n = np.zeros((buckets, k)), np.zeros((buckets, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def proximal(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def softmax(x):
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    for _ in range(epochs):
        for i in rng.permutation(learn):
            f, share = rows[i]
            if not len(f):
                continue
            x = share * idf[f] * scale
            zf, nf = z[f], n[f]
            w, b = proximal(zf, nf), proximal(zb, nb)
            p = softmax(x @ w + b)
            p[label[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f] = zf + g - step * w
            n[f] = nf + g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * b
            nb += p * p
    weight, bias = proximal(z, n), proximal(zb, nb)
    model = Model(languages, weight * idf[:, None] * scale, bias, seen=df > 0)
    logits = np.array([s @ model.weight[f] + bias for f, s in (rows[i] for i in held)]).reshape(-1, k)
    if len(logits):
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 120))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), label[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, per_language: int = 700, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> Model:
    """Fits on docs with a language; held-out rows are already gone. Every language is learned, so the model grows with their number."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_lang is not null and _text is not null")
    count = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not count:
        return Model()
    rate = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, per_language / n))])
    unit = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(unit < F.coalesce(F.try_element_at(rate, F.col("_lang")), F.lit(0.0)))
    sample = sorted(sample.distinct().toLocalIterator(), key=lambda r: (str(r["_id"]), r["_lang"], r["_text"]))
    model = train([r["_text"] for r in sample], [r["_lang"] for r in sample], **options)
    del sample
    release_memory()  # the driver goes on with other work
    return model


def log_odds(texts: pa.Array, model: Model, chunk: int = 10_000) -> tuple:
    """(logits, whether a text has a letter, evidence): sums of the words' shares over the number of n-grams.

    Evidence is the share of a text's n-grams that training saw, less what chance would give: 1 if all are known,
    about 0 for a script or language that was never learned.

    Distinct words are looked at ``chunk`` at a time, so that n-grams of few words are held at once.
    """
    import numpy as np

    buckets, k = model.weight.shape
    words, index, bounds = split_words(texts)
    letters = _letters(words)
    share, size, known = np.zeros((len(words), k)), np.zeros(len(words)), np.zeros(len(words))
    seen = np.ones(buckets) if model.seen is None else model.seen.astype(float)
    lettered = np.fromiter((bool(w) for w in letters), bool, len(letters))
    for i in range(0, len(letters), chunk):
        some = letters[i : i + chunk]
        grams, of = char_ngrams(some, ORDERS, buckets)
        size[i : i + chunk] = np.bincount(of, minlength=len(some))
        known[i : i + chunk] = np.bincount(of, weights=seen[grams], minlength=len(some))
        for c in range(k):
            share[i : i + chunk, c] = np.bincount(of, weights=model.weight[grams, c], minlength=len(some))
    share[~lettered], size[~lettered], known[~lettered] = 0, 0, 0
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    by_text = lambda x: np.bincount(owner, weights=x[index], minlength=n) if len(index) else np.zeros(n)
    total = by_text(size)
    z = np.stack([by_text(share[:, c]) / np.maximum(total, 1) + model.bias[c] for c in range(k)], 1)
    filled = min(float(seen.mean()), 0.999) if model.seen is not None else 0.0
    evidence = (by_text(known) / np.maximum(total, 1) - filled) / (1 - filled)
    return z, by_text(lettered.astype(float)) > 0, evidence


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "evidence")) -> DataFrame:
    """docs with the predicted language, its calibrated probability, and the evidence for any; one narrow pass."""
    a, b, c = (free_name(docs, x) for x in names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in slices(batch, text, 2_000_000):
                if model.languages:
                    z, has, evidence = log_odds(part.column(text), model)
                    z = z / model.temperature
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    lang = [model.languages[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score = np.where(has, p[np.arange(len(p)), best], 0.0)
                else:
                    lang, score, evidence = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(evidence, pa.float64())], names=[*part.schema.names, a, b, c])

    return in_arrow(docs, each, StructType([*docs.schema.fields, StructField(a, StringType()), StructField(b, DoubleType()), StructField(c, DoubleType())]))


def keep_known(docs: DataFrame, least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and with enough evidence; columns as they are.

    The best of the learned languages says little of a text in none of them, and its score is never low where few
    are learned. So a text goes if its n-grams are mostly ones that training never saw.

    Learns from the documents' own labels under the same split as the query. Without any label nothing can be
    recognised, so only texts without a letter go.
    """
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    a, b, c = (free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_evidence"))
    return predict(docs, model, names=(a, b, c)).where((F.col(a) != UNKNOWN) & (F.col(c) >= least_evidence)).select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
