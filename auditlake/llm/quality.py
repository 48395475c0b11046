"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed to learned vectors; a document is the mean
of its features' vectors; a softmax layer turns it into class probabilities; both are trained by plain
stochastic gradient descent in numpy on a bounded sample of labelled documents. Scoring needs only each
feature's share of the log-odds, one number per bucket, so a document costs a sum over its words.

Bounds: at most about ``per_class`` documents of each label are sampled (by hash of the id, whole texts).
The sample's label shares differ from those of all labels, so the log-odds are shifted to the latter.

Defined results: null, empty and wordless texts have the score of the label shares alone; rows that repeat are
scored each; an id labelled twice takes the mean label, 1 from a half on; without labels of both kinds every
score is the share of label 1 (0.5 without any); an empty table gives an empty result; other columns of docs
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, in_arrow, slices
from .ngrams import char_ngrams, pair_buckets, split_words, word_keys

BUCKETS = 1 << 18
ORDERS = (3, 4, 5)


@dataclass
class Model:
    weight: object  # one number per bucket: its share of the log-odds of label 1
    bias: float


def features(texts: pa.Array, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> tuple:
    """(bucket, text) pairs of all features; texts without words have none."""
    import numpy as np

    words, index, bounds = split_words(texts)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = word_keys(words)
    unigram = (keys % np.uint64(buckets)).astype(np.int64)
    grams, of = char_ngrams(words, orders, buckets)
    size = np.bincount(of, minlength=len(words))
    start = np.concatenate([[0], np.cumsum(size)])[:-1] if len(words) else np.empty(0, np.int64)
    grams = grams[np.argsort(of, kind="stable")]
    n = size[index] if len(index) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(start[index] - ends[:-1], n) + np.arange(ends[-1]) if len(index) else np.empty(0, np.int64)
    pair, of_pair = pair_buckets(keys, index, bounds, buckets)
    return np.concatenate([unigram[index], grams[take], pair]), np.concatenate([owner, np.repeat(owner, n), of_pair])


def log_odds(texts: pa.Array, model: Model, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
    """Log-odds of label 1: the mean of the features' shares and the bias."""
    import numpy as np

    words, index, bounds = split_words(texts)
    rows = len(bounds) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    keys = word_keys(words)
    grams, of = char_ngrams(words, orders, buckets)
    share = np.bincount(of, weights=model.weight[grams], minlength=len(words)) + model.weight[(keys % np.uint64(buckets)).astype(np.int64)]
    size = np.bincount(of, minlength=len(words)) + 1
    pair, of_pair = pair_buckets(keys, index, bounds, buckets)
    total = np.bincount(owner, weights=share[index], minlength=rows) + np.bincount(of_pair, weights=model.weight[pair], minlength=rows)
    n = np.bincount(owner, weights=size[index], minlength=rows) + np.bincount(of_pair, minlength=rows)
    return total / np.maximum(n, 1) + model.bias


def train(texts: list[str | None], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 7, buckets: int = BUCKETS) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to zero."""
    import numpy as np

    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    rows = []
    for a in range(0, len(texts), 50):
        bucket, of = features(pa.array(texts[a : a + 50], pa.string()), buckets)
        key, n = np.unique(of * buckets + bucket, return_counts=True)
        cuts = np.searchsorted(key // buckets, np.arange(1, len(texts[a : a + 50])))
        rows += [(k.astype(np.int32), c.astype(np.float32) / max(1, c.sum())) for k, c in zip(np.split(key % buckets, cuts), np.split(n, cuts), strict=True)]
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, share = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(bucket):
                continue
            hidden = share @ embed[bucket]
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            embed[bucket] -= lr * share[:, None] * back
    return Model((embed @ (out[1] - out[0])).astype(np.float64), 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1_500, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> Model:
    """Fits on labelled documents: docs and labels are what may be learned from, held-out rows already gone."""
    import math

    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    known = one.join(docs.where(F.col(doc_id).isNotNull()).select(doc_id).distinct(), doc_id, "left_semi")
    count = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    if not n0 or not n1:
        import numpy as np

        share = (n1 + 1) / (n0 + n1 + 2) if n0 + n1 else 0.5
        return Model(np.zeros(options.get("buckets", BUCKETS)), math.log(share / (1 - share)))
    rate = F.when(F.col("_label") == 1, min(1.0, per_class / n1)).otherwise(min(1.0, per_class / n0))
    unit = F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Two classes of about per_class ids: a bounded side.
    sample = known.where(unit < rate)
    texts = docs.select(doc_id, F.col(text).alias("_text")).join(F.broadcast(sample), doc_id).groupBy(doc_id, "_label").agg(F.min("_text").alias("_text"))
    rows = sorted(texts.toLocalIterator(), key=lambda r: str(r[doc_id]))
    model = train([r["_text"] for r in rows], [r["_label"] for r in rows], **options)
    m1 = sum(r["_label"] for r in rows)
    # From the sample's shares to those of all labels.
    model.bias += math.log(n1 / n0) - math.log(max(m1, 1) / max(len(rows) - m1, 1))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; one narrow pass."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(F.col(doc_id), 3) == 1).alias("held_out"), F.col(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                z = log_odds(part.column("text"), model)
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return in_arrow(rows, each, StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learn = lambda df: df.where(crc_mod(F.col("doc_id"), 3) != 1)
    return score(docs, fit(learn(docs), learn(labels)))
