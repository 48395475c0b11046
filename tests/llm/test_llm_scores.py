"""Scores, spans and edge cases of the training-data operators, against plain Python that shares no code with them."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from auditlake.llm import bpe, chat, langid, minhash, ngrams, packing, quality, rules, secrets, urls

from .test_llm_operators import HOSTILE, LANGUAGES, documents, folder, prose

M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M
    return x ^ (x >> 33)


def gram_buckets(word, orders, buckets):
    marked, out = f"<{word}>", []
    for at in range(len(marked)):
        key = 0
        for n, c in enumerate(marked[at : at + max(orders)], 1):
            key = (key * 0x100000001B3 + n & M) ^ (ord(c) * ngrams._MIX & M)
            if n in orders:
                out.append(mixed(key) % buckets)
    return out


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


TEXTS = HOSTILE + ["Ünder der Straße 12 don't", "a-b c_d e.f", "x x x y", "日本 語", "é" * 300] + [prose(random.Random(k), 40, LANGUAGES["de"]) for k in range(5)]


def test_language_scores_equal_a_plain_sum(spark):
    import regex

    rng = random.Random(1)
    texts, labels = zip(*[(prose(rng, 25, LANGUAGES[k]), k) for k in rng.choices(list(LANGUAGES), k=90)], strict=True)
    model = langid.train(list(texts), list(labels), buckets=4096)
    for r in langid.predict(documents(spark, TEXTS), model).collect():
        letters = [regex.sub(r"[^\p{L}\p{M}]+", "", w) for w in words_of((r["text"] or "").lower()) if regex.search(r"\p{L}", w)]
        grams = [b for w in letters for b in gram_buckets(w, langid.ORDERS, 4096)]
        if not letters:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = [(sum(model.weight[b, c] for b in grams) / len(grams) + model.bias[c]) / model.temperature for c in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(3), key=lambda c: p[c])
        assert r["score"] == pytest.approx(p[best] / sum(p), abs=1e-9) and (r["lang_pred"] == model.languages[best] or p.count(p[best]) > 1)


def test_quality_scores_equal_a_plain_sum(spark):
    rng = random.Random(2)
    texts = [prose(rng, 30) if k % 2 else " ".join(w.upper() for w in prose(rng, 30).split()) for k in range(60)]
    model = quality.train(texts, [k % 2 for k in range(60)])
    size = quality.BUCKETS
    for r in quality.score(documents(spark, TEXTS), model).collect():
        words = words_of(TEXTS[r["doc_id"]])
        keys = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        found = [k % size for k in keys] + [b for w in words for b in gram_buckets(w, quality.ORDERS, size)]
        found += [0 if a == b else mixed((a * ngrams._MIX + b) & M) % size for a, b in zip(keys, keys[1:], strict=False)]
        z = sum(model.weight[b] for b in found) / max(len(found), 1) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_a_language_that_was_not_learned_is_rejected(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 40, LANGUAGES[lang]), lang) for k, lang in enumerate(rng.choices(list(LANGUAGES), k=120))]
    rows += [(500, "Съешь же ещё этих мягких французских булок да выпей чаю", None), (501, "日本語のテキストはここにあります", None), (502, "zxq wvkj qpzx mnbv xkcd qwrt", None)]
    kept = {r["doc_id"] for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(120))


def test_tables_with_nothing_or_repeated_rows(spark, tmp_path):
    """Empty tables give empty results, repeated rows are judged row by row, own columns of those names stay."""
    docs = documents(spark, HOSTILE, extra=True).withColumns({c: F.lit("mine") for c in ("secret_spans", "ids", "lang_pred", "quality_probability", "sequence_id", "offset", "host")})
    two = docs.union(docs)
    model = langid.train(["der und", "the and"] * 4, ["de", "en"] * 4, buckets=512)
    for make in (secrets.scan, secrets.redact, bpe.encode, lambda d: langid.predict(d, model), rules.keep_good, minhash.keep_first):
        assert make(docs.limit(0)).count() == 0
    for make in (secrets.scan, bpe.encode, lambda d: langid.predict(d, model)):
        out = make(two)
        assert out.count() == 2 * len(HOSTILE) and set(docs.columns) < set(out.columns)
        assert out.where("secret_spans = 'mine' and ids = 'mine' and lang_pred = 'mine'").count() == 2 * len(HOSTILE)
    ids = spark.createDataFrame([(None, "one two"), (1, None), (None, "one two")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.pack(ids).collect()) == [(0, 3), (0, 3), (1, 1)]
    assert {r["component_id"] for r in minhash.classes(ids).collect()} == {None, 1}
    assert bpe.op7_byte_bpe(spark, folder(spark, tmp_path, documents=docs.limit(0))).count() == 0


def test_labels_of_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (1, "good words here", "x"), (2, "BAD!!", "x"), (None, "odd", "x")], "doc_id long, text string, _label string").withColumns({"score": F.lit(1), "held_out": F.lit(1)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs.select("doc_id", "text"), labels)).count() == 4


def test_texts_of_other_languages_under_one_id(spark):
    rows = [(1, "der und nicht", "de"), (1, "the and of", "en"), (1, "der und nicht", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "the", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]


def test_random_spans_cover_planted_keys_only(spark):
    """Whole words of prose and identifiers stay, random keys between them are found whole."""
    rng, enc = random.Random(7), secrets.encoding(secrets.VOCABULARY)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = 0
    for _ in range(200):
        key = "".join(rng.choices(letters, k=rng.randint(24, 48)))
        before, after = prose(rng, rng.randint(1, 20)), prose(rng, rng.randint(1, 20))
        text = f"{before} {key} {after} my_long_identifier_name_2 2024-01-02T03:04:05"
        found = secrets.random_spans(text, secrets.base_spans(text), enc, secrets.MOST_CHARS_PER_TOKEN)
        at = len(before) + 1
        hits += found == [("random", at, at + len(key))]
        assert all(at <= a and b <= at + len(key) for _, a, b in found)
    assert hits >= 190
    many = " ".join("".join(rng.choices("0123456789abcdef", k=30)) for _ in range(4000))
    assert len(secrets.base_spans(many)) == 4000 and not secrets.random_spans(many, secrets.base_spans(many), enc, 2.2)


def test_urls_that_repeat_or_are_very_long(spark):
    long = "https://a.example.com/en/" + "x" * 200_000
    rows = [(1, long), (1, long), (2, "https://" + "a." * 5_000 + "net/de/1"), (2, None)]
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).collect())
    assert got == [(1, "com/en/", "block"), (1, "com/en/", "block"), (2, "", "allow"), (2, "net/de/", "allow")]


def test_conversations_of_nothing_and_null_parts(spark):
    kind = "conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,ref:string,units:long>>"
    rows = [(1, 1, "user", "hi", [None, ("image", None, "r", 784 * 3), ("text", "a<|b", None, None)]), (1, 2, "assistant", None, None)]
    df = spark.createDataFrame(rows, kind)
    assert chat.format_chats(df.limit(0)).count() == 0
    out = chat.format_chats(df, parts="parts").first()
    assert "<|image|>a<\\|b" in out["formatted"] and [a["tokens"] for a in out["attachments"]] == [0, 3]


def test_worker_keeps_one_vocabulary_only():
    """A task of another kind drops what the one before it left."""
    from auditlake.llm import common

    first = common.resource("ranks x", lambda: np.zeros(10))
    assert common.resource("ranks x", lambda: np.ones(10)) is first
    common.only("words y")
    assert not common._kept
