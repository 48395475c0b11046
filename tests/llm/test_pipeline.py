"""The corpus pipeline against a plain version of its stages: no Spark, no numpy, all pairs."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import langid, rules, secrets
from auditlake.llm.common import crc_mod

from .test_llm_operators import DOCS, HOSTILE, LANGUAGES, check_packed, closure, plain_measures, plain_posteriors, plain_set, prose
from .test_llm_scores import gram_buckets, words_of


def corpus(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(60, 120), LANGUAGES[k] + " " + " ".join(f"{k}{j}x" for j in range(400))), k, "s", 9) for i, k in ((i, rng.choice(list(LANGUAGES))) for i in range(120))]
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", 9) for i in range(10)]
    rows += [(300, rows[0][1] + " password=abcdef123", "en", "s", 9), (301, rows[1][1] + " key qB7xK2mZ9tR4wL8vN3pJ6hY1 end", "en", "s", 9)]
    rows += [(310 + i, " ".join(w + "###" for w in rows[i][1].split()), "en", "s", 9) for i in range(8)]
    rows += [(320, rows[2][1] * 40, "fr", "s", 9), (321, " ".join(f"en{rng.randrange(400)}x" for _ in range(30_000)), "en", "s", 9), (322, "Съешь же ещё этих мягких французских булок да выпей чаю " * 9, None, "s", 9)]
    rows += [(400 + i, t, None, None, None) for i, t in enumerate(HOSTILE)]
    return spark.createDataFrame(rows, DOCS), rows


def plain_languages(rows, model):
    import regex

    kept, chance = [], min(float(model.seen.mean()), 0.999)
    for r in rows:
        letters = [regex.sub(r"[^\p{L}\p{M}]+", "", w) for w in words_of((r[1] or "").lower()) if regex.search(r"\p{L}", w)]
        grams = [b for w in letters for b in gram_buckets(w, langid.ORDERS, langid.BUCKETS)]
        if grams and (sum(bool(model.seen[b]) for b in grams) / len(grams) - chance) / (1 - chance) >= langid.LEAST_EVIDENCE:
            kept.append(r)
    return kept


def plain_votes(t):
    n, chars, symbols, dup, repeat = plain_measures(t)
    if not n:
        return (0,) * len(rules.RULES)
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    caps = sum(w.upper() == w and w.lower() != w and len(w) > 1 for w in words)
    letters = sum(c.isalpha() for c in t) / chars
    by = lambda good, bad: -1 if bad else int(good)
    marked, stops, marks = (sum(any(c in "#*$%&|<>" for c in w) for w in words) / n, t.count(".") / n, t.count("!") / n)
    fresh = len(set(words)) / n**0.5
    return (
        by(n >= 80, n < 50), by(3 <= chars / n <= 10, chars / n < 2.5 or chars / n > 12), by(symbols / n < 0.05, symbols / n > 0.2), by(marked < 0.03, marked > 0.15), by(letters > 0.85, letters < 0.7), by(dup / len(lines) < 0.1, dup / len(lines) > 0.3),
        by(repeat / n < 0.2, repeat / n > 0.5), by(caps / n < 0.1, caps / n > 0.4), by(marks < 0.1, marks > 0.3), by(0.01 <= stops <= 0.5, stops < 0.002 and n > 150), by(fresh > 4, fresh < 2 and n >= 50),
    )


def plain_rules(rows):
    good, _, _ = plain_posteriors([plain_votes(r[1] or "") for r in rows], rounds=150)
    measured = [plain_measures(r[1]) for r in rows]
    return [r for r, p, (n, *_, repeat) in zip(rows, good, measured, strict=True) if p >= 0.5 and n >= 50 and 100 * repeat <= 50 * n]


def plain_duplicates(rows):
    sets = {r[0]: plain_set(r[1], 5) for r in rows}
    links = defaultdict(set)
    for i, j in itertools.combinations(sets, 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            links[i].add(j), links[j].add(i)
    component = closure(sets, links)
    return [r for r in rows if component[r[0]] == r[0]]


def plain_secrets(rows):
    enc, out = secrets.encoding(secrets.VOCABULARY), []
    for r in rows:
        base = [(k, *m.span()) for k, p in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX)) for m in re.finditer(p, r[1], re.A | (re.I if k == "assign" else 0)) if {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}[k](m)]
        hidden = set()
        for _, a, b in base + secrets.random_spans(r[1], base, enc, secrets.MOST_CHARS_PER_TOKEN):
            hidden |= set(range(a, b))
        text, at = "", 0
        for hide, run in itertools.groupby(range(len(r[1])), key=lambda i: i in hidden):
            n = len(list(run))
            text, at = text + ("[secret]" if hide else r[1][at : at + n]), at + n
        out.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)))
    return out


def test_stages_equal_a_plain_version(spark, tmp_path):
    df, rows = corpus(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    plain = {"language_id": lambda r: plain_languages(r, model), "quality_rules": plain_rules, "minhash_near_dedup": plain_duplicates, "secret_scan": plain_secrets}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = plain[name](rows)
        assert docs.columns == before.columns, name
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
    ids = {r[0] for r in rows}
    assert {i for i in range(120)} <= ids and not ids & {*range(200, 210), *range(310, 318), 322, 400, 401, 402, 403}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: r[0])
    place = {r[0]: i for i, r in enumerate(order)}
    assert {r["doc_id"] for r in packed} == ids
    check_packed([{**r.asDict(), "doc_id": place[r["doc_id"]]} for r in packed], [r[1] for r in order], 4096)


def test_stages_on_no_documents_and_on_clashing_columns(spark, tmp_path):
    df, _ = corpus(spark)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    odd = df.where("doc_id < 20").unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit("mine") for c in ("kept", "lang_pred", "score", "quality_probability", "component_id", "secret_spans", "piece")})
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} == {None, *range(20)}


def test_stages_are_the_named_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "minhash_near_dedup", "secret_scan", "best_fit_packing"]
