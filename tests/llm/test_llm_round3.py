"""Filter audit, lexical search and personal data against plain versions, on small hostile tables."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake.llm import audit, langid, lexical, pii, secrets

from .test_llm_operators import DOCS, HOSTILE, documents, folder

WORDS = "the of and river stone light paper Garden HOUSE window 42 été 日本 über a1 x_y under-score it's 7th".split()


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size = rng.choice([1, 5, 30, 120, 150])
        out.append(rng.choice([" ", "\n", " | "]).join(rng.choices(WORDS + [f"w{rng.randrange(300)}" for _ in range(200)], k=size)))
    return out


# --- filter audit ------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied document by document. docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    flags = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        flags.append((part or "", i, {f for f, x in fails.items() if x}))
    out = []
    for part in {p for p, _, _ in flags}:
        rows, removed_by = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = [(i, f) for p, i, f in flags if p == part], []
            for step, f in enumerate(order, 1):
                removed, left = [(i, s) for i, s in left if f in s], [(i, s) for i, s in left if f not in s]
                redundant = sum(f in s for _, s in gone)
                gone += removed
                removed_by[f] += len(removed)
                rows.append((part, "".join(order), step, f, len(left), len(removed), redundant, sum(s == {f} for p, _, s in flags if p == part), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out += [(*r[:3], *r[4:], removed_by[r[3]]) for r in rows]
    return out


def test_audit_equals_every_order_applied(spark, tmp_path):
    some = texts(3, 60)
    rows = [(i, t, ["en", "de", None, ""][i % 4], "s", 1) for i, t in enumerate(some + some[:20] + HOSTILE + [None, "A#" * 30, "A B C " * 40])]
    rows += [(5, some[5], "en", "s", 1), (None, some[5], "en", "s", 1), (None, None, None, None, None)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 90, 2)] + [(3, None, 1), (None, 1, 1), (4, 1, 0), (4, 0, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("A", F.lit(9)).withColumn("part", F.lit("z"))
    sf = folder(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.op11_filter_audit(spark, sf)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit([r[:3] for r in rows], labels))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    by = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    assert sorted(c.execute(f"select {by} from ({audit.OP11_SQL})").fetchall()) == sorted(map(tuple, got.collect()))


def test_audit_of_an_empty_table_and_of_other_filters(spark, tmp_path):
    sf = folder(spark, tmp_path, documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.op11_filter_audit(spark, sf).count() == 0
    flags = spark.createDataFrame([("p", 1, 0, 1), ("p", 1, 1, 0), ("p", 0, 0, 1), ("q", 0, 0, 0)], "g string, x int, y int, cost int")
    got = {(r["g"], r["filter_order"], r["step"]): r for r in audit.interactions(flags, ["x", "y"], "g", {"cost": F.col("cost")}).collect()}
    assert len(got) == 8 and got["q", "xy", 2]["kept"] == 1
    r = got["p", "yx", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["cost_lost"], r["shapley"]) == (1, 1, 1, 1, 1, 3)
    with pytest.raises(ValueError):
        audit.interactions(flags, list("abcdefg"), "g")


# --- lexical search ----------------------------------------------------------------------------------------


def plain_search(docs, items, most=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, all_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({(i, t) for i, t in items if i is not None}, key=str):
        scores = []
        for i, bag in bags:
            n = sum(bag.values())
            m = 25 + 75 * n * n_docs // max(1, all_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out)


def found(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_search_equals_scoring_every_document(spark, tmp_path, monkeypatch):
    some = texts(5, 150)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(some + some[:30] + HOSTILE + ["river stone " * 4000])] + [(3, some[3], "en", "s", 1), (None, some[3], "en", "s", 1)]
    items = [(i, t) for i, t in enumerate(texts(6, 12) + [some[7], "", None, "zzzz unknown", "the the river"])] + [(1, "stone light"), (1, "stone light"), (None, "river")]
    sf = folder(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS).repartition(3).withColumn("score", F.lit(1)), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    want = plain_search([r[:2] for r in rows], items)
    got = lexical.op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and found(got) == want
    # Many small blocks, tiers of one posting and batches of few items: what is left out is left out by proof only.
    monkeypatch.setattr(lexical, "BATCH_ITEMS", 4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = lexical.build_index(docs, block_bytes=2_000, tiers=((0.0, 1), (0.1, 2), (0.3, 4)))
    assert index.tiers == 4 and index.blocks.count() > 20
    assert found(lexical.search(index, spark.read.parquet(f"{sf}/benchmark.parquet"))) == want


def test_search_with_ties_other_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:02}", "same words here") for i in range(30)] + [("e", "other")], "id string, body string")
    got = lexical.search(lexical.build_index(docs, "id", "body"), spark.createDataFrame([("q", "Same HERE")], "k string, t string"), "k", "t", most=3)
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [("q", 1, "d00"), ("q", 2, "d01"), ("q", 3, "d02")]
    for rows, items in (([], [(1, "a")]), ([(1, "a", "en", "s", 1)], []), ([(1, None, None, None, None)], [(1, "a")])):
        index = lexical.build_index(spark.createDataFrame(rows, DOCS))
        assert lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_slices_of_texts_are_folded_and_counted_alone():
    import pyarrow as pa

    column = pa.array(["Ab-C", None, "", "x", "É É'z", " q", "q "] * 3)
    for a, b in ((0, 21), (3, 9), (5, 6), (1, 3), (0, 0)):
        part = pa.RecordBatch.from_arrays([column.slice(a, b - a)], names=["text"])
        terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in column.to_pylist()[a:b]]
        assert [t.split() for t in lexical.folded(part.column("text")).to_pylist()] == [[re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in t] for t in terms]
        counted = [r for x in lexical._counts(iter([part])) for r in x.to_pylist()]
        assert [sum(r[k] for r in counted) for k in ("documents", "terms")] == [sum(map(bool, terms)), sum(map(len, terms))]


def test_lower_tiers_are_reached_only_without_proof(spark):
    """An item whose bounds lie under the bar yields nothing from a block before its last tier."""
    import numpy as np

    docs = spark.createDataFrame([(i, "rare " * (5 if i == 0 else 1) + "common " * (1 + i % 3) + f"u{i} " * 30) for i in range(300)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(docs, tiers=((0.0, 4),))
    row = index.blocks.toArrow().to_batches()[0]
    import pyarrow as pa

    block = lexical.Block(row, 0, pa.array(["rare", "common"]), index.tiers)
    bounds = list(block.bounds(np.array([0, 1]), np.array([100, 1])))
    exact = bounds[-1][0]
    assert len(bounds) == 2 and bounds[0][1] >= exact.max() and (bounds[0][0] <= exact).all() and (bounds[0][0] > 0).sum() <= 8


# --- personal data -----------------------------------------------------------------------------------------

PERSONAL = [
    "mail a.b+c@x-y.example.com, c@d.e@f.g and @h.i or j@k", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.255 1.1.1", "card 4539 1488 0343 6467 and 4539-1488-0343-6468 and 4539148803436467",
    "+1 (555) 123-4567. +49 30 1234 and +123 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "x@y.z1.2.3.4", "é" * 9 + "q@r.st +4412345678", "0" * 5000 + ".1.1.1", "1.1.1." + "9" * 5000, "a" * 50_000 + " " + "@" * 5000, "+1" + "(" * 20_000, "1 2-3 4  5" * 500,
]


def test_fixed_patterns_equal_plain_ones(spark, tmp_path):
    rng = random.Random(4)
    noise = ["".join(rng.choices("12.5+- @aé.()9\n", k=rng.randrange(60))) for _ in range(400)]
    every = PERSONAL + HOSTILE + noise
    sf = folder(spark, tmp_path, documents=documents(spark, every, extra=True).repartition(3))
    got = {r["doc_id"]: r for r in pii.op13_pii(spark, sf).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        if t and len(t) > 40_000:
            t = t[-6000:]  # the plain patterns take the square of a long run; what is found lies behind it
            assert pii.brute_force(t)[:4] == (got[i]["n_email"], got[i]["n_ip"], got[i]["n_card"], got[i]["n_phone"])
            continue
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == pii.brute_force(t), t


def plain_extraction(rows):
    """The method without Spark or numpy: {row number: found spans}."""
    tokens = lambda t: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D:=]+[:=]*|[:=]+", t)]
    form = lambda w: re.sub("[0-9]+", "0", w.lower().strip("\"'()[]{}<>"))
    numeric = lambda w: bool(re.fullmatch(r"[0-9().+-]*[0-9][0-9().+-]*", w))
    value = lambda s: re.sub("[^0-9a-z]", "", s.lower())
    met, seeds, unseen, spots = Counter(), defaultdict(set), defaultdict(set), []
    distinct = defaultdict(set)
    known = defaultdict(set)
    for n, t in enumerate(rows):
        t = t or ""
        toks, base = tokens(t), pii.base_spans(t)
        words = [form(t[a:b]) for a, b in toks]
        at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: B023, E731
        shapes = lambda i, j: [("l", at(i - 1)), ("ll", at(i - 2), at(i - 1)), ("lr", at(i - 1), at(j + 1)), ("r", at(j + 1)), ("rr", at(j + 1), at(j + 2))]  # noqa: B023, E731
        taken = set()
        for kind, a, b in base:
            own = [i for i, (x, y) in enumerate(toks) if x < b and a < y]
            taken |= set(own)
            known[value(t[a:b])].add(kind)
            for p in shapes(own[0], own[-1]):
                seeds[p, kind].add(value(t[a:b]))
                distinct[p].add(value(t[a:b]))
        i = 0
        while i < len(toks):
            j, (a, b) = i, toks[i]
            if i in taken:
                i += 1
                continue
            if numeric(t[a:b]):
                while j + 1 < len(toks) and j + 1 not in taken and t[toks[j][1] : toks[j + 1][0]] == " " and numeric(t[slice(*toks[j + 1])]):
                    j += 1
                b = toks[j][1]
            s = t[a:b]
            while s and not (s[0].isalnum() or s[0] in "+("):
                s, a = s[1:], a + 1
            while s and not s[-1].isalnum():
                s, b = s[:-1], b - 1
            digits = sum(c in "0123456789" for c in s)
            if len(value(s)) >= 6 and ("@" in s or digits >= 3) and len(s) <= 64:
                spots.append((n, a, b, value(s)))
                for p in shapes(i, j):
                    unseen[p].add(value(s))
                    distinct[p].add(value(s))
            else:
                for p in shapes(i, j):
                    met[p] += 1
            i = j + 1
    supported = {k: len(v) for k, v in seeds.items() if len(v) >= pii.LEAST_SUPPORT}
    score: dict = {}
    for _ in range(pii.ROUNDS):
        sure = {(p, k): (s + sum(score.get((v, k), 0) for v in unseen[p])) / (met[p] + len(distinct[p]) + 1) for (p, k), s in supported.items()}
        miss: dict = defaultdict(lambda: 1.0)
        for (p, k), c in sure.items():
            if c >= pii.LEAST_CONFIDENCE:
                for v in unseen[p]:
                    miss[v, k] *= 1 - c
        score = {x: 1 - m for x, m in miss.items()} | {(v, k): 1.0 for _, _, _, v in spots for k in known[v]}
    out = defaultdict(list)
    for n, a, b, v in spots:
        best = max(((round(score[v, k], 9), -k) for k in range(4) if (v, k) in score), default=(0, 0))
        if best[0] >= pii.LEAST_SCORE:
            out[n].append((f"found_{pii.KINDS[-best[1]]}", a, b))
    return {n: sorted(x, key=lambda s: (pii.KINDS.index(s[0][6:]), *s[1:])) for n, x in out.items()}


def personal_corpus():
    rng = random.Random(8)
    word = lambda: rng.choice(WORDS[:10])
    prose = lambda k: " ".join(word() for _ in range(k))
    number = lambda: f"({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    rows, planted = [], {}
    for i in range(60):
        rows.append(f"{prose(9)} Phone: +1 {number()} {prose(5)}")
        rows.append(f"{prose(6)} {rng.randrange(10**6, 10**7)} {prose(4)} {rng.randrange(99)} in 1998 and +49 30 {rng.randrange(10**6, 10**7)} {prose(3)}")
    for i in range(9):
        s = number()
        t = f'{prose(7)} phone:{"" if i % 2 else " "}{s} {prose(6)}'
        planted[len(rows)] = [("found_phone", t.index(s), t.index(s) + len(s))]
        rows.append(t)
    rows += [f"order: {rng.randrange(10**7, 10**8)} {prose(8)}" for _ in range(20)] + ["the release 2024-01-01 of version 10.2.33 and id a1b2c3d4", "the the 123456 the"]
    return rows, planted


def test_contexts_find_unseen_numbers_and_leave_others_alone(spark):
    rows, planted = personal_corpus()
    got = {r["doc_id"]: r["pii_spans"] for r in pii.scan(documents(spark, rows + rows[:5] + HOSTILE).repartition(4)).collect()}
    own = {i: [tuple(s) for s in spans if s["kind"].startswith("found_")] for i, spans in got.items()}
    own = {i: s for i, s in own.items() if s}
    assert own == planted  # the numbers after "phone:", no order numbers, dates, versions or bare numbers
    assert own == plain_extraction(rows + rows[:5] + HOSTILE)


def test_respelled_seeds_and_empty_tables(spark):
    docs = documents(spark, ["call +1 (555) 123-4567 now", "or 1 555 123-4567 then", "not 1 555 123-4568", None])
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.scan(docs).collect()}
    assert got == {0: [("phone", 5, 22)], 1: [("found_phone", 3, 17)], 2: [], 3: []}
    assert pii.scan(documents(spark, [])).count() == 0
    assert pii.scan(docs.withColumn("row", F.lit(1)).withColumn("spans", F.lit(2)), keep=("row", "spans", "doc_id")).columns == ["row", "spans", "doc_id", "pii_spans"]


# --- earlier operators -------------------------------------------------------------------------------------


def test_long_words_of_prose_are_no_secrets(spark):
    """Words that the vocabulary does not know, as the prose of the sample tables has them."""
    enc = secrets.encoding(secrets.VOCABULARY)
    for t in ("so einpfauaueinchpf und einieerpfverkeit.", "the edtionrereinsh.78@mail of", "Rindfleischetikettierungsüberwachung KRANKENVERSICHERUNGSANSTALT"):
        assert secrets.random_spans(t, secrets.base_spans(t), enc, secrets.MOST_CHARS_PER_TOKEN) == [], t
    import os

    if os.path.exists("/root/testdata/sf0.01/documents.parquet"):
        found = secrets.op1_secret_scan(spark, "/root/testdata/sf0.01")
        assert found.where("n_random > 0").count() == 0


def test_more_languages_than_five_hundred_are_all_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join([letters[i % 26] + letters[i // 26] * 2 + letters[(i * 7) % 26]] * 6), f"l{i:03}", "s", 1) for i in range(510)]
    assert len(langid.fit(spark.createDataFrame(rows, DOCS), buckets=1 << 10, epochs=1).languages) == 510
