"""Filter interaction audit: what each filter of a chain removes, alone and beside the others, in every order.

Each document has one flag a filter (1: it fails). For every set of filters the cluster sums the product of their
flags, which counts the documents failing all of them; 2 to the number of filters such sums a part, each with and
without a weight, are all that is gathered. The rest is inclusion-exclusion on these joint counts J:

* survivors of a set P: the sum over subsets R of P of (-1)^|R| J(R);
* removed by f after P: the same sum with f added to every R, so redundant is J(f) less that;
* failing f alone: the Moebius inversion of J at {f}, over all supersets;
* Shapley: the documents failing any filter of a set are a game whose Harsanyi dividends are (-1)^(|T|+1) J(T), and
  each is shared evenly by the filters of T. Summed over all orders, not averaged, it stays an integer.

Coefficients depend only on a joint set, the filters before and the filter at hand, so a small fixed table of them
is joined to the joint counts and summed.

Defined results: a null text is empty; a null or empty part is the empty string; a null id is neither smaller nor
larger than another, so such rows fail no identity test; a row whose id is repeated has the labels of all label rows
of its id, and counts as often as it stands there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash
from .rules import bind, words_of

MOST_FILTERS = 6  # 720 orders of 6 steps a part; the number of orders grows as a factorial


def joint_counts(flagged: DataFrame, filters: list[str], part: str, weights: dict[str, Column]) -> DataFrame:
    """(part, joint, one column a weight): the weight of the documents failing all filters of the set ``joint``, a bit mask.

    One aggregation with a partial step on the map side: the rows of a part, hot or not, meet as sums only.
    """
    sums = {}
    for joint in range(1 << len(filters)):
        product = F.lit(1).cast("long")
        for i, f in enumerate(filters):
            if joint >> i & 1:
                product = product * F.col(f)
        sums |= {(joint, k): F.coalesce(F.sum(product * w), F.lit(0)).alias(f"{k}_{joint}") for k, w in weights.items()}
    wide = flagged.groupBy(part).agg(*sums.values())
    rows = [F.struct(F.lit(j).alias("joint"), *[F.col(f"{k}_{j}").alias(k) for k in weights]) for j in range(1 << len(filters))]
    return wide.select(part, F.inline(F.array(*rows)))


def coefficients(n: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(joint, before, filter, kept, removed, failing, alone, shapley): what J(joint) counts for after ``before`` and filter; rows of zeros are left out."""
    out, every = [], (1 << n) - 1
    for f in range(n):
        for before in range(1 << n):
            if before >> f & 1:
                continue
            for joint in range(1 << n):
                size, has = joint.bit_count(), joint >> f & 1
                sign = -1 if size % 2 else 1
                row = (
                    sign if joint & ~(before | 1 << f) == 0 else 0,
                    -sign if has and joint & ~(before | 1 << f) == 0 else 0,
                    int(joint == 1 << f),
                    -sign if has and joint & ~every == 0 else 0,
                    -sign * (math.factorial(n) // size) if has else 0,
                )
                if any(row):
                    out.append((joint, before, f, *row))
    return out


def orders(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, filters before as a mask, filter) of all orders."""
    out = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, before, f))
            before |= 1 << f
    return out


def interactions(flagged: DataFrame, filters: list[str], part: str = "part", weights: dict[str, Column] | None = None) -> DataFrame:
    """One row a part, order of all filters and step, with kept, removed, redundant, unique_fails, shapley, and {name}_lost by weight.

    filters: names of 0/1 columns without nulls, one letter each; weights: further 0/1 columns by name, whose
    removed documents are counted too. The number of rows is that of the parts times n! times n.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, for all their orders are listed")
    spark, weights = flagged.sparkSession, weights or {}
    counted = joint_counts(flagged, filters, part, {"n": F.lit(1).cast("long"), **{k: w.cast("long") for k, w in weights.items()}})
    # Both tables are fixed by the number of filters: 720 orders and 11,000 coefficients at most.
    shares = F.broadcast(spark.createDataFrame(coefficients(len(filters)), "joint int, before int, filter int, c_kept long, c_removed long, c_failing long, c_alone long, c_shapley long"))
    steps = F.broadcast(spark.createDataFrame(orders(filters), "filter_order string, step int, before int, filter int"))
    total = lambda n, c: F.sum(F.col(n) * F.col(c))
    by_step = counted.join(shares, "joint").groupBy(part, "before", "filter").agg(
        total("n", "c_kept").alias("kept"), total("n", "c_removed").alias("removed"), (total("n", "c_failing") - total("n", "c_removed")).alias("redundant"),
        total("n", "c_alone").alias("unique_fails"), total("n", "c_shapley").alias("shapley"), *[total(k, "c_removed").alias(f"{k}_lost") for k in weights],
    )
    return by_step.join(steps, ["before", "filter"]).select(part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{k}_lost" for k in weights], "shapley")


FILTERS = ("A", "B", "C", "D", "E")


def text_flags(text: Column) -> Column:
    """struct of the flags A to D of a text and its digest."""

    def of(t: Column) -> Column:
        capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        sizes = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))
        flag = lambda c: c.cast("int")
        return bind(
            bind(words_of(t), sizes),
            lambda s: F.struct(
                flag(s["n"] < 100).alias("A"), flag(100 * s["distinct"] < 80 * s["n"]).alias("B"), flag(100 * capitals.cast("long") > 10 * F.length(t).cast("long")).alias("C"),
                flag(t.rlike(r"[#$%&*|]")).alias("D"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"),
            ),
        )

    return bind(F.coalesce(text, F.lit("")), of)


def flagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, A to E) of every row of docs.

    Texts are read once and only their digests (SHA-256) leave the scan. The first id of each digest comes from a
    partial aggregation, and rows meet it on digest and id together, so a text with very many copies spreads.
    """
    stash = Stash(docs.sparkSession)
    # The explode keeps later projections from repeating the analysis.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.explode(F.array(text_flags(F.col(text)))).alias("_f"))
    rows = stash.put(rows.select("doc_id", "part", *[F.col("_f")[k].alias(k) for k in (*FILTERS[:4], "digest")]))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("first", F.lit(1))
    out = rows.join(first, ["digest", "doc_id"], "left")
    return out.select("doc_id", "part", *FILTERS[:4], F.when(F.col("doc_id").isNull() | (F.col("first") == 1), 0).otherwise(1).alias("E"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    rows = flagged(docs).join(marks, "doc_id", "left")
    return interactions(rows, list(FILTERS), "part", {k: F.coalesce(F.col(k), F.lit(0)) for k in ("good", "toxic")})


OP11_SQL = r"""
with rows as (
  select d.doc_id, coalesce(d.lang, '') as part, coalesce(d.text, '') as t, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') as w from documents d
), marks as (
  select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels where doc_id is not null group by doc_id
), flags as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(r.doc_id > min(r.doc_id) over (partition by t), false)} as f
  from rows r left join marks using (doc_id)
), patterns as (
  select part, (case when f.A then 'A' else '' end) || (case when f.B then 'B' else '' end) || (case when f.C then 'C' else '' end) || (case when f.D then 'D' else '' end) || (case when f.E then 'E' else '' end) as failed,
    count(*) as n, sum(good) as good, sum(toxic) as toxic
  from flags group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l
), all_orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l
), steps as (
  select filter_order, s::int as step, substr(filter_order, s, 1) as f, substr(filter_order, 1, s - 1) as earlier from all_orders, range(1, 6) x(s)
), counted as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (where translate(failed, earlier || f, '') = failed), 0)::bigint as kept,
    coalesce(sum(n) filter (where contains(failed, f) and translate(failed, earlier, '') = failed), 0)::bigint as removed,
    coalesce(sum(n) filter (where contains(failed, f) and translate(failed, earlier, '') <> failed), 0)::bigint as redundant,
    coalesce(sum(n) filter (where failed = f), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where contains(failed, f) and translate(failed, earlier, '') = failed), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where contains(failed, f) and translate(failed, earlier, '') = failed), 0)::bigint as toxic_lost
  from patterns, steps group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from counted
"""
