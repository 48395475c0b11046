"""Several readers of one thing put together, and ordered lists put together: the first that counts wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.engine import first_rows
from .vitals import number, string

NOT_SET_UP = "the reader for this platform is not set up"


def composed(asked: DataFrame, reads: list[DataFrame], key: list[str]) -> DataFrame:
    """asked's keys with status, title and note from several readers in order of preference.

    reads: key, status (found, not_found or unreadable), title, note. The first reader's clear answer (found or
    not_found) stands. Otherwise the first later one that found it does, with the notes of those before it put after its
    own, so that a reason is not hidden behind a thinner answer; where none found it, the first reader's answer stands.
    A key that no reader knows is unreadable. All tables meet in one grouping; of rows of one reader and key the least counts.
    """
    every = asked.select(*key, F.lit(-1).alias("rank"), *[F.lit(None).cast("string").alias(c) for c in ("status", "title", "note")])
    for i, r in enumerate(reads):
        every = every.unionByName(r.select(*key, F.lit(i).alias("rank"), "status", "title", "note"))
    answer = F.struct("status", "title", "note")
    one = every.groupBy(*key).agg(F.count_if(F.col("rank") == -1).alias("asked"), *[F.min(F.when(F.col("rank") == i, answer)).alias(f"r{i}") for i in range(len(reads))]).where("asked > 0")
    given = F.array_compact(F.array(*[f"r{i}" for i in range(len(reads))]))
    return one.withColumn("given", given).select(*key, _chosen(F.col("given")).alias("c")).select(*key, "c.status", "c.title", "c.note")


def _chosen(given: Column) -> Column:
    first = F.get(given, F.lit(0))
    later = F.filter(F.transform(given, lambda x, i: F.struct(i.alias("i"), x["status"].alias("status"), x["title"].alias("title"), x["note"].alias("note"))), lambda x: (x["i"] > 0) & (x["status"] == "found"))
    best = F.get(later, F.lit(0))
    notes = F.filter(F.concat(F.array(best["note"]), F.transform(F.slice(given, 1, F.greatest(F.coalesce(best["i"], F.lit(0)), F.lit(1))), lambda x: x["note"])), lambda n: F.coalesce(n, F.lit("")) != "")
    merged = F.struct(best["status"].alias("status"), best["title"].alias("title"), F.nullif(F.array_join(notes, ". "), F.lit("")).alias("note"))
    none = F.struct(F.lit("unreadable").alias("status"), F.lit(None).cast("string").alias("title"), F.lit(NOT_SET_UP).alias("note"))
    return F.when(first.isNull(), none).when(first["status"].isin("found", "not_found") | best.isNull(), first).otherwise(merged)


def first_of(parts: list[DataFrame], most: int, by: str = "site", key: str = "key", pos: str = "pos") -> DataFrame:
    """The first ``most`` different keys of each group over several lists, one list after the other, with their ``place``.

    parts: by, key, pos and other columns, alike in all. A key that stands in several lists counts where it comes first. No
    list is sorted as a whole: a key's first place comes from a grouping, and tasks keep ``most`` rows of a group.
    """
    rest = [c for c in parts[0].columns if c not in (by, key, pos)]
    every = reduce(DataFrame.unionByName, [p.select(by, key, F.struct(F.lit(i).alias("source"), F.col(pos).cast("long").alias("pos"), *rest).alias("at")) for i, p in enumerate(parts)])
    first = every.groupBy(by, key).agg(F.min("at").alias("at"))
    return first_rows(first, [by], ["at", key], most).select(by, key, *[F.col("at")[c].alias(c) for c in rest], F.col("n").cast("long").alias("place"))


# Error codes of the business reader by what they mean, and a valid account name.
EXPIRED, BUSY, PRIVATE, PRIVATE_SUB = (190,), (4, 17, 32, 613), (110, 24), (2207013, 2207001)
HANDLE = r"^[A-Za-z0-9._]{1,30}\z"
MOST_POSTS = 5


def business_profiles(replies: DataFrame, key: str) -> DataFrame:
    """key, status, title, description, note, newest (timestamp) of a business reader's replies.

    replies: key, handle, granted (whether the budget allowed the call), http (null if it could not be reached), reply. The
    reply is a variant: a refused token, a full budget and a private account are told apart by their codes; numbers and
    texts of the wrong kind count as absent.
    """
    v = F.try_parse_json("reply")
    p = lambda path, kind: number(F.col("v"), path) if kind == "n" else string(F.col("v"), path)
    line = lambda c, most: F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]+", " "), r"\s+", " ")), 1, most)
    d = "$.business_discovery."
    code, sub = p("$.error.code", "n"), p("$.error.error_subcode", "n")
    followers, posts = p(d + "followers_count", "n").cast("long"), p(d + "media_count", "n").cast("long")
    stamps = F.transform(F.coalesce(F.try_variant_get("v", d + "media.data", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.try_to_timestamp(string(m, "$.timestamp")))
    read = replies.select(key, "handle", "granted", "http", F.inline(F.array(F.struct(v.alias("v")))))
    read = read.select(
        key, "handle", "granted", "http", code.alias("code"), sub.alias("sub"), F.schema_of_variant(F.try_variant_get("v", "$.business_discovery", "variant")).startswith("OBJECT").alias("has"), followers.alias("followers"), posts.alias("posts"),
        line(F.coalesce(p(d + "name", "s"), F.lit("")), 120).alias("name"), line(F.coalesce(p(d + "username", "s"), F.col("handle")), 40).alias("user"), line(F.coalesce(p(d + "biography", "s"), F.lit("")), 300).alias("about"), F.array_max(F.slice(stamps, 1, MOST_POSTS)).alias("newest"),
    )
    why = (
        F.when(~F.coalesce(F.col("handle"), F.lit("")).rlike(HANDLE), "the link names no valid account").when(~F.col("granted"), "the daily budget is used up").when(F.col("http").isNull(), "could not be reached").when(F.col("code").isin(*EXPIRED), "the access token has to be renewed")
        .when(F.col("code").isin(*BUSY), "the rate limit was met").when(F.col("code").isin(*PRIVATE) | F.col("sub").isin(*PRIVATE_SUB), "not a business account, private or not there").when(F.col("http") >= 400, F.format_string("no usable answer (HTTP %d)", F.col("http")))
        .when(~F.coalesce("has", F.lit(False)), "no business details")
    )
    stats = F.array_join(F.array_compact(F.array(F.concat(T.compact_number(F.col("followers")), F.lit(" followers")), F.concat(F.col("posts").cast("string"), F.lit(" posts")))), ", ")
    found = why.isNull()
    return read.select(
        key, F.when(found, "found").otherwise("unreadable").alias("status"), F.when(found, F.when(F.col("name") != "", F.col("name")).otherwise(F.col("user"))).alias("title"), F.when(found, F.nullif(F.col("about"), F.lit(""))).alias("description"),
        F.when(found, F.nullif(stats, F.lit(""))).otherwise(why).alias("note"), F.when(found, F.col("newest")).alias("newest"),
    )
