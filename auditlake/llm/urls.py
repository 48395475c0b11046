"""URL filter rules by a sort-merge range join.

A host is written backwards, label by label (``a.example.com`` is ``com.example.a.``), so a rule's host and
all its subdomains are one interval of keys. Pages and rules are dealt to ranges of keys, sorted, and swept
once: a stack holds the rules whose intervals are open, each nested in the one below, and a page looks only at
these for the rule whose path fits; the longest rule wins.

Range bounds come from a bounded sample of the pages' keys. A rule goes to every range that its interval
meets. A range that the sample shows to hold many pages (a host with a third of all, say) is dealt over as many
parts by page; each part sees the rules of its range, and rules of other ranges are not copied. Nothing is
collected but the bounds.

Defined results: a null url, or one without ``://``, has empty host and path, which no rule fits; other
columns are kept and new names made unique; of rules that repeat with other verdicts, block wins, as it does
for equally long rules of equal hosts; rules without a host are ignored; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import free_name, in_arrow

#: The rules of the query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """The canonical key: labels from the last to the first, each with a dot after it."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int = 64, rows_per_part: int = 250_000, sample: int = 4_096) -> DataFrame:
    """pages with host, path, rule (host and path of the winning rule, else null) and verdict.

    rules: host, path, verdict ('allow' or 'block'); any number of them.
    """
    names = {}
    for c in ("host", "path", "rule", "verdict"):
        names[c] = free_name(pages, c)
    kept = [f"_c{i}" for i in range(len(pages.columns))]
    rows = pages.toDF(*kept)
    u = F.col(kept[pages.columns.index(url)])
    rows = rows.select(*kept, host_of(u).alias("_host"), path_of(u).alias("_path")).withColumn("_key", key_of(F.col("_host")))
    order = F.xxhash64(*[c for c, (_, t) in zip(kept, pages.dtypes, strict=True) if not t.startswith("map")])

    # A share of the rows by hash, about twice ``sample`` in all and four times at most, whatever the number of tasks.
    total = pages.count()
    share = min(1.0, 2.0 * sample / max(1, total))
    drawn = sorted(r["_key"] for r in rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select("_key").limit(4 * sample).collect())
    step = max(1, len(drawn) // ranges)
    bounds = sorted(set(drawn[step::step]))
    # Parts of each range: in proportion to its share, at least so many that a part is about ``rows_per_part`` rows.
    held = Counter(bisect_right(bounds, k) for k in drawn)
    parts = [max(1, -(-held[b] * max(ranges, total // rows_per_part) // max(1, len(drawn)))) for b in range(len(bounds) + 1)]
    parts_of = F.array(*map(F.lit, parts))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to each rule the ranges that its interval meets."""
        for b in batches:
            first, last = [], []
            for k in b.column("_key").to_pylist():
                first.append(bisect_right(bounds, k))
                last.append(bisect_right(bounds, k + "\U0010ffff"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*b.schema.names, "_first", "_last"])

    bucket = F.lit(0)
    if bounds:  # at most ``ranges`` bounds: the number of bounds not above the key
        bucket = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("_key")))
    events = rows.select(bucket.alias("_bucket"), F.pmod(order, F.get(parts_of, bucket)).cast("int").alias("_salt"), "_key", F.lit(1).alias("_kind"), F.col("_host"), F.col("_path"), F.lit(None).cast("string").alias("_verdict"), *kept)

    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"), F.col("verdict").alias("_verdict")).where("_host <> ''").withColumn("_key", key_of(F.col("_host")))
    placed = in_arrow(rules, ranged, StructType([*rules.schema.fields, StructField("_first", IntegerType()), StructField("_last", IntegerType())]))
    placed = placed.select("*", F.explode(F.sequence("_first", "_last")).alias("_bucket")).select("*", F.explode(F.sequence(F.lit(0), F.get(parts_of, F.col("_bucket")) - 1)).alias("_salt"))
    blank = [F.lit(None).cast(t).alias(c) for c, (_, t) in zip(kept, pages.dtypes, strict=True)]
    placed = placed.select("_bucket", "_salt", "_key", F.lit(0).alias("_kind"), "_host", "_path", "_verdict", *blank)

    swept = events.unionByName(placed).repartition("_bucket", "_salt").sortWithinPartitions("_bucket", "_salt", "_key", "_kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str]]] = []  # key, host, verdict by path
        part = None
        for b in batches:
            rule, verdict, take = [], [], []
            cols = [b.column(c).to_pylist() for c in ("_bucket", "_salt", "_key", "_kind", "_host", "_path", "_verdict")]
            for i, (bucket, salt, key, kind, host, path, said) in enumerate(zip(*cols, strict=True)):
                if part != (bucket, salt):
                    stack, part = [], (bucket, salt)
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}))
                    if stack[-1][2].get(path) != "block":
                        stack[-1][2][path] = said
                    continue
                best = (-1, -1, None, default)
                for _, h, paths in stack:
                    for n in sorted({len(p) for p in paths}, reverse=True):
                        if n <= len(path) and (p := path[:n]) in paths:
                            best = max(best, (len(h) + n, len(h), h + p, paths[p]), key=lambda x: x[:2])
                            break
                take.append(i), rule.append(best[2]), verdict.append(best[3])
            out = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in kept], out.column("_host"), out.column("_path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*kept, *names.values()])

    schema = StructType([*[StructField(c, f.dataType) for c, f in zip(kept, pages.schema.fields, strict=True)], *[StructField(n, StringType()) for n in names.values()]])
    return in_arrow(swept, sweep, schema).toDF(*pages.columns, *names.values())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(rule_host, rule_path, said) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT p.*, rule_host || rule_path AS rule, said,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS best
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM m WHERE best = 1
"""
