"""Rolling windows, quotas, caches and telemetry in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ship import ship

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_window(hits: DataFrame, bucket: str, ts: str, window: int) -> DataFrame:
    """hits with count and oldest of the bucket's earlier hits in the window, open at its start, at each hit's time.

    A hit does not count itself or others of the same instant.
    """
    w = Window.partitionBy(bucket).orderBy("us").rangeBetween(-(window - 1), -1)
    return hits.withColumn("us", micros(ts)).withColumn("n", F.count("*").over(w)).withColumn("oldest", F.min("us").over(w))


def peek(hits: DataFrame, bucket: str, ts: str, rules: list[tuple[str, int, int]]) -> DataFrame:
    """The first rule (reason, window, limit) in order that each hit would break, and how long to wait."""
    out = hits.withColumn("us", micros(ts))
    reason, wait = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, window, limit in reversed(rules):
        w = Window.partitionBy(bucket).orderBy("us").rangeBetween(-(window - 1), -1)
        full = F.count("*").over(w) >= limit
        reason = F.when(full, name).otherwise(reason)
        wait = F.when(full, window - (F.col("us") - F.min("us").over(w))).otherwise(wait)
    return out.select("*", reason.alias("reason"), wait.alias("retry_after_us"))


def consume(requests: DataFrame, bucket: str, ts: str, tie: str, window: int, limit: int | str) -> DataFrame:
    """requests with ``granted``: allowed while fewer than ``limit`` were granted in the window; a refusal uses nothing.

    limit: a number, or the column that holds each bucket's.

    Grants depend on earlier grants, so each bucket is walked in order, as one sorted stream in one task that keeps
    ``limit`` times only. The walk goes from grant to grant: once a window is full, all requests up to the moment at which
    its oldest grant leaves it are refused at once, found by bisection. Rows are never gathered.
    """
    ship(requests.sparkSession)
    rows = requests.withColumn("us", micros(ts)).repartition(bucket).sortWithinPartitions(bucket, "us", tie)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        import numpy as np

        at, granted = object(), deque()
        for b in batches:
            us, said = b["us"].to_numpy(), np.zeros(len(b), bool)
            most = np.full(len(b), limit) if isinstance(limit, int) else b[limit].to_numpy()
            name = b[bucket].to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if name[lo] != at:
                    at, granted = name[lo], deque()
                i = lo
                while i < hi:
                    while granted and granted[0] <= us[i] - window:
                        granted.popleft()
                    if len(granted) < most[i]:
                        said[i] = True
                        granted.append(int(us[i]))
                        i += 1
                    elif not granted:
                        i = hi  # nothing is ever granted here
                    else:
                        i += int(np.searchsorted(us[i:hi], granted[0] + window))
            yield b.assign(granted=said)

    from pyspark.sql.types import BooleanType, StructField, StructType

    return rows.mapInPandas(walk, StructType([*rows.schema.fields, StructField("granted", BooleanType())]))


def latest(reports: DataFrame, key: str, ts: str, now: Column, most_age: int) -> DataFrame:
    """The newest report of each key that is younger than most_age."""
    fresh = reports.withColumn("us", micros(ts)).where(F.col("us") > now - most_age)
    return fresh.groupBy(key).agg(F.max_by(F.struct(*reports.columns), F.struct("us", *[c for c in reports.columns if c != key])).alias("r")).select("r.*")


def telemetry(steps: DataFrame) -> DataFrame:
    """steps: step, ms, warned. Runs, median, maximum and share of warnings by step."""
    return steps.groupBy("step").agg(
        F.count("*").alias("runs"), T.js_round(F.median("ms")).alias("median_ms"), T.js_round(F.max("ms")).alias("max_ms"), T.js_round(F.count_if("warned") * 100.0 / F.count("*")).alias("warned_percent")
    )


# The steps of an audit in order, and which of them call each provider, the main one first.
STEPS = "fetch render technical geo crawl citation content marketing performance social competitors synthesis".split()
PROVIDERS = {"llm": ("citation", "content", "marketing", "competitors", "synthesis"), "pagespeed": ("performance",), "fetch-service": ("render", "social")}


def recent_telemetry(steps: DataFrame, now_us: Column, most_age_us: int, order: list[str] = STEPS) -> DataFrame:
    """telemetry of steps (step, ms, warned, us) younger than most_age_us, with ``place``: the listed steps in their order, others after them by name."""
    known = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    t = telemetry(steps.where(F.col("us") > now_us - most_age_us)).withColumn("ord", F.coalesce(F.try_element_at(known, F.col("step")), F.lit(len(order))))
    return t.withColumn("place", F.row_number().over(Window.orderBy("ord", "step")).cast("long")).drop("ord")  # a row a step


def provider_use(steps: DataFrame, calls: DataFrame, providers: dict[str, tuple[str, ...]] = PROVIDERS) -> DataFrame:
    """run, provider, ord, n_steps, n_calls: the done steps of a run (run, step, warned) that a provider serves, and its calls (run, provider)."""
    serves = F.broadcast(steps.sparkSession.createDataFrame([(p, i, s) for i, (p, own) in enumerate(providers.items()) for s in own], "provider string, ord int, step string"))
    done = steps.where(~F.col("warned")).select("run", "step").distinct().join(serves, "step").groupBy("run", "provider").agg(F.count("*").alias("n_steps"))
    made = calls.groupBy("run", "provider").agg(F.count("*").alias("n_calls"))
    order = F.create_map(*[x for i, p in enumerate(providers) for x in (F.lit(p), F.lit(i))])
    j = done.join(made, ["run", "provider"], "full")
    return j.select("run", "provider", F.coalesce(F.try_element_at(order, F.col("provider")), F.lit(len(providers))).alias("ord"), F.coalesce("n_steps", F.lit(0)).cast("long").alias("n_steps"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"))


def step_times(events: DataFrame) -> DataFrame:
    """events: scan_id, step, us, kind (start, done or warn). Each end with the start before it in the same scan and step."""
    w = Window.partitionBy("scan_id", "step").orderBy("us", "kind")
    e = events.withColumn("before", F.lag("kind").over(w)).withColumn("began", F.lag("us").over(w))
    return e.where("kind <> 'start' and before = 'start'").select("scan_id", "step", (F.col("us") - F.col("began")).alias("took_us"), (F.col("kind") == "warn").alias("warned"))


def refund(hits: DataFrame, refunds: DataFrame, bucket: str, ts: str) -> DataFrame:
    """hits less one for each refund of the same bucket and time: duplicates go one by one, by their other columns in order."""
    n = lambda df: F.row_number().over(Window.partitionBy(bucket, ts).orderBy(*[c for c in df.columns if c not in (bucket, ts)] or [bucket]))
    gone = refunds.select(bucket, ts)
    return hits.withColumn("_n", n(hits)).join(gone.withColumn("_n", n(gone)), [bucket, ts, "_n"], "left_anti").drop("_n")
