"""Limits and quotas on hot buckets against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import limits, state


def at(us: str):
    return F.timestamp_micros(F.col(us))


def plain_grants(rows, window, limit):
    granted, out = {}, {}
    for bucket, us, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        own = granted.setdefault(bucket, [])
        own[:] = [t for t in own if t > us - window]
        most = limit if isinstance(limit, int) else limit[bucket]
        out[i] = len(own) < most
        if out[i]:
            own.append(us)
    return out


@pytest.mark.parametrize("limit", [0, 1, 3, {"hot": 5, "a": 0, "b": 2}])
def test_grants_of_a_hot_bucket_equal_a_walk(spark, limit):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(5_000), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "bucket string, us0 long, i long").withColumn("ts", at("us0")).withColumn("granted", F.lit("mine")).drop("granted")
    df = df if isinstance(limit, int) else df.withColumn("most", F.element_at(F.create_map(*[x for k, n in limit.items() for x in (F.lit(k), F.lit(n))]), F.col("bucket")))
    got = {r["i"]: r["granted"] for r in state.consume(df, "bucket", "ts", "i", 200, limit if isinstance(limit, int) else "most").collect()}
    assert got == plain_grants(rows, 200, limit)


def test_windows_of_a_hot_bucket_equal_counting_every_pair(spark):
    rng = random.Random(9)
    window = 64_000
    rules = [("all", "global", window, 40), ("own", "ip", window // 2, 4), ("site", "target", window * 2, 9)]
    asks = [(i, rng.randrange(900_000), f"ip{rng.randrange(9)}", "hot" if rng.random() < 0.7 else f"d{rng.randrange(5)}") for i in range(400)]
    hits = [("global", us) for _, us, _, _ in asks] + [(f"ip:{ip}", us) for _, us, ip, _ in asks] + [(f"target:{d}", us) for _, us, _, d in asks]
    df = spark.createDataFrame(asks, "i long, us0 long, ip string, domain string").withColumn("ts", at("us0"))
    got = {r["i"]: (r["reason"], r["retry_after_us"]) for r in limits.peek_all(df, spark.createDataFrame(hits, "bucket string, us long"), "i", rules=rules).collect()}
    for i, us, ip, domain in asks:
        want = (None, None)
        for reason, kind, w, most in rules:
            own = [t for b, t in hits if b == {"global": "global", "ip": f"ip:{ip}", "target": f"target:{domain}"}[kind] and us - w < t <= us]
            if len(own) >= most:
                want = (reason, w - (us - min(own)))
                break
        assert got[i] == want
    assert limits.peek_all(df, spark.createDataFrame([], "bucket string, us long"), "i", rules=rules).where("reason is not null").count() == 0
