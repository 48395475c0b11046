"""Rate limits of audits and daily budgets of providers, over tables of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import DAY, HOUR, consume, micros

# Rules in the order they are looked at (reason, kind of bucket, window, limit), and units a day by provider.
RULES = [("global", "global", DAY, 50), ("per-ip", "ip", HOUR, 5), ("per-ip-daily", "ip", DAY, 10), ("per-target", "target", HOUR, 3), ("per-ip", "refund", HOUR, 20)]
QUOTAS = {"llm": 400, "pagespeed": 200, "search": 30, "authority": 300, "instagram": 150}


def bucket_of(kind: str) -> Column:
    """Name of the bucket of a scan (ip, domain)."""
    return F.lit("global") if kind == "global" else F.concat(F.lit(f"{kind}:"), F.col("domain" if kind == "target" else "ip"))


def committed(scans: DataFrame, ts: str = "ts") -> DataFrame:
    """bucket, us: the three hits that each scan (ip, domain, ts) leaves; null parts count as empty."""
    s = scans.select(micros(ts).alias("us"), F.coalesce("ip", F.lit("")).alias("ip"), F.coalesce("domain", F.lit("")).alias("domain"))
    return s.select(F.explode(F.array(*[bucket_of(k) for k in ("global", "ip", "target")])).alias("bucket"), "us")


def refunded(hits: DataFrame, refunds: DataFrame, ts: str = "ts") -> DataFrame:
    """hits (bucket, us) after refunds (ip, ts): one hit of the visitor's own bucket goes for each, and the refund is a hit itself."""
    r = refunds.select(F.coalesce("ip", F.lit("")).alias("ip"), micros(ts).alias("us"))
    n = F.row_number().over(Window.partitionBy("bucket", "us").orderBy("bucket"))
    gone = r.select(bucket_of("ip").alias("bucket"), "us").withColumn("n", n)
    left = hits.withColumn("n", n).join(gone, ["bucket", "us", "n"], "left_anti").select("bucket", "us")
    return left.unionByName(r.select(bucket_of("refund").alias("bucket"), "us"))


#: Into how many cells a window's length is cut.
CELLS = 64


def peek_all(asks: DataFrame, hits: DataFrame, key: str, ts: str = "ts", rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """key, reason, retry_after_us for each ask (ip, domain, ts): the first rule that its moment breaks, null if it may go.

    A window is open at its start and ends with the ask, so its count is what came up to the ask less what came up to its
    start. Time is cut into cells of a 64th of the window: hits are counted by cell, the counts of a bucket's cells are
    carried forward, and only within its own cell is a moment put among single hits. So the bucket that all traffic shares
    is as many groups as there are cells, and what is walked in order is one row a cell.
    """
    asked = asks.select(F.col(key).alias("key"), micros(ts).alias("us"), F.coalesce("ip", F.lit("")).alias("ip"), F.coalesce("domain", F.lit("")).alias("domain"))
    found = None
    for place, (reason, kind, window, limit) in enumerate(rules):
        cell = F.floor(F.col("us") / (window // CELLS))
        own = hits.where(F.col("bucket").startswith("global" if kind == "global" else f"{kind}:")).select("bucket", "us")
        marks = F.explode(F.array(F.struct(F.col("us").alias("us"), F.lit(1).alias("mark")), F.struct((F.col("us") - window).alias("us"), F.lit(2).alias("mark")))).alias("m")
        marked = asked.select(bucket_of(kind).alias("bucket"), "key", marks).select("bucket", "m.us", "key", "m.mark")
        rows = own.select("bucket", "us", F.lit(None).cast(asked.schema["key"].dataType).alias("key"), F.lit(0).alias("mark")).unionByName(marked).withColumn("cell", cell)
        hit = F.col("mark") == 0
        cells = rows.groupBy("bucket", "cell").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("us"))).alias("first"))
        along = Window.partitionBy("bucket").orderBy("cell")
        before = F.coalesce(F.sum("hits").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        back = Window.partitionBy("bucket").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that ends at the last row would be read again for each row
        after = F.last("first", ignorenulls=True).over(back)
        part = Window.partitionBy("bucket", "cell")
        up, down = part.orderBy("us", ~hit).rowsBetween(Window.unboundedPreceding, 0), part.orderBy(F.desc("us"), hit).rowsBetween(Window.unboundedPreceding, 0)
        seen = rows.withColumn("n", F.count_if(hit).over(up)).withColumn("next", F.last(F.when(hit, F.col("us")), ignorenulls=True).over(down)).where("mark > 0")
        seen = seen.join(cells.select("bucket", "cell", before.alias("before"), after.alias("after")), ["bucket", "cell"]).select("key", "mark", "us", (F.col("before") + F.col("n")).alias("n"), F.coalesce("next", "after").alias("next"))
        now, start = F.col("mark") == 1, F.col("mark") == 2
        counted = seen.groupBy("key").agg((F.max(F.when(now, F.col("n"))) - F.max(F.when(start, F.col("n")))).alias("n"), F.max(F.when(now, F.col("us"))).alias("us"), F.max(F.when(start, F.col("next"))).alias("oldest"))
        full = counted.where(F.col("n") >= limit).select("key", F.lit(place).alias("place"), F.lit(reason).alias("reason"), (window - (F.col("us") - F.coalesce("oldest", "us"))).alias("retry_after_us"))
        found = full if found is None else found.unionByName(full)
    first = found.groupBy("key").agg(F.min_by(F.struct("reason", "retry_after_us"), "place").alias("f"))
    return asked.select("key").join(first, "key", "left").select(F.col("key").alias(key), "f.reason", "f.retry_after_us")


def spend(calls: DataFrame, provider: str, ts: str, tie: str, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """calls with ``granted``: within the provider's daily budget; a refused call uses nothing, unknown providers have none."""
    known = F.create_map(*[x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))])
    return consume(calls.withColumn("_limit", F.coalesce(F.try_element_at(known, F.col(provider)), F.lit(0))), provider, ts, tie, DAY, "_limit").drop("_limit")


def client_ip(trusted: Column, forwarded: Column, real: Column) -> Column:
    """The address limits go by: proxies' headers only where the proxy is trusted."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(~F.coalesce(trusted, F.lit(False)), "untrusted-client").when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(F.coalesce(real, F.lit("unknown")))
