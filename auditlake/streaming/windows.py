"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Into how many buckets the keys of a running limit are spread.
BUCKETS = 512


def event_stream(spark, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many a batch in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hits_per_window(events: DataFrame, key: str, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits by key in tumbling windows; a watermark bounds the state."""
    return events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a longer pause."""
    s = F.session_window("ts", gap)
    return events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late).groupBy(s, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def running_limit(events: DataFrame, key: str, ts: str, window_us: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """Consume-if-below over a stream: the granted times of a key are its state, dropped once the window has passed.

    Hits count in the order in which they arrive, those of one micro-batch by time: as a server sees them. A key
    whose window has passed is forgotten. Keys share a number of buckets by hash, each with one state: the granted
    times of its keys, so that state is read and written by buckets, not by keys.
    """
    import bisect

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = {}
        for k, us in zip(*state.get, strict=True) if state.exists else ():
            held.setdefault(k, []).append(us)
        hits = pd.concat(list(batches), ignore_index=True)
        out = []
        for k, own in hits.sort_values("us").groupby("key", sort=False, dropna=False)["us"]:
            k = None if pd.isna(k) else k
            granted = held.setdefault(k, [])  # in order of time
            n_ok = 0
            for us in own.tolist():
                del granted[: bisect.bisect_right(granted, us - window_us)]
                if len(granted) < limit:
                    bisect.insort(granted, us)
                    n_ok += 1
            out.append((k, n_ok, len(own) - n_ok))
        now = state.getCurrentWatermarkMs() * 1000
        kept = [(k, us) for k, granted in held.items() if granted and granted[-1] + window_us > now for us in granted]
        state.update(([k for k, _ in kept], [us for _, us in kept]))
        state.setTimeoutTimestamp(max(max((us for _, us in kept), default=0) + window_us, now) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "granted", "refused"])

    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    # As text, a key is itself in pandas whatever others there are.
    keyed = rows.select(F.pmod(F.hash(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).cast("string").alias("key"), "_at", F.unix_micros("_at").alias("us")).groupBy("bucket")
    counts = keyed.applyInPandasWithState(step, "key string, granted long, refused long", "keys array<string>, granted array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return counts.select(F.col("key").cast(dict(events.dtypes)[key]).alias(key), "granted", "refused")


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream gives for the files present, as a table of files in the shared folder.

    A batch writes a folder of its own, so that one that is tried again replaces itself. In append mode a window comes out
    once, when the watermark has passed it, and its state goes; those it has not passed yet stay out.
    """
    from ..sources.tables import shared_path

    spark, root = stream.sparkSession, shared_path(stream.sparkSession, name)
    wrote = []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={k}")
        wrote.append(k)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out/*") if wrote else spark.createDataFrame([], stream.schema)
