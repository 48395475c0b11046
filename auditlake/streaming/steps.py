"""Step times over a stream of events: starts paired with their ends, late and lost ends included.

Events of one scan and step may come in any order within the lateness that the watermark grants. So they are held and
worked off in order of time once the watermark has passed them, by an event-time timer: the result is that of a batch,
whatever the batches were. A start is held until its end comes; one that waits longer than ``patience`` is given out as
lost, and a later start takes the place of an earlier one.

Scans and steps share a number of buckets by hash. A bucket's events lie in list state as Arrow tables, one for each that
came in, and have one timer, for the first moment at which something can be worked off; so calls into Python and to the
state store go by buckets, not by events or keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..ship import ship

#: The state store that list state and timers need.
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is held of an event. A missing scan is marked beside its number, which pandas would else make a float.
_HELD = pa.schema([("scan_id", pa.int64()), ("no_scan", pa.bool_()), ("step", pa.string()), ("us", pa.int64()), ("kind", pa.string())])
#: Into how many buckets scans and steps are spread. A bucket's held events are read at once.
BUCKETS = 512
_OUT = StructType([StructField("scan_id", LongType()), StructField("step", StringType()), StructField("began_us", LongType()), StructField("took_us", LongType()), StructField("outcome", StringType())])


def _packed(rows: pd.DataFrame) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(rows, schema=_HELD, preserve_index=False)
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class StepTimer(StatefulProcessor):
    """outcome is done, warn or lost; a lost step has no took_us."""

    def __init__(self, patience_us: int):
        self.patience_us = patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """The bucket's timer goes off at ms, or before if it was to."""
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if set_to is None or ms < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            self.held.appendValue((_packed(batch[_HELD.names]),))
            least = int(batch["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # All that lies before the watermark is at hand, so it is worked off at once.
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        self.timer.clear()
        held = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.held.get()]).to_pandas()
        due, later = held[held["us"] < until], held[held["us"] >= until]
        group = due.groupby(["scan_id", "no_scan", "step"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((pd.factorize(due["kind"], sort=True)[0], due["us"].to_numpy(), group))
        due, group = due.iloc[order], group[order]
        us, kind, n = due["us"].to_numpy(), due["kind"].to_numpy(dtype=object), len(due)
        followed = np.zeros(n, bool)
        followed[:-1] = group[1:] == group[:-1]
        gap = np.where(followed, np.append(us[1:], 0), until) - us
        starts, ends = kind == "start", np.append(kind[1:] != "start", False)
        lost = starts & (gap > self.patience_us)
        paired = starts & followed & ends & ~lost
        waits = starts & ~followed & ~lost  # their end may still come
        left = pd.concat([due[waits], later])
        if len(left):
            self.held.put([(_packed(left),)])
            wake = [*(later["us"] // 1000 + 1).nsmallest(1), *((due["us"][waits] + self.patience_us) // 1000 + 2).nsmallest(1)]
            self._wake(int(min(wake)))
        else:
            self.held.clear()
        said = lost | paired
        if said.any():
            out = due[said]
            yield pd.DataFrame({
                "scan_id": out["scan_id"].astype("Int64").mask(out["no_scan"]), "step": out["step"], "began_us": out["us"],
                "took_us": pd.Series(gap[said], out.index, "Int64").mask(lost[said]), "outcome": np.where(lost, "lost", np.append(kind[1:], None))[said],
            })

    def close(self) -> None:
        pass


def step_times(events: DataFrame, late: str = "10 minutes", patience_us: int = 3_600_000_000) -> DataFrame:
    """scan_id, step, began_us, took_us, outcome of a stream with scan_id, step, ts, kind (start, done or warn)."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set(STORE, PROVIDER)
    rows = events.select(F.col("scan_id").cast("long").alias("scan_id"), "step", F.col("ts").cast("timestamp").alias("ts"), "kind").where("ts is not null").withWatermark("ts", late)
    bucket = F.pmod(F.hash("scan_id", "step"), F.lit(BUCKETS)).alias("bucket")
    keyed = rows.select(bucket, F.coalesce("scan_id", F.lit(0)).alias("scan_id"), F.col("scan_id").isNull().alias("no_scan"), "step", "ts", F.unix_micros("ts").alias("us"), "kind").groupBy("bucket")
    return keyed.transformWithStateInPandas(StepTimer(patience_us), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
