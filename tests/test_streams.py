"""Streams with state, the event sink, readers and measurements on small rows made for the purpose."""

from __future__ import annotations

import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from auditlake.operators import readers, vitals
from auditlake.sources.tables import read_events, shared_path
from auditlake.streaming import sink, steps, windows

EVENTS = "scan_id long, step string, ts timestamp, kind string"


def at(minute: float) -> str:
    return f"2024-01-01 {int(minute) // 60:02}:{int(minute) % 60:02}:{int(minute * 60) % 60:02}"


def streamed(spark, batches, **options):
    path = shared_path(spark, "given")
    for b in [*batches, [(-1, "end", 60 * 23, "done")]]:
        spark.createDataFrame([(s, p, at(m), k) for s, p, m, k in b], "scan_id long, step string, t string, kind string").select("scan_id", "step", F.col("t").cast("timestamp").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(path)
    out = windows.drained(steps.step_times(windows.event_stream(spark, path, EVENTS), **options), "steps", mode="append")
    return sorted((r["scan_id"], r["step"], r["took_us"] and r["took_us"] // 60_000_000, r["outcome"]) for r in out.collect())


def test_steps_pair_across_batches_out_of_order_and_lost(spark):
    first = [(1, "a", 1, "start"), (1, "b", 5, "done"), (2, "a", 8, "start"), (3, "a", 2, "start"), (4, "a", 3, "done"), (5, "a", 1, "start")]
    second = [(1, "a", 4, "done"), (2, "a", 12, "warn"), (2, "a", 10, "start"), (4, "a", 2, "start"), (5, "a", 30, "start")]
    third = [(3, "a", 200, "done"), (5, "a", 31, "done")]
    got = streamed(spark, [first, second, third], late="10 minutes", patience_us=60 * 60_000_000)
    assert got == [(1, "a", 3, "done"), (2, "a", 2, "warn"), (3, "a", None, "lost"), (4, "a", 1, "done"), (5, "a", 1, "done")]


def test_sink_counts_a_batch_once_and_takes_failed_files_away(spark, tmp_path):
    w = sink.EventWriter(f"file://{tmp_path}/s", 0)
    rows = [Row(event="step\nstart", n=1, text='line\n"two"'), Row(event=None, n=None, text="é")]
    a, b, none = w.write(iter(rows)), w.write(iter(rows[:1])), w.write(iter(()))
    w.commit([a, none], 0)
    w.commit([b], 0)  # the same batch again, after its commit was lost from sight
    w.commit([None], 1)
    c = w.write(iter(rows))
    w.abort([c, None], 2)
    assert none.file is None and sorted(os.listdir(tmp_path / "s/files")) == [a.file] and len(os.listdir(tmp_path / "s/batches")) == 2
    (tmp_path / "s/files/events-left-behind.sse").write_text("event: x\ndata: {}\n\n")
    back = read_events(sink.committed(spark, f"file://{tmp_path}/s")).collect()
    assert [(r["event"], json.loads(r["data"])) for r in back] == [("step start", {"n": 1, "text": 'line\n"two"'}), ("message", {"text": "é"})]
    os.makedirs(tmp_path / "e/batches")
    (tmp_path / "e/batches/0.json").write_text("[]")
    assert sink.committed(spark, f"file://{tmp_path}/e").count() == 0


def test_readers_in_order(spark):
    reads = lambda rows: spark.createDataFrame(rows, "k long, status string, title string, note string")
    first = reads([(1, "found", "a", None), (2, "unreadable", None, "expired"), (3, "unreadable", None, "expired"), (4, "not_found", None, "gone"), (2, "unreadable", None, "expired"), (9, "found", "x", None)])
    second = reads([(2, "found", "b", "seen"), (3, "unreadable", None, "wall"), (4, "found", "b", None), (5, "found", "b", None)])
    got = {r["k"]: (r["status"], r["title"], r["note"]) for r in readers.composed(spark.createDataFrame([(i,) for i in range(1, 7)], "k long"), [first, second], ["k"]).collect()}
    assert got == {1: ("found", "a", None), 2: ("found", "b", "seen. expired"), 3: ("unreadable", None, "expired"), 4: ("not_found", None, "gone"), 5: ("found", "b", None), 6: ("unreadable", None, readers.NOT_SET_UP)}


def test_first_of_lists_with_repeats_and_ties(spark):
    part = lambda rows: spark.createDataFrame(rows, "site string, key string, pos long, x int")
    a, b = part([("s", "k1", 5, 1), ("s", "k2", 3, 2), ("s", "k1", 1, 3)]), part([("s", "k3", 0, 4), ("s", "k2", 0, 5), ("t", "k9", 0, 6), ("s", "k4", 0, 7)])
    got = [(r["site"], r["key"], r["x"], r["place"]) for r in readers.first_of([a, b], 3).orderBy("site", "place").collect()]
    assert got == [("s", "k1", 3, 1), ("s", "k2", 2, 2), ("s", "k3", 4, 3), ("t", "k9", 6, 1)]


def test_replies_of_any_shape(spark):
    audits = lambda **k: json.dumps({"lighthouseResult": {"audits": {n.replace("_", "-"): {"details": {"items": v}} for n, v in k.items()}}})
    shift = [{"node": {"selector": f"s{i}"}, "score": s} for i, s in enumerate([0.1, 0.5, 0.5, "0.9", 0.3, 0.2])] + [{"score": 0.9}, "text", None, {"node": {"snippet": "<b>"}, "score": 1}]
    scripts = [{"url": u, "total": t} for u, t in (("https://a.test/p/", 900), ("Unattributable", 800), ("https://j.test/1.js", 3.5), ("https://j.test/2.js", 7), ("https://j.test/3.js", 7), ("https://j.test/4.js", 1), (5, 9))]
    rows = [(1, audits(layout_shifts=shift, bootup_time=scripts, render_blocking_resources=[{"url": "c", "wastedMs": 2.5}, {"url": "d"}] + [{"url": f"e{i}", "wastedMs": i} for i in range(9)], largest_contentful_paint_element=[{"items": [{"node": {"snippet": "<img src='x.png'>"}}]}]))]
    rows += [(2, "{broken"), (3, "[]"), (4, None), (5, '{"lighthouseResult":{"audits":{"layout-shifts":{"details":{"items":{"a":1}}}}},"loadingExperience":{"metrics":{"INTERACTION_TO_NEXT_PAINT":{"percentile":500.4}}}}')]
    got = {r["k"]: r for r in vitals.read_vitals(spark.createDataFrame([(k, "https://a.test/p", r) for k, r in rows], "k long, url string, reply string"), "k").collect()}
    assert [(s["selector"], s["score"]) for s in got[1]["shifts"]] == [("<b>", 1.0), ("s1", 0.5), ("s2", 0.5), ("s4", 0.3)]
    assert [(s["url"][-4:], s["ms"]) for s in got[1]["scripts"]] == [("2.js", 7), ("3.js", 7), ("1.js", 4)] and got[1]["lcp_resource"] == "https://a.test/x.png" and got[1]["lcp_element"] is None
    assert [(b["url"], b["ms"]) for b in got[1]["blockers"]] == [("c", 3), ("e0", 0), ("e1", 1), ("e2", 2), ("e3", 3)]
    assert [got[k]["parsed"] for k in (2, 3, 4, 5)] == [False, True, False, True] and (got[5]["inp_ms"], got[5]["inp_rating"], got[5]["shifts"]) == (500, "needs improvement", [])
