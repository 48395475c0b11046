"""What the findings of round 3 named."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from auditlake.llm import lexical
from auditlake.sources.tables import shared_path


def test_index_row_groups_stay_small(spark):
    """Blocks of about a megabyte, all written by one task: no row group holds many of them."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8_000)), lambda i: F.md5(F.concat_ws(" ", i, "id"))), " ")
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = lexical.build_index(docs, block_bytes=600_000)
    files = [pq.ParquetFile(f).metadata for f in Path(urlsplit(index.blocks._stash_path).path).glob("*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 16 << 20 and max(sizes) <= 12 << 20
    items = spark.createDataFrame([(7, "c4ca4238a0b923820dcc509a6f75849b")], "item_id long, text string")
    assert lexical.search(index, items).count() == 0


def test_titles_keep_references_that_were_cut():
    """A title that ends within a reference reads as the SQL has it; whole references are read."""
    from auditlake.sources.dom import facts_of

    read = lambda t: facts_of("https://x.test/", f"<html><head><title>{t}</title></head><body><svg><title>y</title></svg></body></html>")["title_line"]
    assert read("bread&amp;&amp; salt&amp") == "bread&& salt&amp"
    assert read("&lt;b&gt; &#x27;x&#39; &eacute; a&b &lt") == "<b> 'x' é a&b &lt"
    assert facts_of("https://x.test/", "<title>never closed &amp")["title"] == "never closed &amp"


def test_score_queries_shuffle_only_the_lines(spark):
    """Groups, windows and joins of a site stay where its lines are; of rivals only packed rows move."""
    from auditlake.queries import score_queries as Q

    for query, most in ((Q.site_verdicts, {"l_orderkey"}), (Q.readiness_verdict, {"l_orderkey"}), (Q.competitor_gaps, {"l_orderkey", "site"}), (Q.competitor_checks, {"l_orderkey", "site"})):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        keys = set(re.findall(r"hashpartitioning\((.*?)#?\d*L?, \d+\)", plan))
        assert keys <= most, (query.__name__, keys)


def test_rule_queries_work_out_only_what_their_rules_read(spark, monkeypatch):
    from auditlake.queries import rule_fixtures as R
    from auditlake.queries.registry import QUERIES

    asked = []
    monkeypatch.setattr(R.engine, "sites", lambda pages, meta, broken, parts=R.engine.PARTS: asked.append(parts) or spark.createDataFrame([], "site string"))
    monkeypatch.setattr(R.engine, "evaluate", lambda rows, rules: spark.createDataFrame([], "site string, id string, passed boolean"))
    for name, parts in (("rules_performance", set()), ("rules_rendering", set()), ("rules_social", {"profiles"}), ("rules_geo", {"robots"}), ("rules_over_pages", {"articles", "orphans"})):
        asked.clear()
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert [set(p) for p in asked] == [parts], name


def test_slices_are_batches_by_time_that_all_tasks_write(spark):
    from auditlake.queries.source_queries import in_slices

    ts = F.when(F.col("id") != 5, F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 4000))
    seen = []
    look = lambda b, k: seen.append(b.agg(F.count_if(F.col("ts") < "2099-01-01"), F.min("ts"), F.max("ts"), F.count_if(F.col("ts").isNull()), F.countDistinct("file")).first())
    # A part without rows of a slice writes no file for it; the next slice's must not come with it.
    few = spark.range(400, numPartitions=3).select("id", ts.alias("ts")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("2023-11-14").cast("timestamp").alias("ts")))
    named = in_slices(few).select("*", F.input_file_name().alias("file"))
    named.writeStream.foreachBatch(look).option("checkpointLocation", shared_path(spark, "look")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 5 and sum(n for n, *_ in seen) == 400 and [x[3] for x in seen] == [1, 0, 0, 0, 0] and all(x[4] > 1 for x in seen[:4])
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False))


def test_step_times_hold_events_by_bucket(spark, monkeypatch):
    """Far fewer calls than keys; a scan without a number and one beyond what a float holds keep theirs."""
    from auditlake.streaming import steps, windows

    monkeypatch.setattr(steps, "BUCKETS", 1)
    path, big = shared_path(spark, "given"), 2**60 + 1
    rows = [[(big, "a", 1, "start"), (None, "a", 2, "start"), (7, None, 3, "start"), (8, "a", 4, "start")], [(big, "a", 61, "done"), (None, "a", 62, "warn"), (7, None, 63, "start")], [(-1, "end", 9_000_000, "done")]]
    for b in rows:
        spark.createDataFrame(b, "scan_id long, step string, s long, kind string").select("scan_id", "step", F.timestamp_seconds("s").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(path)
    timed = steps.step_times(windows.event_stream(spark, path, "scan_id long, step string, ts timestamp, kind string"))
    assert "bucket" in timed._jdf.queryExecution().analyzed().toString()
    got = windows.drained(timed, "steps").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(big, "a", 10**6, 60 * 10**6, "done"), (None, "a", 2 * 10**6, 60 * 10**6, "warn"), (7, None, 63 * 10**6, None, "lost"), (8, "a", 4 * 10**6, None, "lost")], key=repr)


def test_whole_reports_shuffle_and_gather_once(spark):
    from auditlake.queries.report_queries import whole_reports

    plan = whole_reports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")
    assert set(re.findall(r"hashpartitioning\((.*?)#?\d*L?, \d+\)", plan)) == {"l_orderkey"}


def test_running_limit_keeps_its_state_by_bucket(spark, monkeypatch):
    """Keys that share a state do not share grants; a grant of one batch counts in the next."""
    from auditlake.streaming import windows

    monkeypatch.setattr(windows, "BUCKETS", 1, raising=False)
    path, big = shared_path(spark, "given"), 2**60 + 1
    for b in ([(big, 1), (big, 2), (big, 3), (None, 1), (5, 2)], [(big, 8), (big, 12), (None, 9)]):
        spark.createDataFrame(b, "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    counts = windows.running_limit(windows.event_stream(spark, path, "k long, ts timestamp"), "k", "ts", 10_000_000, 2)
    assert "bucket" in counts._jdf.queryExecution().analyzed().toString()
    got = windows.drained(counts, "limit").groupBy("k").agg(F.sum("granted"), F.sum("refused")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(big, 3, 2), (None, 2, 0), (5, 1, 0)], key=repr)


def test_quotes_are_found_within_the_rows_of_a_text(spark, tmp_path):
    """No text is dealt out, and none is made plain twice; words cut at both ends, marks, blanks and nulls as in SQL."""
    import duckdb

    from auditlake.functions import text as T
    from auditlake.functions.passes import normal_quote
    from auditlake.queries.registry import SQL
    from auditlake.queries.text_queries import quote_verification

    texts = ["Xone two, THREE four… five\nsixty", "one two three", None, "", "a zone two three fourteen", "two three four five", "one of the sea", "None of the\x0b seas", "éone of the", "one two three four five six"]
    items = ["One two: three four five six", "one two three four", "one of the", None, "short", "one two", "two three four five"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = quote_verification(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(0, 2, 0), (1, 3, 0), (2, 3, 6), (6, 3, 0)]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(SQL["quote_verification"].replace(r"[\s!", r"[\s\v!")).fetchall())
    plan = quote_verification(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((.*?)#?\d*L?, \d+\)", plan)) == {"item_id"} and plan.count("FileScan parquet [doc_id") == 1

    odd = ["‘A’ “b”―c−d  e\t\x0b\x0c\r\nF\x1c\x85g   İΣ {x}~[y]`^_ é… ", "''", " ", "â‖‧ €"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(F.lower("t").alias("low"), T.normal_quote(F.col("t")).alias("q")).collect()
    assert [normal_quote(r["low"].encode()).decode() for r in rows] == [r["q"] for r in rows]


def test_reading_counts_by_bytes_equal_the_patterns(spark):
    """Texts put together from what words and sentences turn on, in batches cut anywhere."""
    import random

    import pyarrow as pa

    from auditlake.functions import passes
    from auditlake.functions import text as T

    r = random.Random(7)
    bits = ["Yes", "yelled", "tables", "eyes", "ed", "ued", "be", "axes", "naïve", "it's", "'", "''", "a", "3rd", "rhythm", "queueing", "YYYY", "bees", "he", "ale", ".", "!?", "...", "?x", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "​", "　", "﻿", " ", "é", "…", "‖", "漢", "😀", " ", " ", " ", "  "]
    texts = ["", None, " ", ".", "a", " . ", "\n.", "yes.", "'", "x. \n. y", *("".join(r.choices(bits, k=r.randint(1, 60))) for _ in range(1_500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)
    want = {x["k"]: tuple(x["r"]) for x in rows.select("k", T.reading_ease(F.col("t")).alias("r")).collect() if x["r"]}
    got = passes.reading_eases(rows, "k", "t")
    assert {x["k"]: (x["ease"], x["words"]) for x in got.collect()} == want and len(want) > 1_000
    assert "split(" not in got._jdf.queryExecution().executedPlan().toString()
    whole = pa.array(texts)
    alone = [[int(c[0]) for c in passes.reading_counts(pa.array([t], pa.string()))] for t in texts]
    passes_part, passes.PART = passes.PART, 50
    try:
        assert [list(map(int, c)) for c in zip(*passes.reading_counts(whole.slice(3, 900)), strict=True)] == alone[3:903]
    finally:
        passes.PART = passes_part
    assert [len(c) for c in passes.reading_counts(whole.slice(0, 0))] == [0, 0, 0]


def test_words_are_stripped_once_for_their_syllables(spark):
    from auditlake.functions import text as T

    plan = spark.range(1).select(T.reading_ease(F.lit("a").substr(F.lit(1), F.col("id").cast("int"))).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1


def test_events_are_written_from_batches_and_cut_only_where_there_are_several(spark, tmp_path):
    """The same text as from rows; a task without events leaves no file; all ways of parting blocks are read."""
    import datetime
    import decimal

    import pyarrow as pa

    from auditlake.sources.tables import read_events
    from auditlake.streaming import sink

    schema = "n long, event string, at timestamp, m map<string,long>, s struct<a:double,b:string>, d decimal(9,2)"
    rows = [(i, *x) for i, x in enumerate([("step\nstart", datetime.datetime(2024, 1, 1, 5, 6, 7, 8), {"x": 1}, (0.5, 'line\n"two" é'), decimal.Decimal("1.50")), (None, None, None, None, None), *[("e", None, {}, (None, None), None)] * 2_500])]
    df = spark.createDataFrame(rows, schema)
    w = sink.EventSink({"path": f"file://{tmp_path}/b"}).streamWriter(df.schema, False)
    read = lambda m: (tmp_path / "b/files" / m.file).read_text()
    table = df.toArrow()
    by_batch = w.write(iter(table.to_batches(max_chunksize=700)))
    assert w.write(iter([pa.RecordBatch.from_pylist([], table.schema)])).file is None
    by_row = sink.EventWriter(f"file://{tmp_path}/b", 1).write(iter(df.collect()))
    assert read(by_batch) == read(by_row) and read(by_row).count("\n\n") == len(rows)
    assert read(by_row).startswith('event: step start\ndata: {"at": "2024-01-01 05:06:07.000008", "d": "1.50", "m": {"x": 1}, "n": 0,')
    w.commit([by_batch], 0)
    assert read_events(sink.committed(spark, f"file://{tmp_path}/b")).count() == len(rows)

    texts = ["event: a\ndata: 1\n\nevent: b\ndata: 2\n\n", "event: c\r\ndata: 3\r\n\r\nevent: d\ndata: 4", "event: e\ndata: 5\n\r\ndata: 6", "", None, "event:f\ndata:7\ndata: 8\n"]
    got = read_events(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert sorted(tuple(r) for r in got.collect()) == [("", "6"), ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "7\n8")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
