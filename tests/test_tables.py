"""Report storage, event text, quotas with refunds, and the entry module without the optional subpackage."""

from __future__ import annotations

import datetime
import os
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from auditlake.operators import state
from auditlake.operators.review import json_values
from auditlake.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_latest_version_of_a_report_is_read(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("a", at(1), "old", "1"), ("a", at(3), "new", "3"), ("b", at(2), "only", "2")]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, report string, day string")
    tables.append_reports(df.where("day = '1'"), f"{tmp_path}/r")
    tables.append_reports(df.where("day <> '1'"), f"{tmp_path}/r")
    assert {r["id"]: r["report"] for r in tables.read_reports(spark, f"{tmp_path}/r").collect()} == {"a": "new", "b": "only"}


def test_event_text(spark):
    text = "event: start\ndata: one\n\nevent: done\ndata: two\ndata: three\n\n"
    assert [tuple(r) for r in tables.read_events(spark.createDataFrame([(text,)], "value string")).collect()] == [("start", "one"), ("done", "two\nthree")]


def test_a_refund_takes_one_hit_back(spark):
    at = datetime.datetime(2024, 1, 1)
    hits = spark.createDataFrame([("x", at), ("x", at), ("y", at)], "bucket string, ts timestamp")
    left = state.refund(hits, spark.createDataFrame([("x", at), ("z", at)], "bucket string, ts timestamp"), "bucket", "ts")
    assert sorted(r["bucket"] for r in left.collect()) == ["x", "y"]


def test_json_in_replies():
    assert json_values('a {"x": 1} b ```json [2]``` {broken {"y": "}"}') == ['{"x": 1}', "[2]", '{"y": "}"}']
    assert json_values(None) == [] and json_values("[" * 100) == []


def test_the_entry_module_stands_alone(tmp_path):
    for name in ("auditlake", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/auditlake/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op1_') for q in e.queries()) and e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=120).returncode == 0


def test_robots_paths_with_stars(spark):
    from auditlake.sources.robots import fits

    rules = ["/", "/a", "/a*", "/*.pdf$", "/a*b*c", "/a$", "*", "/**x", "/*a*a*$", "", "$", "/a*b$"]
    paths = ["/", "/a", "/ab", "/x.pdf", "/x.pdf?y", "/axbxc", "/abc/more", "/aa", "/b", "/axb", "/axbc", ""]

    def plain(path, rule):
        body = rule[:-1] if rule.endswith("$") else rule
        return re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if rule.endswith("$") else ""), path) is not None

    table = spark.createDataFrame([(p, r) for p in paths for r in rules], "path string, rule string")
    for r in table.select("path", "rule", fits(F.col("path"), F.col("rule")).alias("fits")).collect():
        assert r["fits"] == plain(r["path"], r["rule"]), r
    hostile = spark.createDataFrame([("/" + "a" * 2000, "/" + "*a" * 1000 + "*b")], "path string, rule string")
    assert not hostile.select(fits(F.col("path"), F.col("rule"))).first()[0]


def test_members_that_did_not_run_are_named(spark):
    from auditlake.operators import scoring

    run = spark.createDataFrame([(1, "geo", "llms-txt", True, None)], "site int, module string, id string, passed boolean, finding string")
    left = {(r["component"], r["member"]) for r in scoring.not_run(run).collect()}
    every = {(c, k) for c, (_, ms) in scoring.READINESS.items() for k in ms}
    assert left == {(c, k) for c, k in every if k != "geo:llms-txt"} and left != every


def test_pages_over_the_limit_are_marked_as_cut(spark):
    from auditlake.plans.engine import page_responses

    pages = spark.createDataFrame([(1, "https://a.test/", "<p>x</p>"), (2, "https://b.test/", "\u00fc" * 1_100_000)], "page_id long, url string, html string")
    assert {r["site"]: r["truncated"] for r in page_responses(pages).collect()} == {"a.test": False, "b.test": True}


def test_limits_share_no_hits_between_windows(spark):
    """Against a plain loop, with hits at both edges of the window."""
    from auditlake.operators import limits

    hour = 3600
    scans = [(i, "1.1.1.1" if i % 2 else "2.2.2.2", f"d{i % 3}.test", t) for i, t in enumerate([0, 1, 2, 3, hour, hour + 1, hour + 2, 2 * hour, 2 * hour + 3, 86_400, 86_401, 90_000])]
    rules = [("global", "global", limits.DAY, 9), ("per-ip", "ip", limits.HOUR, 3), ("per-target", "target", limits.HOUR, 2)]
    df = spark.createDataFrame(scans, "id int, ip string, domain string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["reason"], r["retry_after_us"]) for r in limits.peek_all(df, limits.committed(df), "id", rules=rules).collect()}
    for i, ip, domain, t in scans:
        want = (None, None)
        for reason, kind, window, limit in rules:
            same = [x[3] for x in scans if (kind == "global" or (kind == "ip" and x[1] == ip) or (kind == "target" and x[2] == domain)) and t - window // 1_000_000 < x[3] <= t]
            if len(same) >= limit:
                want = (reason, window - (t - min(same)) * 1_000_000)
                break
        assert got[i] == want, i
