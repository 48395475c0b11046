"""Windows, quotas, telemetry, streams, reviews and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review, sinks, state
from ..operators import scoring as S
from ..streaming import windows
from .registry import query, table
from .source_queries import in_slices
from .score_queries import _EFF, _F, _GRADE, _OV, _SEV, outcomes

_END = "(SELECT max(epoch_us(ts)) FROM events)"


def _now(events: DataFrame) -> DataFrame:
    return events.agg(F.max(state.micros("ts")).alias("now"))


@query("""
SELECT event_type AS step, count(*) AS runs, CAST(floor(median(value) + 0.5) AS BIGINT) AS median_ms, CAST(floor(max(value) + 0.5) AS BIGINT) AS max_ms,
  CAST(floor(100.0 * count(*) FILTER (CAST(json_extract(props, '$.k') AS INT) >= 80) / count(*) + 0.5) AS BIGINT) AS warned_percent FROM events GROUP BY event_type""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return state.telemetry(e.select(F.col("event_type").alias("step"), F.col("value").alias("ms"), (F.get_json_object("props", "$.k").cast("int") >= 80).alias("warned")))


_RULES = [("hourly", state.HOUR * 24, 3), ("daily", state.DAY * 3, 6)]


@query(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
w AS (SELECT *, count(*) OVER h AS nh, min(us) OVER h AS oh, count(*) OVER d AS nd, min(us) OVER d AS od FROM e
  WINDOW h AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {_RULES[0][1] - 1} PRECEDING AND 1 PRECEDING), d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {_RULES[1][1] - 1} PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN nh >= 3 THEN 'hourly' WHEN nd >= 6 THEN 'daily' END AS reason, CAST(CASE WHEN nh >= 3 THEN {_RULES[0][1]} - (us - oh) WHEN nd >= 6 THEN {_RULES[1][1]} - (us - od) END AS BIGINT) AS retry_after_us FROM w""")
def rate_limit_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which limit each request of a user would meet, and for how long."""
    return state.peek(table(spark, sf_dir, "events"), "user_id", "ts", _RULES).select("event_id", "reason", "retry_after_us")


@query(f"""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) AS n FROM events WHERE epoch_us(ts) > {_END} - {state.DAY}) WHERE n = 1""")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each key within a day of the last event."""
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(_now(table(spark, sf_dir, "events"))))
    return state.latest(e.select("user_id", "event_id", "value", "ts", "now"), "user_id", "ts", F.col("now"), state.DAY).select("user_id", "event_id", "value")


@query(f"SELECT event_type, count(*) FILTER (epoch_us(ts) > {_END} - {10 * state.DAY}) AS kept, count(*) FILTER (epoch_us(ts) <= {_END} - {10 * state.DAY}) AS purged FROM events GROUP BY event_type")
def report_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(_now(table(spark, sf_dir, "events"))))
    fresh = state.micros("ts") > F.col("now") - 10 * state.DAY
    return e.groupBy("event_type").agg(F.count_if(fresh).alias("kept"), F.count_if(~fresh).alias("purged"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
r AS (SELECT user_id, n, us, [us] AS granted, 1 AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.us, CASE WHEN len(list_filter(r.granted, lambda t: t > e.us - {state.DAY * 4})) < 3 THEN list_append(list_filter(r.granted, lambda t: t > e.us - {state.DAY * 4}), e.us) ELSE list_filter(r.granted, lambda t: t > e.us - {state.DAY * 4}) END,
    CASE WHEN len(list_filter(r.granted, lambda t: t > e.us - {state.DAY * 4})) < 3 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, CAST(sum(ok) AS BIGINT) AS granted, CAST(count(*) - sum(ok) AS BIGINT) AS refused FROM r GROUP BY user_id""")
def quota_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grants in four days, refusals free of charge: sequential in each bucket."""
    g = state.consume(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", state.DAY * 4, 3)
    return g.groupBy("user_id").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


_STEPS = "SELECT user_id AS scan_id, event_type AS step, epoch_us(ts) AS us, CASE CAST(json_extract(props, '$.k') AS INT) % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'done' ELSE 'warn' END AS kind FROM events"


@query(f"""WITH s AS ({_STEPS}), l AS (SELECT *, lag(kind) OVER w AS before, lag(us) OVER w AS began FROM s WINDOW w AS (PARTITION BY scan_id, step ORDER BY us, kind))
SELECT step, count(*) AS runs, CAST(sum(us - began) AS BIGINT) AS took_us, count(*) FILTER (kind = 'warn') AS warned FROM l WHERE kind <> 'start' AND before = 'start' GROUP BY step""")
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("step"), state.micros("ts").alias("us"), F.when(k == 0, "start").when(k == 1, "done").otherwise("warn").alias("kind"))
    return state.step_times(e).groupBy("step").agg(F.count("*").alias("runs"), F.sum("took_us").alias("took_us"), F.count_if("warned").alias("warned"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four batches by time and one that lets the watermark pass them all."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return in_slices(e)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by hour over the events as a stream, until the files present are read."""
    s = windows.hits_per_window(_stream(spark, sf_dir), "event_type", "ts")
    return windows.drained(s, "auditlake_hits", mode="append").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM e)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's visits, six hours apart or more, over the events as a stream."""
    s = windows.sessions(_stream(spark, sf_dir), "user_id", "ts", "6 hours")
    return windows.drained(s, "auditlake_sessions", mode="append").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""SELECT source, count(*) AS labelled, count(*) FILTER (bad AND quality = 0) AS hits, count(*) FILTER (bad AND quality = 1) AS false_alarms, count(*) FILTER (NOT bad AND quality = 0) AS missed
FROM (SELECT source, quality, len(regexp_extract_all(text, '[#*$%&|!]')) * 10 > length(text) AS bad FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain rule against the labels: hits, false alarms, misses."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bad = F.regexp_count("text", F.lit("[#*$%&|!]")) * 10 > F.length("text")
    j = d.select("source", "quality", bad.alias("bad"))
    return j.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("bad") & (F.col("quality") == 0)).alias("hits"), F.count_if(F.col("bad") & (F.col("quality") == 1)).alias("false_alarms"), F.count_if(~F.col("bad") & (F.col("quality") == 0)).alias("missed"))


_REPLIES = [
    (1, 1, 'Sure: ```json\n{"items":[{"id":"audience","passed":true,"quote":"For small shops, everywhere"}]}\n``` {"items":[{"id":"value-prop","passed":false,"quote":"we make great bread","severity":"low"}]}'),
    (1, 2, '{"items":[{"id":"audience","passed":false,"quote":"we make great bread"},{"id":"cta-clarity","passed":true,"quote":"not on the page at all"}]}'), (2, 1, "no json here {broken"), (3, 1, '[[[[{"items":[{"id":"audience","passed":true,"quote":"two words"}]}'),
]
_EXPECTED = [(1, "audience", "true", ""), (1, "cta-clarity", "", "no quote from the page"), (1, "value-prop", "false", ""), *[(s, i, "", "not answered") for s in (2, 3) for i in ("audience", "cta-clarity", "value-prop") if (s, i) != (3, "audience")], (3, "audience", "", "no quote from the page")]


@query("SELECT page_id AS site, id, CAST(nullif(passed, '') AS BOOLEAN) AS passed, nullif(why, '') AS unchecked FROM pages JOIN (VALUES " + ", ".join(f"({s}, '{i}', '{p}', '{w}')" for s, i, p, w in _EXPECTED) + ") v(kind, id, passed, why) ON page_id % 3 + 1 = kind")
def ai_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of one of three kinds on every page, checked against its texts."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), (F.col("page_id") % 3 + 1).alias("kind"))
    replies = p.join(F.broadcast(spark.createDataFrame(_REPLIES, "kind long, round int, reply string")), "kind").drop("kind")
    rubric = spark.createDataFrame([(i, i, "rework") for i in ("value-prop", "audience", "cta-clarity")], "id string, title string, fix string")
    pages = p.select("site", *[F.lit(v).alias(c) for c, v in (("url", "https://x.test/"), ("title", "Bakery"), ("description", "For small shops everywhere"), ("h1", "We make GREAT bread!"), ("body", "two words more"))])
    return review.reviewed(review.answers(replies), rubric, pages, "content", 5).select("site", "id", "passed", "unchecked")


@query(f"""WITH {_F}, t AS (SELECT site, string_agg(place || '. [' || upper(severity) || '] Problem with ' || split_part(id, ':', 2), chr(10) ORDER BY place) AS body FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sev, eff, module_ord, check_ord) AS place FROM f) WHERE place <= 10 GROUP BY site)
SELECT site, 'An audit found these problems, the worst first. Give the exact change for each.' || chr(10) || chr(10) || body AS prompt FROM t""")
def fix_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fix_prompt(S.top_fixes(S.findings(outcomes(spark, sf_dir))))


@query(f"""WITH {_F}, k AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{k}', '{i}')" for n, (k, ids) in enumerate(sinks.KIT.items()) for i in ids)}) v(n, item, id)),
h AS (SELECT DISTINCT site, n, item FROM f JOIN k USING (id)), s AS (SELECT DISTINCT site FROM f)
SELECT site, concat_ws(' ', (SELECT string_agg(item, ' ' ORDER BY n) FROM h WHERE h.site = s.site), 'scheduled-audit') AS items FROM s""")
def fix_kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fix_kit(S.findings(outcomes(spark, sf_dir)))


@query(f"""
WITH {_OV}, g AS (SELECT site, overall, {_GRADE.format('overall')} AS grade FROM t), f AS (SELECT site, CAST(module_text AS INT) AS module_ord, check_ord, id, severity, effort, {_SEV} AS sev, {_EFF} AS eff FROM o WHERE found),
p AS (SELECT site, string_agg(place || '. Problem with ' || id || ' (' || severity || ', ' || effort || ' effort)', chr(10) ORDER BY place) AS fixes FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sev, eff, module_ord, check_ord) AS place FROM f) WHERE place <= 10 GROUP BY site),
r AS (SELECT site, '| Module | Score |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || module || ' | ' || coalesce(CAST(score AS VARCHAR), 'n/a') || ' |', chr(10) ORDER BY module) AS modules FROM m GROUP BY site)
SELECT g.site, '# Audit of ' || g.site || chr(10) || chr(10) || 'Overall ' || coalesce(CAST(overall AS VARCHAR), 'n/a') || ', grade ' || coalesce(grade, 'n/a') || coalesce(chr(10) || chr(10) || modules, '') || chr(10) || chr(10) || '## Top fixes' || chr(10) || chr(10) || coalesce(fixes, 'No issues found.') AS report
FROM g LEFT JOIN r USING (site) LEFT JOIN p USING (site)""")
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    m = S.module_scores(o)
    return sinks.markdown(S.overall_scores(m), m, S.top_fixes(S.findings(o)))
