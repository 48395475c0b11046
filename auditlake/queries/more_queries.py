"""Social reads, vitals, names in text, known sources, and a quota over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.regex import every
from ..operators import state
from ..streaming import windows
from .registry import SQL, per_page, query, rows, table
from .state_queries import _stream

# How profile pages say that they are missing or closed.
NOT_FOUND = r"(this (page|content|account|profile) (isn'?t|is not|is no longer) available|page not found|doesn'?t exist|does not exist|couldn'?t find this (page|account)|sorry, this page isn'?t available|user not found)"
LOGIN_TITLE = r"log ?in|sign ?(in|up)"
LOGIN_TEXT = r"(log ?in|sign ?in|sign ?up|create (a |new )?account|join now)"
GENERIC_TITLE = r"^((facebook|instagram|linkedin|x|twitter|tiktok|pinterest)( - [\w ,'!]{3,30})?|tiktok - make your day|(log in|sign up|login)[\w ,|-]{0,40})$"


def _sql(x: str) -> str:
    return x.replace("'", "''")


_READS = per_page(r"""(VALUES (1, 404, '', ''), (2, 500, '', ''), (3, 200, 'Acme', 'Sorry, this page isn''t available'), (4, 200, 'Log in to Facebook', 'x'), (5, 200, 'Instagram', repeat('word ', 400)), (6, 200, 'Acme Bakery', repeat('bread ', 100)), (7, 200, 'Acme', 'short'), (8, 200, 'Acme', 'Join now to see'))""", "id, status, title, content", title=('Acme', 'Acme{n}'))


@query(rf"""
SELECT CAST(id AS BIGINT) AS id, CASE WHEN status IN (404, 410) THEN 'not_found' WHEN status <> 200 THEN 'unreadable'
  WHEN length(content) < 1500 AND regexp_matches(title || ' ' || left(content, 400), '(?i){_sql(NOT_FOUND)}') THEN 'not_found'
  WHEN regexp_matches(title, '(?i){LOGIN_TITLE}') OR (length(content) < 1500 AND regexp_matches(left(content, 600), '(?i){LOGIN_TEXT}')) THEN 'login_wall'
  WHEN regexp_matches(title, '(?i){_sql(GENERIC_TITLE)}') THEN 'login_wall' WHEN length(content) < 150 THEN 'unreadable' ELSE 'found' END AS status FROM {_READS} v(id, status, title, content)""")
def profile_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's answer says about a social profile."""
    t = rows(spark, f"SELECT * FROM {_READS} AS v(id, status, title, content)", sf_dir)
    title, content, status = F.col("title"), F.col("content"), F.col("status")
    like = lambda c, p: c.rlike("(?i)" + p)
    short = F.length(content) < 1500
    kind = (
        F.when(status.isin(404, 410), "not_found").when(status != 200, "unreadable")
        .when(short & like(F.concat(title, F.lit(" "), F.left(content, F.lit(400))), NOT_FOUND), "not_found")
        .when(like(title, LOGIN_TITLE) | (short & like(F.left(content, F.lit(600)), LOGIN_TEXT)), "login_wall")
        .when(like(title, GENERIC_TITLE), "login_wall").when(F.length(content) < 150, "unreadable").otherwise("found")
    )
    return t.select(F.col("id").cast("long").alias("id"), kind.alias("status"))


_NAME = r"\b[A-Z][A-Za-z'-]{2,}(?:\s+(?:of\s+)?[A-Z][A-Za-z'-]{2,}){0,3}\b"
_OPENS = r"^[A-Z][A-Za-z'-]{2,}\s+[A-Z][A-Za-z'-]{2,}"
_NO = ", ".join(f"'{w}'" for w in T.NOT_ENTITIES)


@query(rf"""
WITH s AS (SELECT source, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
r AS (SELECT source, CASE WHEN regexp_matches(s, '{_sql(_OPENS)}') THEN s ELSE regexp_replace(s, '^\S+\s*', '') END AS s FROM s),
m AS (SELECT source, unnest(regexp_extract_all(s, '{_sql(_NAME)}')) AS m FROM r),
n AS (SELECT source, lower(array_to_string(list_filter(regexp_split_to_array(m, '\s+'), lambda w: lower(w) NOT IN ({_NO})), ' ')) AS name FROM m),
c AS (SELECT source, name, count(*) AS n FROM n WHERE length(name) >= 4 AND name NOT IN ({_NO}) GROUP BY ALL)
SELECT source, name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS place FROM c) WHERE place <= 12""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised names inside sentences, the most repeated of each source."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s"))
    rest = F.when(F.col("s").rlike(_OPENS), F.col("s")).otherwise(F.regexp_replace("s", r"^\S+\s*", ""))
    found = d.select("source", F.explode(every(rest, _NAME, ignore_case=False)).alias("m"))
    name = F.lower(F.array_join(F.filter(F.split("m", r"\s+"), lambda w: ~F.lower(w).isin(T.NOT_ENTITIES)), " "))
    counted = found.select("source", name.alias("name")).where((F.length("name") >= 4) & ~F.col("name").isin(T.NOT_ENTITIES)).groupBy("source", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "name")
    return counted.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 12")


_SIGNALS = per_page("(VALUES (1, 4.0, NULL, NULL), (2, 1.0, false, 5), (3, NULL, NULL, 0), (4, NULL, NULL, 3), (5, 1.0, NULL, 0), (6, NULL, true, NULL))", "id, rank, entity, mentions")


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN rank IS NULL AND entity IS NULL THEN CASE WHEN coalesce(mentions, 0) >= 3 THEN true END ELSE coalesce(rank, 0) >= 3 OR coalesce(entity, false) OR coalesce(mentions, 0) >= 3 END AS known FROM {_SIGNALS} v(id, rank, entity, mentions)""")
def known_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued: known, unknown, or not measured."""
    t = rows(spark, f"SELECT * FROM {_SIGNALS} AS v(id, rank, entity, mentions)", sf_dir)
    known = (F.coalesce(F.col("rank"), F.lit(0)) >= 3) | F.coalesce("entity", F.lit(False)) | (F.coalesce("mentions", F.lit(0)) >= 3)
    measured = F.col("rank").isNotNull() | F.col("entity").isNotNull()
    return t.select(F.col("id").cast("long").alias("id"), F.when(measured | known, known).alias("known"))


_PSI = """{"lighthouseResult":{"audits":{"layout-shifts":{"details":{"items":[{"score":0.1,"node":{"selector":"a"}},{"score":0.4,"node":{"selector":"b"}},{"node":{"selector":"c"}},{"score":0.2,"node":{"selector":"d"}},{"score":0.3,"node":{"selector":"e"}},{"score":0.05,"node":{"selector":"f"}}]}},"bootup-time":{"details":{"items":[{"url":"https://x.test/a.js","total":120.5},{"url":"inline","total":900},{"url":"https://x.test/","total":500},{"url":"https://y.test/b.js","total":300},{"url":"https://y.test/c.js","total":20},{"url":"https://y.test/d.js","total":10}]}}}}}"""


@query("SELECT page_id, kind, name, CAST(amount AS DOUBLE) AS amount, CAST(place AS BIGINT) AS place FROM pages, (VALUES ('shift', 'b', 0.4, 1), ('shift', 'e', 0.3, 2), ('shift', 'd', 0.2, 3), ('shift', 'a', 0.1, 4), ('script', 'https://y.test/b.js', 300, 1), ('script', 'https://x.test/a.js', 121, 2), ('script', 'https://y.test/c.js', 20, 3)) v(kind, name, amount, place)")
def vitals_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest layout shifts and the heaviest scripts in a lab report of unknown shape."""
    r = table(spark, sf_dir, "pages").select("page_id", F.lit("https://x.test/").alias("url"), F.try_parse_json(F.lit(_PSI)).alias("v"))
    items = lambda audit, kind: F.try_variant_get("v", f"$.lighthouseResult.audits['{audit}'].details.items", kind)
    shifts = r.select("page_id", F.lit("shift").alias("kind"), F.explode(items("layout-shifts", "array<struct<score:double,node:struct<selector:string>>>")).alias("i")).where("i.score is not null and i.node is not null").select("page_id", "kind", F.col("i.node.selector").alias("name"), F.col("i.score").alias("amount"))
    scripts = r.select("page_id", "url", F.lit("script").alias("kind"), F.explode(items("bootup-time", "array<struct<url:string,total:double>>")).alias("i")).where(F.col("i.url").rlike("(?i)^https?://") & F.col("i.total").isNotNull() & (F.col("i.url") != F.col("url")))
    scripts = scripts.select("page_id", "kind", F.col("i.url").alias("name"), F.floor(F.col("i.total") + 0.5).cast("double").alias("amount"))
    w = Window.partitionBy("page_id", "kind").orderBy(F.desc("amount"), "name")
    return shifts.unionByName(scripts).withColumn("place", F.row_number().over(w).cast("long")).where("(kind = 'shift' and place <= 4) or (kind = 'script' and place <= 3)")


@query(SQL.get("quota_consume"))
def quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential quota with state, over the events as a stream."""
    events = _stream(spark, sf_dir).where("user_id is not null")
    counts = windows.running_limit(events, "user_id", "ts", state.DAY * 4, 3)
    out = windows.drained(counts, "auditlake_quota")
    return out.groupBy("user_id").agg(F.sum("granted").alias("granted"), F.sum("refused").alias("refused"))
