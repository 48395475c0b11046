"""Limits, quotas, what comes from outside, and tables about pages and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import intake, limits, pages, state
from ..sources.html import parsed
from .registry import per_page, query, rows, table
from .rule_queries import _PLAIN, _TITLE, _n_words
from .url_queries import _registrable

#: Smaller limits than the real ones, so that every rule decides on the events.
_RULES = [("global", "global", state.DAY, 330), ("per-ip", "ip", state.HOUR, 2), ("per-ip-daily", "ip", state.DAY, 6), ("per-target", "target", state.HOUR, 4), ("per-ip", "refund", state.HOUR, 1)]


def _full(reason: str, kind: str, window: int, limit: int, place: int) -> str:
    name = "'global'" if kind == "global" else f"'{kind}:' || a.{'domain' if kind == 'target' else 'ip'}"
    return f"SELECT a.event_id, {place} AS place, '{reason}' AS reason, {window} - (a.us - min(h.us)) AS wait FROM a JOIN h ON h.bucket = {name} AND h.us > a.us - {window} AND h.us <= a.us GROUP BY a.event_id, a.us HAVING count(*) >= {limit}"


@query(f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, CAST(user_id % 60 AS VARCHAR) AS ip, CAST(user_id % 7 AS VARCHAR) AS domain, event_id % 25 = 3 AS back FROM events),
a AS (SELECT * FROM e),
h AS (SELECT 'global' AS bucket, us FROM e UNION ALL SELECT 'target:' || domain, us FROM e UNION ALL SELECT 'ip:' || ip, us FROM e WHERE NOT back UNION ALL SELECT 'refund:' || ip, us FROM e WHERE back),
f AS ({" UNION ALL ".join(_full(*r, place=i) for i, r in enumerate(_RULES))}),
b AS (SELECT event_id, min_by(reason, place) AS reason, min_by(wait, place) AS retry_after_us FROM f GROUP BY event_id)
SELECT a.event_id, reason, CAST(retry_after_us AS BIGINT) AS retry_after_us FROM a LEFT JOIN b USING (event_id)""")
def rate_limit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules over global, visitor, target and refund buckets; every scan leaves three hits, some are refunded."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 60).cast("string").alias("ip"), (F.col("user_id") % 7).cast("string").alias("domain"))
    hits = limits.refunded(limits.committed(e), e.where("event_id % 25 = 3"))
    return limits.peek_all(e, hits, "event_id", rules=_RULES)


_PROVIDER = "CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'llm' WHEN 1 THEN 'pagespeed' WHEN 2 THEN 'search' WHEN 3 THEN 'authority' WHEN 4 THEN 'instagram' ELSE 'other' END"
_BUDGET = "CASE provider " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in limits.QUOTAS.items()) + " ELSE 0 END"
_LEFT = f"list_filter(r.granted, lambda t: t > e.us - {state.DAY})"


@query(f"""
WITH RECURSIVE c AS (SELECT event_id, epoch_us(ts) AS us, {_PROVIDER} AS provider FROM events),
e AS (SELECT *, {_BUDGET} AS most, row_number() OVER (PARTITION BY provider ORDER BY us, event_id) AS n FROM c),
r AS (SELECT provider, n, CASE WHEN most > 0 THEN [us] ELSE [] END AS granted, CASE WHEN most > 0 THEN 1 ELSE 0 END AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.provider, e.n, CASE WHEN len({_LEFT}) < e.most THEN list_append({_LEFT}, e.us) ELSE {_LEFT} END, CASE WHEN len({_LEFT}) < e.most THEN 1 ELSE 0 END FROM r JOIN e ON e.provider = r.provider AND e.n = r.n + 1)
SELECT provider, CAST(sum(ok) AS BIGINT) AS granted, CAST(count(*) - sum(ok) AS BIGINT) AS refused FROM r GROUP BY provider""")
def provider_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_id", "ts", F.expr(_PROVIDER).alias("provider"))
    return limits.spend(calls, "provider", "ts", "event_id").groupBy("provider").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("refused"))


_CLIENTS = per_page("(VALUES (1, true, '1.2.3.4, 5.6.7.8', '9.9.9.9'), (2, true, NULL, '9.9.9.9'), (3, true, '', NULL), (4, false, '1.2.3.4', NULL), (5, NULL, '1.2.3.4', '1.1.1.1'), (6, true, ' 7.7.7.7 ', NULL))", "id, trusted, fwd, real_ip", real_ip=('9.9.9.9', '9.9.9.{n}'))


@query(f"SELECT id, CASE WHEN NOT coalesce(trusted, false) THEN 'untrusted-client' WHEN coalesce(fwd, '') <> '' THEN trim(split_part(fwd, ',', 1)) ELSE coalesce(real_ip, 'unknown') END AS ip FROM {_CLIENTS} v(id, trusted, fwd, real_ip)")
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, f"SELECT * FROM {_CLIENTS} AS v(id, trusted, fwd, real_ip)", sf_dir).select("id", limits.client_ip(F.col("trusted"), F.col("fwd"), F.col("real_ip")).alias("ip"))


_FILES = per_page("(VALUES (1, 200, 'text/plain', 'User-agent: *'), (2, 404, 'text/plain', 'gone'), (3, 200, 'text/html; charset=utf-8', 'hello'), (4, 200, NULL, '  <html>'), (5, 200, NULL, '# llms'), (6, 200, 'TEXT/HTML', 'x'), (7, 200, 'text/plain', NULL))", "id, status, kind, body", body=('User-agent: *', 'User-agent: a{n}'))


@query(f"SELECT id, CASE WHEN status = 200 AND NOT contains(lower(coalesce(kind, '')), 'html') AND NOT regexp_matches(body, '^\\s*<') THEN body END AS file FROM {_FILES} v(id, status, kind, body)")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, f"SELECT * FROM {_FILES} AS v(id, status, kind, body)", sf_dir).select("id", intake.text_file(F.col("status"), F.col("kind"), F.col("body")).alias("file"))


_MAPS = per_page("(VALUES (1, '<urlset><url><loc> https://a.test/x?a=1&amp;b=2 </loc></url><url><LOC><![CDATA[https://a.test/y?c=1&d=2]]></LOC></url></urlset>'), (2, '<urlset></urlset>'), (3, '<loc></loc><loc>&lt;odd&gt;&quot;&apos;</loc>'), (4, '<loc><![CDATA[ https://a.test/z ]]></loc>'))", "id, xml", xml=('a.test', 'a{n}.test'))
_DECODED = "replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@query(rf"""
SELECT id, place, CASE WHEN starts_with(x, '<![') THEN trim(x[10:-4]) ELSE {_DECODED} END AS loc FROM (
  SELECT id, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS x FROM (SELECT id, regexp_extract_all(xml, '(?is)<loc>\s*(<!\[CDATA\[.*?\]\]>|[^<\s][^<]*?)\s*</loc>', 1) AS l FROM {_MAPS} v(id, xml)))""")
def sitemap_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rows(spark, f"SELECT * FROM {_MAPS} AS v(id, xml)", sf_dir)
    return m.select("id", F.posexplode(intake.sitemap_locations(F.col("xml"))).alias("p", "loc")).select("id", (F.col("p") + 1).cast("long").alias("place"), "loc")


_LOGS = per_page("(VALUES (1, 'error', 'Hydration failed because the server'), (2, 'log', 'Hydration failed'), (3, 'warning', 'Text content did not match. Server: a Client: b'), (4, 'warn', 'hydrating 345 sections'), (5, 'error', 'Minified React error #418; visit'), (6, 'error', 'Minified React error #417'), (7, 'error', 'Prop `class` did not match'), (8, NULL, 'hydration mismatch'))", "id, kind, message")


@query(f"SELECT id, coalesce(kind IN ('error', 'warning', 'warn') AND regexp_matches(message, '(?i){intake.HYDRATION}'), false) AS hit FROM {_LOGS} v(id, kind, message)")
def hydration_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, f"SELECT * FROM {_LOGS} AS v(id, kind, message)", sf_dir).select("id", intake.is_hydration_error(F.col("kind"), F.col("message")).alias("hit"))


_SNIPPETS = per_page("""(VALUES (1, '<img src="/a.png">', 'https://x.test/p/q'), (2, '<img src="b.png">', 'https://x.test/p/q'), (3, '<div style="background:url(https://cdn.test/c.png)">', 'https://x.test/'), (4, '<img src="data:image/png;base64,xx">', 'https://x.test/'), (5, '<h1>none</h1>', 'https://x.test/'), (6, '<img src="//cdn.test/d.png">', 'https://x.test/'))""", "id, snippet, page", page=('x.test', 'x{n}.test'))


@query(rf"""
WITH s AS (SELECT id, coalesce(nullif(regexp_extract(snippet, '(?i)\bsrc="([^"]+)"', 1), ''), nullif(regexp_extract(snippet, '(?i)url\(([^)]+)\)', 1), '')) AS src, page FROM {_SNIPPETS} v(id, snippet, page))
SELECT id, CASE WHEN starts_with(src, 'http') THEN src WHEN regexp_matches(src, '^[a-z]+:') THEN NULL WHEN starts_with(src, '//') THEN 'https:' || src WHEN starts_with(src, '/') THEN regexp_extract(page, '^[a-z]+://[^/]+') || src ELSE regexp_replace(page, '[^/]*$', '') || src END AS resource FROM s""")
def lcp_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, f"SELECT * FROM {_SNIPPETS} AS v(id, snippet, page)", sf_dir).select("id", intake.lcp_resource(F.col("snippet"), F.col("page")).alias("resource"))


_REPLIES = per_page("(VALUES (1, 12, 'Acme', 6.449D, 'acme corp|ACME '), (2, -1, 'Acme', 11.0D, 'Acme Ltd'), (3, 10000001, '', 0.0D, 'x'), (4, NULL, NULL, NULL, NULL), (5, 10000000, 'Bo', 9.95D, 'bo'))", "id, links, entity, rank, labels")


@query(f"""SELECT id, CASE WHEN links BETWEEN 0 AND 10000000 THEN links END AS links, CASE WHEN rank BETWEEN 0 AND 10 THEN floor(rank * 10 + 0.5) / 10 END AS rank,
  CASE WHEN coalesce(trim(entity), '') <> '' THEN coalesce(list_contains(list_transform(string_split(labels, '|'), lambda x: lower(trim(x))), lower(trim(entity))), false) END AS known FROM {_REPLIES.replace('D,', ',')} v(id, links, entity, rank, labels)""")
def outside_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a render reply, a domain's rank and an exactly named entity."""
    r = rows(spark, f"SELECT * FROM {_REPLIES} AS v(id, links, entity, rank, labels)", sf_dir)
    return r.select("id", intake.measured(F.col("links")).alias("links"), intake.domain_rank(F.col("rank")).alias("rank"), intake.named_exactly(F.col("entity"), F.split("labels", r"\|")).alias("known"))


_IDEAS = per_page("""(VALUES (1, 1, 'Add a price list', 'Buyers look for it', 'content:cta-present', 'low'), (1, 2, 'add a PRICE list', 'Again', 'content:cta-present', 'low'), (1, 3, 'See www.evil.test', 'x', 'content:cta-present', 'low'), (1, 4, 'Call us', 'on +44 113 555 0199 today', 'content:cta-present', 'low'),
  (1, 5, 'Made up', 'x', 'no:such', 'low'), (1, 6, 'Hi', 'too short', 'geo:llms-txt', 'low'), (1, 7, 'Write a guide', 'It helps', 'geo:llms-txt', 'huge'), (1, 8, 'Write a summary', 'It helps', 'geo:llms-txt', 'high'), (2, 1, 'Use `curl`', 'x', 'geo:llms-txt', 'low'), (2, 2, 'Show reviews', 'Trust', 'geo:llms-txt', 'medium'), (2, 3, 'Mail a@b.test', 'x', 'geo:llms-txt', 'low'))""", "site, ord, title, why, cites, effort")
_FOUND = per_page("(VALUES (1, 'content:cta-present'), (1, 'geo:llms-txt'), (2, 'geo:llms-txt'))", "site, id")
_UNSAFE = "(?i)" + intake.UNSAFE_IDEA.replace("'", "''")


@query(f"""
WITH g AS (SELECT i.* FROM {_IDEAS} i(site, ord, title, why, cites, effort) WHERE effort IN ('low', 'medium', 'high') AND length(trim(title)) >= 3 AND NOT regexp_matches(title, '{_UNSAFE}') AND NOT regexp_matches(why, '{_UNSAFE}')
  AND EXISTS (SELECT 1 FROM {_FOUND} f(site, id) WHERE f.site = i.site AND f.id = i.cites)),
o AS (SELECT *, row_number() OVER (PARTITION BY site, lower(title) ORDER BY ord) AS n FROM g)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY ord) AS place, title, cites FROM o WHERE n = 1""")
def ideas_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.usable_ideas(rows(spark, f"SELECT * FROM {_IDEAS} AS v(site, ord, title, why, cites, effort)", sf_dir), rows(spark, f"SELECT * FROM {_FOUND} AS v(site, id)", sf_dir))


_H = r"lower(regexp_extract(url, '://([^/?#:]*)', 1))"


@query(f"""
WITH p AS (SELECT page_id, CAST(page_id // 8 AS INT) AS site, {_H} AS h FROM pages),
n AS (SELECT site, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS source_ord, page_id AS pos, CASE WHEN page_id % 3 = 0 THEN 'shop.' || h ELSE h END AS domain FROM p),
r AS (SELECT *, {_registrable("domain")} AS reg FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY site, reg ORDER BY source_ord, pos) AS n FROM r WHERE reg <> 'example.com'),
q AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY source_ord, pos) AS place, domain, CASE WHEN source_ord = 0 THEN 'ai' ELSE 'search' END AS source FROM k WHERE n = 1)
SELECT * FROM q WHERE place <= 6""")
def competitor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivals named by a model, then by a search; one of each registrable domain."""
    h = U.host(F.col("url"))
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).cast("int").alias("site"), F.lit("www.example.com").alias("own"), (F.col("page_id") % 2).cast("int").alias("source_ord"), F.when(F.col("page_id") % 2 == 0, "ai").otherwise("search").alias("source"), F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("shop."), h)).otherwise(h).alias("domain"))
    return intake.candidates(p, 6)


_RESOLVED = per_page("(VALUES (1, '93.184.216.34'), (2, '10.0.0.1'), (3, '93.184.216.34|127.0.0.1'), (4, ''), (5, '169.254.169.254'), (6, 'nonsense'), (7, '8.8.8.8|1.1.1.1'))", "id, addresses")
_NETS = [("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16)]


@query(f"""SELECT id, addresses <> '' AND len(list_filter(string_split(addresses, '|'), lambda x: NOT regexp_full_match(x, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') OR regexp_matches(x, '^(10|127)[.]|^169[.]254[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]'))) = 0 AS public FROM {_RESOLVED} v(id, addresses)""")
def public_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, f"SELECT * FROM {_RESOLVED} AS v(id, addresses)", sf_dir)
    numbers = F.transform(F.filter(F.split("addresses", r"\|"), lambda x: x != ""), U.ipv4_number)
    return r.select("id", intake.host_is_public(numbers, [U.network_range(*n) for n in _NETS]).alias("public"))


_KEY = r"rtrim(regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://(www\.)?', ''), '/')"


@query(rf"""
WITH e AS (SELECT DISTINCT p.page_id % 9 AS finding, {_KEY} AS k FROM pages p WHERE page_id % 3 = 0 UNION SELECT DISTINCT 100 + page_id % 4, {_KEY} FROM pages WHERE page_id % 2 = 0),
n AS (SELECT k, count(*) AS issues FROM e GROUP BY k)
SELECT url, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'))[1:120] AS title, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1, {_n_words(_PLAIN)} AS words, coalesce(issues, 0) AS issues FROM pages LEFT JOIN n ON {_KEY} = k""")
def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each page and how many findings name it."""
    p = table(spark, sf_dir, "pages")
    facts = parsed(p).select("url", F.col("dom.title_line").alias("title"), F.col("dom.h1_text").alias("headline"), F.col("dom.h1").cast("long").alias("h1"), T.word_count(F.col("dom.text")).alias("words"))
    twice = F.explode(F.array("url", "url"))
    evidence = p.where("page_id % 3 = 0").select((F.col("page_id") % 9).alias("finding"), twice.alias("url")).unionByName(p.where("page_id % 2 = 0").select((100 + F.col("page_id") % 4).alias("finding"), "url"))
    return pages.page_table(facts, evidence).drop("headline")


_TRUTH = "(SELECT CAST(l_orderkey AS INT) AS site, CAST(l_partkey % 9 AS INT) AS id, CASE WHEN (l_orderkey + l_partkey % 9) % 3 = 0 THEN 'absent' ELSE 'expect' END AS kind, l_orderkey % 2 = 0 AS exact FROM lineitem WHERE l_orderkey % 5 = 0 AND l_partkey % 9 < 6)"
_SEEN = "(SELECT DISTINCT CAST(l_orderkey AS INT) AS site, CAST(l_partkey % 9 AS INT) AS id FROM lineitem WHERE (l_suppkey + l_partkey) % 4 <> 1)"


@query(f"""
WITH t AS (SELECT DISTINCT * FROM {_TRUTH}), s AS {_SEEN}, j AS (SELECT coalesce(t.site, s.site) AS site, coalesce(t.id, s.id) AS id, t.kind, s.id IS NOT NULL AS hit FROM t FULL JOIN s ON t.site = s.site AND t.id = s.id), x AS (SELECT site, bool_or(exact) AS exact FROM t GROUP BY site)
SELECT site, count(*) FILTER (kind = 'expect') AS n_expected, count(*) FILTER (kind = 'expect' AND hit) AS n_found, count(*) FILTER (hit AND (kind = 'absent' OR (kind IS NULL AND exact))) AS n_false FROM j JOIN x USING (site) GROUP BY site""")
def findings_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings against expected, absent and exact ones, by a full outer join."""
    site, id = F.col("l_orderkey").cast("int"), (F.col("l_partkey") % 9).cast("int")
    lines = table(spark, sf_dir, "lineitem")
    truth = lines.where("l_orderkey % 5 = 0 and l_partkey % 9 < 6").select(site.alias("site"), id.alias("id"), F.when((site + id) % 3 == 0, "absent").otherwise("expect").alias("kind"), (site % 2 == 0).alias("exact"))
    return pages.compared(lines.where("(l_suppkey + l_partkey) % 4 <> 1").select(site.alias("site"), id.alias("id")), truth)


@query("""
SELECT user_id AS run, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms, count(*) FILTER (event_type <> 'error') AS n_done, count(*) FILTER (event_type = 'error') AS n_warned, max_by(event_type, {'ms': CAST(floor(value) AS BIGINT), 'step': event_type}) AS slowest FROM events GROUP BY user_id""")
def telemetry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pages.telemetry_totals(e.select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.floor("value").cast("long").alias("ms"), (F.col("event_type") == "error").alias("warned")))


@query("""
WITH m AS (SELECT user_id AS run, 'n_events' AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id UNION ALL SELECT DISTINCT user_id, 'score_' || event_type, CAST(user_id % 101 AS DOUBLE) FROM events WHERE event_type <> 'click'
  UNION ALL SELECT user_id, 'step_ms_' || event_type, CAST(sum(event_id) AS DOUBLE) FROM events GROUP BY ALL)
SELECT run, string_agg(name || '=' || CAST(CAST(value AS BIGINT) AS VARCHAR), ' ' ORDER BY name) AS metrics FROM m GROUP BY run""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map of numbers a run; a module without score is left out."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n_events"))
    modules = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("module"), F.when(F.col("event_type") != "click", F.col("user_id") % 101).alias("score")).distinct()
    made = pages.run_metrics(runs, modules, e.select(F.col("user_id").alias("run"), F.col("event_type").alias("step"), F.col("event_id").alias("ms")))
    line = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("long").cast("string"))
    return made.select("run", F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), line), " ").alias("metrics"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS site, o_orderstatus || o_orderpriority AS value FROM orders WHERE o_orderkey % 7 = 0), t AS (SELECT DISTINCT o_custkey AS site, o_orderkey % 3 AS rival, o_orderstatus || o_orderpriority AS value FROM orders WHERE o_orderkey % 7 = 1)
SELECT t.site, rival, count(o.value) AS n_shared FROM t LEFT JOIN o ON o.site = t.site AND o.value = t.value GROUP BY t.site, rival""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 3).alias("rival"), F.concat("o_orderstatus", "o_orderpriority").alias("value"), "o_orderkey")
    return pages.shared_values(o.where("o_orderkey % 7 = 0").select("site", "value"), o.where("o_orderkey % 7 = 1").select("site", "rival", "value"))


@query("""
SELECT DISTINCT o_custkey AS site, 'orders' AS what, o_orderpriority AS why FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey, 'customers', c_mktsegment FROM customer UNION SELECT s_suppkey, 'suppliers', 'late' FROM supplier""")
def could_not_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return pages.could_not_check(
        t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("site"), F.lit("orders").alias("what"), F.col("o_orderpriority").alias("why")),
        t("customer").select(F.col("c_custkey").alias("site"), F.lit("customers").alias("what"), F.col("c_mktsegment").alias("why")),
        t("supplier").select(F.col("s_suppkey").alias("site"), F.lit("suppliers").alias("what"), F.lit("late").alias("why")),
    )


@query("""
WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord, l_quantity FROM lineitem), b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_quantity) AS ord, l_discount FROM lineitem WHERE l_linenumber > 1)
SELECT l_orderkey, ord, l_quantity, l_discount FROM a JOIN b USING (l_orderkey, ord)""")
def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists paired by place."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem")
    w, tie = Window.partitionBy("l_orderkey"), ("l_partkey", "l_suppkey", "l_quantity")
    a = lines.select("l_orderkey", F.row_number().over(w.orderBy("l_linenumber", *tie)).cast("long").alias("ord"), "l_quantity")
    b = lines.where("l_linenumber > 1").select("l_orderkey", F.row_number().over(w.orderBy(F.desc("l_linenumber"), *tie)).cast("long").alias("ord"), "l_discount")
    return pages.positional(a, b, ["l_orderkey"])
