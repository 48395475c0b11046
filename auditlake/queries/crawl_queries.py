"""Page source, snapshots, references, address ranges and the crawl, over rows derived from pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as K
from ..sources import responses as S
from ..sources.anchors import with_hrefs
from ..sources.tables import shared_path
from ..storage import Stash
from .registry import query, rows, table
from .url_queries import _BARE, _K2

_HOST_SQL = _BARE.format("url")
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
#: Addresses without fragment, made the page's own by its number: an address gives one answer.
_PLAIN = "regexp_replace(url, '#.*$', '') || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN '&' ELSE '?' END || 'p=' || page_id"


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """A folder of recorded responses: every third page behind a redirect, every seventh behind two, every eleventh in a loop, every thirteenth not there."""
    plain_url = F.regexp_replace("url", "#.*", "")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(plain_url, F.when(plain_url.contains("?"), "&").otherwise("?"), F.lit("p="), F.col("page_id").cast("string")).alias("url"), U.bare_host(F.col("url")).alias("site"), F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("root"), "html")
    n = F.col("page_id").cast("string")
    hop, far, loop, gone = (F.concat("root", F.lit(f"/{k}/"), n) for k in ("hop", "far", "loop", "gone"))
    i = F.col("page_id")
    asked = p.select("site", i.alias("ord"), F.when(i % 13 == 0, gone).when(i % 11 == 0, loop).when(i % 7 == 0, far).when(i % 3 == 0, hop).otherwise(F.col("url")).alias("url"))
    moved = lambda to: F.create_map(F.lit("Location"), to)
    plain = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))
    answer = lambda df, url, status, headers, body: df.select("site", url.alias("url"), F.lit(status).alias("status"), headers.alias("headers"), body.alias("body"))
    none = F.lit(None).cast("string")
    answers = answer(p, F.col("url"), 200, plain, F.col("html")).unionByName(answer(p.where(i % 3 == 0), hop, 301, moved(F.col("url")), none))
    answers = answers.unionByName(answer(p.where(i % 7 == 0), far, 302, moved(F.concat(F.lit("/hop2/"), n)), none)).unionByName(answer(p.where(i % 7 == 0), F.concat("root", F.lit("/hop2/"), n), 308, moved(F.col("url")), none))
    path = shared_path(spark, "responses")
    S.record(asked, answers.unionByName(answer(p.where(i % 11 == 0), loop, 307, moved(loop), none)), path)
    return path


_CAP = 3000


@query(f"""
WITH p AS (SELECT page_id, {_HOST_SQL} AS site, {_PLAIN} AS url, {_ROOT} AS root, html, CASE WHEN page_id % 13 = 0 THEN 'gone' WHEN page_id % 11 = 0 THEN 'loop' WHEN page_id % 7 = 0 THEN 'far' WHEN page_id % 3 = 0 THEN 'hop' ELSE 'own' END AS way FROM pages)
SELECT site, page_id AS ord, CASE WHEN way = 'own' THEN url ELSE root || '/' || way || '/' || page_id END AS url, CASE WHEN way IN ('gone', 'loop') THEN root || '/' || way || '/' || page_id ELSE url END AS final_url,
  CASE way WHEN 'loop' THEN 6 WHEN 'far' THEN 2 WHEN 'hop' THEN 1 ELSE 0 END AS hops, CASE WHEN way NOT IN ('gone', 'loop') THEN 200 END AS status, CASE WHEN way NOT IN ('gone', 'loop') THEN strlen(html) > {_CAP} END AS truncated,
  CASE WHEN way NOT IN ('gone', 'loop') THEN md5(substr(html, 1, {_CAP // 4})) END AS start_md5, CASE WHEN way NOT IN ('gone', 'loop') AND strlen(html) <= {_CAP} THEN md5(html) END AS whole_md5,
  CASE way WHEN 'gone' THEN 'no answer' WHEN 'loop' THEN 'too many redirects (more than 5)' END AS error FROM p""")
def page_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the response source, redirects followed and bodies capped."""
    r = S.responses(spark, _archive(spark, sf_dir), most_bytes=_CAP)
    md5 = lambda c: F.md5(c.cast("binary"))
    return r.select("site", "ord", "url", "final_url", "hops", "status", "truncated", md5(F.substring("body", 1, _CAP // 4)).alias("start_md5"), F.when(~F.col("truncated"), md5(F.col("body"))).alias("whole_md5"), "error")


@query(f"""
WITH p AS (SELECT page_id, {_HOST_SQL} AS site, page_id = min(page_id) OVER (PARTITION BY {_HOST_SQL}) AS is_home FROM pages),
r AS (SELECT *, CASE WHEN is_home AND page_id % 5 = 4 THEN 503 WHEN is_home OR page_id % 4 < 2 THEN 200 WHEN page_id % 4 = 2 THEN 404 ELSE 302 END AS status FROM p),
o AS (SELECT site, bool_or(is_home AND status = 200) AS open, min(page_id) AS home FROM r GROUP BY site)
SELECT site, CASE WHEN open THEN count(*) FILTER (status = 200 AND (is_home OR page_id % 4 = 0)) ELSE 0 END AS n_pages, CASE WHEN open THEN count(*) FILTER (NOT is_home AND status = 404) ELSE 0 END AS n_broken,
  CASE WHEN open THEN count(*) FILTER (NOT is_home AND (status = 302 OR page_id % 4 = 1)) ELSE 1 END AS n_unread, open AND home % 2 = 0 AS has_robots, open AND home % 3 = 0 AS has_sitemap, CASE WHEN open THEN CASE WHEN home % 2 = 1 THEN 404 END END AS missing_status
FROM r JOIN o USING (site) GROUP BY site, open, home""")
def snapshot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of sites put together from responses: pages, files, broken and unread links, homepages that cannot be audited."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.bare_host(F.col("url")).alias("site"), "html")
    first = p.groupBy("site").agg(F.min("page_id").alias("home"))
    i, home = F.col("page_id"), F.col("home")
    own = p.join(first, "site").withColumn("is_home", i == home)
    status = F.when(F.col("is_home"), F.when(i % 5 == 4, 503).otherwise(200)).when(i % 4 < 2, 200).when(i % 4 == 2, 404).otherwise(302)
    kind = F.when(F.col("is_home"), "home").otherwise("inner")
    content = F.when(F.col("is_home") | (i % 4 != 1), "text/html").otherwise("application/pdf")
    none = F.lit(None).cast("string")
    shape = lambda df, ord_, kind, url, status, content, body: df.select("site", ord_.alias("ord"), kind.alias("kind"), url.alias("url"), url.alias("final_url"), status.alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), content.alias("content_type"), body.alias("body"), F.lit(False).alias("truncated"), none.alias("error"))
    site_url = lambda path: F.concat(F.lit("https://"), "site", F.lit(path))
    zero, ok, text = F.lit(0).cast("long"), F.lit(200), F.lit("text/plain")
    found = shape(own, i, kind, F.col("url"), status, content, F.col("html"))
    found = found.unionByName(shape(first, zero, F.lit("robots"), site_url("/robots.txt"), ok, text, F.when(home % 2 == 0, "User-agent: *").otherwise("<html>not here")))
    found = found.unionByName(shape(first, zero, F.lit("sitemap"), site_url("/sitemap.xml"), ok, text, F.when(home % 3 == 0, "<urlset ></urlset>").otherwise("nothing")))
    found = found.unionByName(shape(first.where(home % 2 == 1), zero, F.lit("probe-missing"), site_url("/no-such-page"), F.lit(404), text, none))
    pages, meta, broken, unread = S.snapshot(found)
    count = lambda df, name: df.groupBy("site").agg(F.count("*").alias(name))
    out = first.select("site").join(count(pages, "n_pages"), "site", "left").join(count(broken, "n_broken"), "site", "left").join(count(unread, "n_unread"), "site", "left").join(meta, "site", "left")
    return out.select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pages", "n_broken", "n_unread")], F.col("robots_txt").isNotNull().alias("has_robots"), F.col("sitemap_xml").isNotNull().alias("has_sitemap"), F.col("probes.not_found.status").alias("missing_status"))


#: References in the forms that markup has, a % for the page's number.
_FORMS = ["../up%?x=1#f", "./here%", "?q=%", "#part%", "//CDN.Example.org:443/a/../b%", "/a/./b/../c%/", "deep/er/../x%", "../../../../top%", "HTTP://Other.test:80", "", "mailto:a%@b.c", "/%2e%2E/z%", "  /sp ace%  ", "http://u:p@h.test/q%?", "/a//..//b%", "ftp://h.test/%", "/x%/..", "javascript:void(0)", "http://h.test:8080/.?%#"]
_REFS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages UNION ALL SELECT page_id, url, replace(f, '%', CASE WHEN f LIKE '/\\%2e%' ESCAPE '\\' THEN '%' ELSE CAST(page_id AS VARCHAR) END) FROM pages, (SELECT unnest([" + ", ".join(f"'{f}'" for f in _FORMS) + "]) AS f))"


@query(rf"""
WITH r AS (SELECT DISTINCT page_id, url, href, regexp_replace(trim(href), '#.*$', '') AS r, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS bs, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS ba, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS bp, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS bq FROM {_REFS}),
f AS (SELECT *, CASE WHEN regexp_matches(r, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN regexp_matches(r, '(?i)^https?://') THEN r END WHEN starts_with(r, '//') THEN bs || ':' || r WHEN starts_with(r, '/') THEN bs || '://' || ba || r WHEN r = '' THEN bs || '://' || ba || bp || bq
  WHEN starts_with(r, '?') THEN bs || '://' || ba || bp || r ELSE bs || '://' || ba || regexp_replace(bp, '[^/]*$', '') || r END AS joined FROM r),
p AS (SELECT page_id, href, joined, lower(regexp_extract(joined, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(joined, '^[a-zA-Z]+://(?:[^/?@]*@)?([^/?:]*)', 1)) AS h, regexp_extract(joined, '^[a-zA-Z]+://(?:[^/?@]*@)?[^/?:]*:([0-9]+)', 1) AS port,
  replace(replace(coalesce(nullif(regexp_extract(joined, '^[a-zA-Z]+://[^/?]*(/[^?]*)', 1), ''), '/'), '%2e', '.'), '%2E', '.') AS path, regexp_extract(joined, '(\?.*)$', 1) AS q FROM f),
d AS (SELECT *, list_reduce(string_split(substr(path, 2), '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END, '') AS kept, string_split(path, '/')[-1] AS last FROM p)
SELECT page_id, href, CASE WHEN joined IS NOT NULL THEN s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || kept || CASE WHEN last IN ('.', '..') OR kept = '' THEN '/' ELSE '' END || CASE WHEN q = '?' THEN '' ELSE q END END AS target FROM d""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of every page and a set of forms made with its number, resolved against the page's address."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    forms = F.array(*[F.lit(f) if f.startswith("/%2e") and f.count("%") < 3 else F.replace(F.lit(f), F.lit("%"), n) if not f.startswith("/%2e") else F.lit(f) for f in _FORMS])
    own = with_hrefs(p.select("page_id", "url", "html")).select("page_id", "url", F.explode("hrefs").alias("href"))
    every = own.unionByName(p.select("page_id", "url", F.explode(forms).alias("href"))).distinct()
    return every.select("page_id", "href", U.resolve(F.col("href"), F.col("url")).alias("target"))


_ADDRESS = """(SELECT event_id, CASE event_id % 12 WHEN 0 THEN '2001:db8::' || a || ':' || b WHEN 1 THEN 'fe80::' || b || '%eth0' WHEN 2 THEN '::ffff:10.' || x || '.' || y || '.7' WHEN 3 THEN '64:FF9B::8.8.' || x || '.' || y WHEN 4 THEN '2a00:1450:4001:81b:0:0:' || a || ':' || b
  WHEN 5 THEN 'FC00:' || a || '::' || b WHEN 6 THEN '::' || (event_id % 5) WHEN 7 THEN 'ff02::fb' WHEN 8 THEN x || '.0.' || y || '.1' WHEN 9 THEN '1::2::' || a WHEN 10 THEN '2a00::' || a || ':' || b || ':12345' ELSE '::ffff:8.' || x || '.8.' || y END AS ip
  FROM (SELECT event_id, {hex}(user_id % 65536) AS a, {hex}(event_id % 65536) AS b, CAST(event_id % 256 AS {text}) AS x, CAST(user_id % 256 AS {text}) AS y FROM {events}))"""
_ADDRESS_SQL = _ADDRESS.format(hex="hex", text="VARCHAR", events="events")
_RANGES = ", ".join(f"('{n}', '{lo}', '{hi}')" for n, lo, hi in U.address_ranges())


@query(rf"""
WITH a AS (SELECT event_id, lower(split_part(ip, '%', 1)) AS ip FROM {_ADDRESS_SQL}),
v4 AS (SELECT event_id, ip, CASE WHEN contains(ip, '.') THEN list_transform(string_split(regexp_extract(ip, '([0-9.]+)$', 1), '.'), lambda x: CAST(x AS INT)) END AS o FROM a),
t AS (SELECT event_id, CASE WHEN o IS NULL THEN ip WHEN contains(ip, ':') THEN regexp_replace(ip, '[0-9.]+$', '') || lower(to_hex(o[1] * 256 + o[2])) || ':' || lower(to_hex(o[3] * 256 + o[4])) ELSE '::ffff:' || lower(to_hex(o[1] * 256 + o[2])) || ':' || lower(to_hex(o[3] * 256 + o[4])) END AS t FROM v4),
g AS (SELECT event_id, t, len(string_split(t, '::')) AS parts, list_filter(string_split(split_part(t, '::', 1), ':'), lambda x: x <> '') AS l, list_filter(string_split(split_part(t, '::', 2), ':'), lambda x: x <> '') AS r FROM t),
h AS (SELECT event_id, CASE WHEN parts <= 2 AND (parts = 2 AND len(l) + len(r) < 8 OR parts = 1 AND len(l) = 8) AND len(list_filter(list_concat(l, r), lambda x: length(x) > 4)) = 0
  THEN array_to_string(list_transform(l, lambda x: lpad(x, 4, '0')), '') || repeat('0000', 8 - len(l) - len(r)) || array_to_string(list_transform(r, lambda x: lpad(x, 4, '0')), '') END AS h FROM g),
b AS (SELECT * FROM (VALUES {_RANGES}) v(net, lo, hi)), j AS (SELECT event_id, h, coalesce(net, CASE WHEN h IS NULL THEN 'unreadable' ELSE 'public' END) AS net FROM h LEFT JOIN b ON h BETWEEN lo AND hi)
SELECT net, count(*) AS addresses, min(event_id) AS first_event, max(h) AS last_address FROM j GROUP BY net""")
def blocked_ipv6_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4, IPv6 and mapped addresses against 20 blocked ranges: a join on 128-bit intervals with a fixed small side."""
    a = spark.sql("SELECT event_id, ip FROM " + _ADDRESS.format(hex="hex", text="STRING", events="{events}"), events=table(spark, sf_dir, "events"))
    nets = F.broadcast(rows(spark, f"SELECT * FROM (VALUES {_RANGES}) AS v(net, lo, hi)"))
    h = a.select("event_id", "ip", U.address_hex(F.col("ip")).alias("h"))
    j = h.join(nets, F.col("h").between(F.col("lo"), F.col("hi")), "left").withColumn("net", F.coalesce("net", F.when(F.col("h").isNull(), "unreadable").otherwise("public")))
    return j.groupBy("net").agg(F.count("*").alias("addresses"), F.min("event_id").alias("first_event"), F.max("h").alias("last_address"))


_LIMIT, _DEPTH = 12, 4
#: A page links, beside its own anchors, to four others of its host by their ranks: two ahead, one near, one anywhere (which makes rings).
_RANKED = f"(SELECT page_id, url, html, {_HOST_SQL} AS site, {_K2.format('url')} AS key, row_number() OVER (PARTITION BY {_HOST_SQL} ORDER BY page_id) - 1 AS r, count(*) OVER (PARTITION BY {_HOST_SQL}) AS n FROM pages)"
_GRAPH = f"""ranked AS (SELECT * FROM {_RANKED}),
anchors AS (SELECT site, key, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM ranked),
made AS (SELECT a.site, a.key AS src, b.key AS dst, b.url, p.pos FROM ranked a, (VALUES (1000), (1001), (1002), (1003)) p(pos) JOIN ranked b ON b.site = a.site AND b.r = CASE p.pos WHEN 1000 THEN 2 * a.r + 1 WHEN 1001 THEN 2 * a.r + 2 WHEN 1002 THEN a.r + 3 ELSE (a.r * a.r + 1) % a.n END),
edges AS (SELECT site, src, dst, min(pos) AS pos FROM (SELECT site, key AS src, site || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END AS dst, pos FROM anchors WHERE NOT regexp_matches(href, '(?i){U.ASSET}') UNION ALL SELECT site, src, dst, pos FROM made) WHERE src <> dst GROUP BY site, src, dst),
v0 AS (SELECT site, key, 0 AS depth, 1 AS place FROM ranked WHERE r = 0)"""
for _d in range(1, _DEPTH + 1):
    _seen = " UNION ALL ".join(f"SELECT site, key, place FROM v{_k}" for _k in range(_d))
    _GRAPH += f""",
c{_d} AS (SELECT e.site, e.dst AS key, min(f.place * 100000 + e.pos) AS o FROM v{_d - 1} f JOIN edges e ON e.site = f.site AND e.src = f.key WHERE NOT EXISTS (SELECT 1 FROM ({_seen}) s WHERE s.site = e.site AND s.key = e.dst) GROUP BY e.site, e.dst),
v{_d} AS (SELECT site, key, {_d} AS depth, place FROM (SELECT c.site, c.key, m.had + row_number() OVER (PARTITION BY c.site ORDER BY o, c.key) AS place FROM c{_d} c JOIN (SELECT site, max(place) AS had FROM ({_seen}) GROUP BY site) m USING (site)) WHERE place <= {_LIMIT})"""
_CRAWLED = " UNION ALL ".join(f"SELECT site, key, depth, place FROM v{_k}" for _k in range(_DEPTH + 1))


@query(f"WITH {_GRAPH} SELECT site, key, CAST(depth AS INT) AS depth, CAST(place AS BIGINT) AS place FROM ({_CRAWLED})")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of each site in crawl order from its first page on, a quota a site, four levels deep."""
    from pyspark.sql import Window

    stash, own = Stash(spark), Window.partitionBy("site")
    p = with_hrefs(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # Markup is read once, and anchors stay out of the windows: a site may have a third of all pages.
    p = stash.put(p.select("page_id", U.bare_host(F.col("url")).alias("site"), "url", U.crawl_key(F.col("url")).alias("key"), "hrefs"))
    # Long: from 46,342 pages of a site on, a rank's square is more than an integer holds.
    ranked = p.drop("hrefs").withColumn("r", F.row_number().over(own.orderBy("page_id")).cast("long") - 1).withColumn("n", F.count("*").over(own))
    to = F.array(*[F.struct(F.lit(pos).alias("pos"), r.alias("to")) for pos, r in ((1000, 2 * F.col("r") + 1), (1001, 2 * F.col("r") + 2), (1002, F.col("r") + 3), (1003, (F.col("r") * F.col("r") + 1) % F.col("n")))])
    made = ranked.select("site", F.col("key").alias("src"), F.inline(to)).join(ranked.select("site", F.col("r").alias("to"), F.col("key").alias("dst"), "url"), ["site", "to"])
    edges = K.link_graph(p).unionByName(made.where("src <> dst").select("site", "src", "dst", "url", F.col("pos").cast("long").alias("pos")))
    edges = edges.groupBy("site", "src", "dst").agg(F.min(F.struct("pos", "url")).alias("f")).select("site", "src", "dst", "f.url", "f.pos")
    seeds = ranked.where("r = 0").select("site", "key", "url", F.lit(0).cast("long").alias("ord"))
    crawled = K.crawl(seeds, edges, _LIMIT, _DEPTH).select("site", "key", "depth", "place")
    stash.drop(p)
    return crawled


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST_SQL} AS site FROM pages), s AS (SELECT site, min(page_id) AS home, count(*) AS n FROM p GROUP BY site)
SELECT site, CASE WHEN home % 2 = 0 THEN 1 ELSE (SELECT count(*) FROM range(0, least(n, 5)) x(i) WHERE i % 3 <> 2) * 2 END AS n_locs, CASE WHEN home % 2 = 1 THEN n + 1 END AS listed, CASE WHEN home % 2 = 1 THEN (SELECT count(*) FROM range(0, least(n, 5)) x(i) WHERE i % 3 <> 2) END AS read,
  home % 2 = 0 AS whole FROM s""")
def sitemap_index_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap indexes with as many children as the site has pages and a foreign one; every third child cannot be read."""
    p = table(spark, sf_dir, "pages").select("page_id", U.bare_host(F.col("url")).alias("site"))
    s = p.groupBy("site").agg(F.min("page_id").alias("home"), F.count("*").alias("n"))
    loc = lambda x: F.concat(F.lit("<loc>https://"), "site", F.lit("/s"), x.cast("string"), F.lit(".xml</loc>"))
    children = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), loc), "")
    index = F.concat(F.lit("<sitemapindex><loc>https://elsewhere.test/x.xml</loc>"), children, F.lit("</sitemapindex>"))
    maps = s.select("site", F.when(F.col("home") % 2 == 1, index).otherwise(F.concat(F.lit("<urlset><loc>https://"), "site", F.lit("/a&amp;b</loc></urlset>"))).alias("xml"))
    i = F.col("i")
    own = s.select("site", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    two = F.concat(*[x for k in ("a", "b") for x in (F.lit("<loc>https://"), F.col("site"), F.lit(f"/{k}"), i.cast("string"), F.lit("</loc>"))])
    got = own.select("site", F.concat(F.lit("https://"), "site", F.lit("/s"), i.cast("string"), F.lit(".xml")).alias("url"), F.when(i % 3 == 2, 404).otherwise(200).alias("status"), F.concat(F.lit("<urlset>"), two, F.lit("</urlset>")).alias("xml"))
    return K.expanded(maps, got).select("site", F.size("locs").cast("long").alias("n_locs"), "listed", "read", "whole")
