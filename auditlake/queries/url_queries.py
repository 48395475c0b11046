"""URL identities, domains, validation and link-graph joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import links as L
from .registry import per_page, query, rows, table

_SCHEME = r"regexp_extract(trim({0}), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)"
_HOST = r"lower(regexp_extract(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
_PATH = r"regexp_extract(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(trim({0}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*([?][^#]*)', 1)"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_TRIM = f"regexp_replace({_PATH}, '/+$', '')"
_K1 = f"CASE WHEN {_HOST} <> '' THEN {_BARE} || {_TRIM} END"
_K2 = f"CASE WHEN {_HOST} <> '' THEN {_BARE} || CASE WHEN {_TRIM} = '' THEN '/' ELSE {_TRIM} END END"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _registrable(h: str) -> str:
    s = f"string_split(regexp_replace(lower({h}), '\\.$', ''), '.')"
    return f"CASE WHEN len({s}) <= 2 THEN array_to_string({s}, '.') WHEN array_to_string({s}[-2:], '.') IN ({_in(U.TWO_LABEL_SUFFIXES)}) THEN array_to_string({s}[-3:], '.') ELSE array_to_string({s}[-2:], '.') END"


_ODD = r"""(VALUES (1, 'https://WWW.Shop.test/a/b//?q=1#x'), (2, 'http://shop.test'), (3, 'shop.test/a'), (4, 'https://u:p@a.b.co.uk:8080/x?'), (5, '  https://x.com.au/  '), (6, 'mailto:a@b.c'))"""


@query(f"""
WITH t AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT -id, url FROM {_ODD} v(id, url))
SELECT CAST(id AS BIGINT) AS id, {_K1.format('url')} AS k1, {_K2.format('url')} AS k2,
  ({_K2.format('url')}) || CASE WHEN {_QUERY.format('url')} = '?' THEN '' ELSE {_QUERY.format('url')} END AS k3, coalesce({_K1.format('url')}, url) AS k4 FROM t""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(rows(spark, f"SELECT CAST(-id AS BIGINT) AS id, url FROM {_ODD} AS v(id, url)", sf_dir))
    u = F.col("url")
    return t.select("id", U.page_key(u).alias("k1"), U.crawl_key(u).alias("k2"), U.sitemap_key(u).alias("k3"), U.table_key(u).alias("k4"))


@query(f"SELECT domain, count(*) AS n_pages FROM (SELECT {_registrable(_HOST.format('url'))} AS domain FROM pages UNION ALL SELECT {_registrable(_HOST.format('url'))} FROM {_ODD} v(id, url)) GROUP BY domain")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("url").unionByName(rows(spark, f"SELECT url FROM {_ODD} AS v(id, url)", sf_dir))
    return t.groupBy(U.registrable(U.host(F.col("url"))).alias("domain")).agg(F.count("*").alias("n_pages"))


_TARGETS = per_page(r"""(VALUES (1, 'example.com'), (2, ''), (3, 'ftp://example.com'), (4, 'https://u:p@example.com'), (5, 'https://example.com:8443/x'), (6, 'http://10.0.0.1/'), (7, 'localhost'), (8, 'https://intranet.local'), (9, 'https://shop.example.com:443/a'), (10, 'http://[::1]/'), (11, 'ex ample.com'))""", "id, u", u=('example.com', 'p{n}.example.com'))


@query(rf"""
WITH t AS (SELECT id, trim(u) AS t, CASE WHEN regexp_matches(trim(u), '(?i)^[a-z][a-z0-9+.-]*://') THEN trim(u) ELSE 'https://' || trim(u) END AS f FROM {_TARGETS} v(id, u)),
p AS (SELECT *, {_HOST.format('f')} AS h, regexp_extract(f, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*:([0-9]*)', 1) AS port, lower({_SCHEME.format('f')}) AS s FROM t)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 2048 THEN 'too long' WHEN h = '' OR regexp_matches(h, '[^a-z0-9.\-\[\]_]') OR contains(h, '..') THEN 'not an address'
  WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches(f, '^[^/]*//[^/?#]*@') THEN 'credentials' WHEN port NOT IN ('', '80', '443') THEN 'port'
  WHEN regexp_matches(h, '^[0-9.]+$') OR starts_with(h, '[') THEN 'ip address' WHEN NOT contains(h, '.') OR h = 'localhost' OR h LIKE '%.local' OR h LIKE '%.internal' THEN 'not public' END AS error FROM p""")
def target_url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, f"SELECT CAST(id AS BIGINT) AS id, u FROM {_TARGETS} AS v(id, u)", sf_dir).select("id", U.target_error(F.col("u")).alias("error"))


_NETS = ", ".join("('{}/{}', {}, {})".format(n, b, *U.network_range(n, b)) for n, b in U.BLOCKED_NETWORKS)


@query(f"""
WITH a AS (SELECT DISTINCT CAST(o_custkey % 256 AS VARCHAR) || '.' || CAST(o_orderkey % 256 AS VARCHAR) || '.' || CAST(o_custkey % 7 AS VARCHAR) || '.1' AS ip, (o_custkey % 256) * 16777216 + (o_orderkey % 256) * 65536 + (o_custkey % 7) * 256 + 1 AS n FROM orders),
b AS (SELECT * FROM (VALUES {_NETS}) v(net, lo, hi))
SELECT net, count(*) AS addresses FROM a JOIN b ON n BETWEEN lo AND hi GROUP BY net""")
def blocked_address_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in blocked networks: a range join with 14 broadcast rows."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws(".", (F.col("o_custkey") % 256).cast("string"), (F.col("o_orderkey") % 256).cast("string"), (F.col("o_custkey") % 7).cast("string"), F.lit("1")).alias("ip")).distinct()
    nets = rows(spark, f"SELECT net, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (VALUES {_NETS}) AS v(net, lo, hi)", sf_dir)
    n = o.withColumn("n", U.ipv4_number(F.col("ip")))
    return n.join(F.broadcast(nets), (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi"))).groupBy("net").agg(F.count("*").alias("addresses"))


_LINKS = r"""(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""
_ABSOLUTE = rf"CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN href WHEN starts_with(href, '/') THEN lower({_SCHEME.format('url')}) || '://' || {_HOST.format('url')} || href END"


@query(f"""
WITH l AS (SELECT page_id, url, {_ABSOLUTE} AS target FROM {_LINKS})
SELECT page_id, count(DISTINCT {_TRIM.format('target')}) AS n_paths FROM l
WHERE {_BARE.format('target')} = {_BARE.format('url')} AND {_TRIM.format('target')} <> {_TRIM.format('url')} GROUP BY page_id""")
def internal_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.internal_paths(L.links(table(spark, sf_dir, "pages")))


@query(f"""
WITH l AS (SELECT url, {_ABSOLUTE} AS target FROM {_LINKS}), d AS (SELECT {_registrable(_HOST.format('url'))} AS own, {_registrable(_HOST.format('target'))} AS other FROM l)
SELECT own, count(*) AS n_links, count(DISTINCT CASE WHEN other <> own AND other <> '' AND other NOT IN ({_in(U.NOT_EXTERNAL)}) THEN other END) AS n_external FROM d GROUP BY own""")
def external_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.external_domains(L.links(table(spark, sf_dir, "pages")))


_SITE = _BARE.format("url")
_MAP = f"""(SELECT {_SITE} AS site, url AS loc FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT {_SITE}, 'https://' || {_SITE} || '/lost/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT {_SITE}, 'https://elsewhere.test/' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 7 = 0)"""


def _sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page as the sitemap, pages that nothing links to, and addresses of another host."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.bare_host(F.col("url")).alias("site"))
    n = F.col("page_id").cast("string")
    own = p.where("page_id % 3 = 0").select("site", F.col("url").alias("loc"))
    lost = p.where("page_id % 5 = 0").select("site", F.concat(F.lit("https://"), "site", F.lit("/lost/"), n).alias("loc"))
    return own.unionByName(lost).unionByName(p.where("page_id % 7 = 0").select("site", F.concat(F.lit("https://elsewhere.test/"), n).alias("loc")))


@query(f"""
WITH m AS {_MAP}, k AS (SELECT site, loc, {_K2.format('loc')} AS k FROM m),
linked AS (SELECT DISTINCT {_SITE} AS site, {_K2.format('target')} AS k FROM (SELECT url, {_ABSOLUTE} AS target FROM {_LINKS})),
read AS (SELECT DISTINCT {_SITE} AS site, {_K2.format('url')} AS k FROM pages WHERE page_id % 2 = 0)
SELECT site, count(*) AS n_orphans, min(loc) AS first_orphan FROM k
WHERE string_split(k, '/')[1] = site AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.site = k.site AND l.k = k.k) AND NOT EXISTS (SELECT 1 FROM read r WHERE r.site = k.site AND r.k = k.k) GROUP BY site""")
def orphan_pages_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    read = pages.where("page_id % 2 = 0").select(U.bare_host(F.col("url")).alias("site"), "url")
    return L.orphans(_sitemap(spark, sf_dir), L.links(pages), read).groupBy("site").agg(F.count("*").alias("n_orphans"), F.min("loc").alias("first_orphan"))


@query(f"""
WITH m AS {_MAP}, k AS (SELECT site, loc, ({_K2.format('loc')}) || {_QUERY.format('loc')} AS k FROM m WHERE NOT regexp_matches({_PATH.format('loc')}, '(?i){U.ASSET}')),
d AS (SELECT site, k, min(loc) AS loc FROM k WHERE string_split(k, '/')[1] = site GROUP BY site, k),
read AS (SELECT DISTINCT {_SITE} AS site, ({_K2.format('url')}) || {_QUERY.format('url')} AS k FROM pages WHERE page_id % 2 = 0)
SELECT site, count(*) AS n_unread FROM d WHERE NOT EXISTS (SELECT 1 FROM read r WHERE r.site = d.site AND r.k = d.k) GROUP BY site""")
def sitemap_unread_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(U.bare_host(F.col("url")).alias("site"), "url")
    return L.unread(_sitemap(spark, sf_dir), read).groupBy("site").agg(F.count("*").alias("n_unread"))


@query(f"""
WITH t AS (SELECT page_id, {_SITE} AS site, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages),
j AS (SELECT a.page_id, a.site, a.title, min(b.page_id) AS twin FROM t a JOIN t b ON a.site = b.site AND lower(a.title) = lower(b.title) AND a.url <> b.url WHERE a.title <> '' GROUP BY ALL)
SELECT page_id, site, twin FROM j""")
def duplicate_titles_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first twin by title. Titles are grouped first: a page needs only the two least pages of its title with different addresses."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"\s+", " "))
    return L.twins(table(spark, sf_dir, "pages").select("page_id", U.bare_host(F.col("url")).alias("site"), "url", title.alias("value")))


_HREFS = per_page(r"""(VALUES (1, 'https://www.facebook.com/acme'), (2, 'https://facebook.com/'), (3, 'https://m.facebook.com/sharer/x'), (4, 'https://linkedin.com/company/acme/about'), (5, 'https://youtube.com/@acme'), (6, 'https://youtube.com/channel/UC1'),
  (7, 'https://youtube.com/watch?v=1'), (8, 'https://www.facebook.com/profile.php?id=77'), (9, 'https://tiktok.com/acme'), (10, 'https://tiktok.com/@acme'), (11, 'https://notfacebook.com/acme'), (12, 'https://x.com/acme'), (13, 'ftp://x.com/acme'), (14, 'https://linkedin.com/jobs/1'))""", "id, u", u=('acme', 'acme{n}'))
_PLATFORM = "CASE " + " ".join(f"WHEN h = '{d}' OR h LIKE '%.{d}' THEN '{p}|{c}'" for d, p, c in U.PLATFORM_HOSTS) + " END"


@query(f"""
WITH t AS (SELECT id, u, {_HOST.format('u')} AS h, list_filter(string_split({_PATH.format('u')}, '/'), lambda x: x <> '') AS s FROM {_HREFS} v(id, u) WHERE lower({_SCHEME.format('u')}) IN ('http', 'https')),
p AS (SELECT *, split_part({_PLATFORM}, '|', 1) AS platform, split_part({_PLATFORM}, '|', 2) AS c FROM t WHERE {_PLATFORM} IS NOT NULL),
g AS (SELECT *, CASE WHEN len(s) = 0 THEN NULL WHEN lower(s[1]) IN ({_in(U.RESERVED_PATHS)}) THEN NULL
  WHEN platform = 'linkedin' THEN CASE WHEN s[1] IN ('company', 'in', 'school') AND len(s) > 1 THEN s[1] || '/' || s[2] END
  WHEN platform = 'youtube' THEN CASE WHEN starts_with(s[1], '@') THEN s[1] WHEN s[1] IN ('channel', 'c', 'user') AND len(s) > 1 THEN s[1] || '/' || s[2] END
  WHEN platform = 'facebook' AND s[1] = 'profile.php' THEN 'profile.php?id=' || nullif(regexp_extract(u, '[?&]id=([^&]+)', 1), '')
  WHEN platform = 'facebook' AND s[1] IN ('pages', 'people', 'groups') AND len(s) > 1 THEN s[1] || '/' || s[2]
  WHEN platform = 'tiktok' THEN CASE WHEN starts_with(s[1], '@') THEN s[1] END ELSE s[1] END AS handle FROM p)
SELECT CAST(id AS BIGINT) AS id, platform, 'https://' || c || '/' || coalesce(handle, '') AS url, handle, CASE WHEN handle IS NULL THEN 'homepage' ELSE 'profile' END AS kind FROM g WHERE handle IS NOT NULL OR len(s) = 0""")
def social_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, f"SELECT CAST(id AS BIGINT) AS id, u FROM {_HREFS} AS v(id, u)", sf_dir).select("id", U.social_profile(F.col("u")).alias("p"))
    return t.where("p is not null").select("id", "p.platform", "p.url", "p.handle", "p.kind")


@query(f"""
WITH h AS (SELECT CAST(id AS BIGINT) AS id, {_HOST.format('u')} AS h FROM {_HREFS} v(id, u)), d AS (SELECT * FROM (VALUES {', '.join(f"('{d}', '{p}')" for d, p, _ in U.PLATFORM_HOSTS)}) v(domain, platform))
SELECT id, domain, platform FROM h JOIN d ON h = domain OR h LIKE '%.' || domain""")
def platform_suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host against listed domains: an equi-join on the host's own suffixes, not a theta join."""
    h = rows(spark, f"SELECT CAST(id AS BIGINT) AS id, u FROM {_HREFS} AS v(id, u)", sf_dir).select("id", U.host(F.col("u")).alias("h"))
    d = rows(spark, f"SELECT * FROM (VALUES {', '.join(f"('{d}', '{p}')" for d, p, _ in U.PLATFORM_HOSTS)}) AS v(domain, platform)", sf_dir)
    return L.by_suffix(h, "h", d).select("id", "domain", "platform")


_RAW = per_page(r"""(VALUES (1, 'https://www.Rival.com.au/x'), (2, 'shop.own.com'), (3, 'facebook.com'), (4, 'bad domain'), (5, 'rival.de'), (6, 'localhost'), (7, 'a.amazon.com'))""", "id, r", r=('rival.de', 'rival{n}.de'))


@query(rf"""
WITH d AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(trim(r)), '^https?://', ''), '[/?#].*$', ''), '^www\.', '') AS d FROM {_RAW} v(id, r)),
g AS (SELECT id, CASE WHEN regexp_matches(d, '^[a-z0-9-]+(\.[a-z0-9-]+)+$') AND {_registrable('d')} <> 'own.com' AND NOT ({' OR '.join(f"d = '{x}' OR d LIKE '%.{x}'" for x in U.NOT_COMPETITORS)}) THEN d END AS domain FROM d)
SELECT CAST(id AS BIGINT) AS id, domain, CASE string_split(domain, '.')[-1] {' '.join(f"WHEN '{t}' THEN '{n}'" for t, n in U.MARKETS.items())} END AS market FROM g""")
def competitor_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, f"SELECT CAST(id AS BIGINT) AS id, r FROM {_RAW} AS v(id, r)", sf_dir).select("id", U.clean_domain(F.col("r"), F.lit("own.com")).alias("domain"))
    return t.select("id", "domain", U.market(F.col("domain")).alias("market"))
