"""Rules over the pages table and over inline sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import links
from ..operators import pages as P
from ..plans import engine
from ..sources import robots
from ..sources.html import parsed
from .registry import per_page, query, rows, table

_SITE = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)', 1)), '^www\.', '')"
_BODY = r"regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<script>.*?</script>', '', 'g')"


def _unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_PLAIN = _unescape(f"regexp_replace(regexp_replace({_BODY}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")
_TITLE = _unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")


def _n_words(x: str) -> str:
    return rf"CAST(len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')) AS BIGINT)"


@query(f"SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1, {_n_words(_PLAIN)} AS words FROM pages")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(table(spark, sf_dir, "pages")).select("page_id", "dom")
    return p.select("page_id", F.col("dom.title_line").alias("title"), F.col("dom.h1").cast("long").alias("h1"), T.word_count(F.col("dom.text")).alias("words"))


@query(f"""
SELECT page_id, {_n_words(_PLAIN)} AS plain, {_n_words(_unescape(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"))} AS main FROM pages""")
def page_words_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(table(spark, sf_dir, "pages")).select("page_id", "dom")
    return p.select("page_id", T.word_count(F.col("dom.text")).alias("plain"), T.word_count(F.col("dom.main_text")).alias("main"))


@query(f"""
WITH f AS (SELECT page_id, url, {_SITE} AS site, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<h1[ >]')) AS h1, {_n_words(_PLAIN)} AS words FROM pages),
h AS (SELECT site, min(page_id) AS home FROM f GROUP BY site),
g AS (SELECT f.*, page_id = home AS is_home, (SELECT count(DISTINCT url) FROM f t WHERE t.site = f.site AND lower(t.title) = lower(f.title)) AS same FROM f JOIN h USING (site)),
s AS (SELECT site, bool_and(title = '' OR length(title) BETWEEN 15 AND 60) FILTER (is_home) AS a, bool_and(h1 = 1) FILTER (is_home) AS b, bool_and(words >= 150) FILTER (is_home) AS c,
  count(*) FILTER (NOT is_home) AS n, count(*) FILTER (NOT is_home AND (title = '' OR same > 1)) AS bad, count(*) FILTER (NOT is_home AND words < 100) AS thin FROM g GROUP BY site)
SELECT site, n AS inner_pages, bad AS bad_titles, thin AS thin_pages,
  CAST(floor(100.0 * (3 * CAST(a AS INT) + 5 * CAST(b AS INT) + 20 * CAST(c AS INT) + CASE WHEN n > 0 THEN 4 * CAST(bad = 0 AS INT) + 3 * CAST(thin = 0 AS INT) ELSE 0 END) / (28 + CASE WHEN n > 0 THEN 7 ELSE 0 END) + 0.5) AS BIGINT) AS score FROM s""")
def site_title_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each site's homepage and inner pages do on titles, headings and text: five rules, one score."""
    rows_ = engine.sites(engine.page_responses(table(spark, sf_dir, "pages")), parts=frozenset())
    wanted = {"title-length", "single-h1", "content-in-html", "pages-titles", "pages-content"}
    rules = [r for r in engine.C.rules(("technical", "geo")) if r.id in wanted]
    outcomes = engine.evaluate(rows_, rules)
    score = outcomes.groupBy("site").agg(T.js_round(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)) * 100.0 / F.sum("weight")).alias("score"))
    counts = rows_.select("site", F.col("inner.n").alias("inner_pages"), F.coalesce("inner.bad_titles", F.lit(0)).alias("bad_titles"), F.col("inner.thin").alias("thin_pages"))
    return counts.join(score, "site").select("site", "inner_pages", "bad_titles", "thin_pages", "score")


@query()
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that applies, for every site of the pages table."""
    parts = engine.PARTS - {"evidence"}  # the pages that findings name are not asked for
    o = engine.evaluate(engine.sites(engine.page_responses(table(spark, sf_dir, "pages")), parts=parts))
    return o.select("site", "module", "id", "weight", "passed", "credit", F.col("finding.severity").alias("severity"))


@query()
def citation_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(engine.page_responses(table(spark, sf_dir, "pages")), "final_url", "body").drop("body")
    return engine.page_scores(engine.citation_states(p.withColumn("entity", F.col("dom.entity")))).select("site", "page_idx", "answer-passage", "structure", "clarity", "score")


_PAGE_RULES = {"technical": ("title-length", "single-h1", "pages-titles", "pages-descriptions", "pages-h1", "pages-content"), "geo": ("content-in-html",)}
_KEY = f"{_SITE} || rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"


@query(f"""
WITH f AS (SELECT page_id, url, {_SITE} AS site, {_KEY} AS key, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '<h1[ >]')) AS h1, {_n_words(_PLAIN)} AS words, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description FROM pages),
g AS (SELECT f.*, page_id = min(page_id) OVER (PARTITION BY site) AS is_home FROM f),
t AS (SELECT g.*, (SELECT count(DISTINCT url) FROM g o WHERE o.site = g.site AND lower(o.title) = lower(g.title)) AS same_title, (SELECT count(DISTINCT url) FROM g o WHERE o.site = g.site AND lower(o.description) = lower(g.description)) AS same_description FROM g),
bad AS (SELECT site, page_id, url, key, unnest(list_filter([CASE WHEN is_home AND title <> '' AND length(title) NOT BETWEEN 15 AND 60 THEN 'title-length' END, CASE WHEN is_home AND h1 <> 1 THEN 'single-h1' END, CASE WHEN is_home AND words < 150 THEN 'content-in-html' END,
  CASE WHEN NOT is_home AND (title = '' OR same_title > 1) THEN 'pages-titles' END, CASE WHEN NOT is_home AND (description = '' OR same_description > 1) THEN 'pages-descriptions' END, CASE WHEN NOT is_home AND h1 <> 1 THEN 'pages-h1' END, CASE WHEN NOT is_home AND words < 100 THEN 'pages-content' END], lambda x: x IS NOT NULL)) AS rule FROM t),
kept AS (SELECT *, row_number() OVER (PARTITION BY site, rule ORDER BY page_id, url) AS n FROM bad), i AS (SELECT key, count(DISTINCT site || rule) AS issues FROM kept WHERE n <= 6 GROUP BY key)
SELECT page_id, substr(title, 1, 120) AS title, CAST(h1 AS BIGINT) AS h1, words, coalesce(issues, 0) AS issues FROM f LEFT JOIN i USING (key)""")
def issues_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table with the issues that name each page, from the findings' evidence: seven rules, at most six pages a finding."""
    p = table(spark, sf_dir, "pages")
    rules = [r for m, ids in _PAGE_RULES.items() for r in engine.C.rules((m,)) if r.id in ids]
    found = engine.evaluate(engine.sites(engine.page_responses(p), parts=frozenset({"evidence"})), rules).where("finding is not null")
    evidence = found.select(F.concat_ws(" ", "site", "finding.id").alias("finding"), F.explode("finding.evidence").alias("e")).select("finding", "e.url")
    facts = parsed(p).select("page_id", "url", F.col("dom.title_line").alias("title"), F.col("dom.h1_text").alias("headline"), F.col("dom.h1").cast("long").alias("h1"), T.word_count(F.col("dom.text")).alias("words"))
    return P.page_table(facts, evidence, "page_id").select("page_id", "title", "h1", "words", "issues")


_ROBOTS = [
    ("a", "User-agent: *\nDisallow: /private\nAllow: /private/open\nSitemap: https://a.test/s.xml"),
    ("b", "user-agent: GPTBot\nuser-agent: Googlebot\nDisallow: /\n\nUser-agent: *\nAllow: /"),
    ("c", "User-agent: *\nDisallow: /*.pdf$\nDisallow: /a*b\n# note\nDisallow:"),
    ("d", "junk line\nDisallow: /\nUser-agent: GPTBot\nCrawl-delay: 3\nDisallow: /x\nUser-agent: GPTBot\nDisallow: /y"),
]
_ASKED = [("GPTBot", "/"), ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://x)", "/private/open/z"), ("OAI-SearchBot", "/private"), ("CCBot", "/f.pdf"), ("CCBot", "/f.pdf?x"), ("GPTBot", "/y/1"), ("PerplexityBot", "/axxb")]
_RULES = [  # what the texts above mean: site, group, agent, verdict, pattern, length
    ("a", 1, "*", "disallow", "^/private", 8), ("a", 1, "*", "allow", "^/private/open", 13), ("b", 1, "gptbot", "disallow", "^/", 1), ("b", 1, "googlebot", "disallow", "^/", 1), ("b", 2, "*", "allow", "^/", 1),
    ("c", 1, "*", "disallow", "^/.*[.]pdf$", 7), ("c", 1, "*", "disallow", "^/a.*b", 4), ("d", 1, "gptbot", "disallow", "^/x", 2), ("d", 2, "gptbot", "disallow", "^/y", 2),
]
_TOKENS = {"GPTBot": ["gptbot"], "Mozilla/5.0 (compatible; Googlebot/2.1; +http://x)": ["mozilla", "googlebot"], "OAI-SearchBot": ["oai-searchbot"], "CCBot": ["ccbot"], "PerplexityBot": ["perplexitybot"]}


def _values(tuples: list[tuple]) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, t)) + ")" for t in tuples) + ")"


@query(f"""
WITH q AS (SELECT s.kind || s.page_id AS site, s.kind, a.agent, a.path FROM (SELECT page_id, substr('abcd', CAST(page_id % 4 AS INT) + 1, 1) AS kind FROM pages) s CROSS JOIN {_values(_ASKED)} a(agent, path)),
t AS (SELECT * FROM {_values([(a, x) for a, xs in _TOKENS.items() for x in xs])} v(agent, token)), r AS (SELECT * FROM {_values(_RULES)} v(site, grp, name, verdict, pattern, size)),
own AS (SELECT DISTINCT q.site, q.agent FROM q JOIN t USING (agent) JOIN r ON r.site = q.kind AND r.name = t.token),
f AS (SELECT q.*, r.verdict, r.size FROM q JOIN r ON r.site = q.kind AND regexp_matches(q.path, r.pattern) AND (r.name IN (SELECT token FROM t WHERE t.agent = q.agent) OR (r.name = '*' AND NOT EXISTS (SELECT 1 FROM own WHERE own.site = q.site AND own.agent = q.agent)))),
b AS (SELECT site, agent, path, verdict, row_number() OVER (PARTITION BY site, agent, path ORDER BY size DESC, verdict = 'allow' DESC) AS n FROM f)
SELECT q.site, q.agent, q.path, coalesce(b.verdict = 'allow', true) AS allowed FROM q LEFT JOIN b ON b.site = q.site AND b.agent = q.agent AND b.path = q.path AND b.n = 1""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file of one of four kinds for every page's site; the texts are parsed here, the SQL holds what they mean."""
    kinds = F.broadcast(spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(_ROBOTS)], "i int, kind string, robots_txt string"))
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).cast("int").alias("i")).join(kinds, "i")
    texts = p.select(F.concat("kind", F.col("page_id").cast("string")).alias("site"), "robots_txt")
    asked = texts.select("site", F.inline(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(x).alias("path")) for a, x in _ASKED])))
    return robots.decide(robots.parse(texts), asked)


_HEADINGS = [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 1), (2, 2, 2), (2, 3, 3), (2, 4, 2), (3, 1, 2), (3, 2, 5), (3, 3, 6)]


@query(f"""
WITH h AS (SELECT CAST(p AS BIGINT) AS page, CAST(l AS BIGINT) AS level, n FROM {per_page(_values(_HEADINGS), 'p, n, l')} v(p, n, l)), g AS (SELECT page, level, n, lag(level) OVER (PARTITION BY page ORDER BY n) AS up FROM h)
SELECT page, min_by(up, n) AS from_level, min_by(level, n) AS to_level FROM g WHERE level - up > 1 GROUP BY page""")
def heading_skip_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    html: dict[int, str] = {}
    for p, _, n in _HEADINGS:
        html[p] = html.get(p, "") + f"<h{n}>x</h{n}>"
    kinds = F.broadcast(spark.createDataFrame([(p - 1, h) for p, h in html.items()], "kind int, html string"))
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "url", (F.col("page_id") % len(html)).cast("int").alias("kind"))
    pages = parsed(own.join(kinds, "kind"))
    levels = F.transform("dom.headings", lambda h: h["level"].cast("long"))
    steps = T.once(levels, lambda l: F.filter(F.transform(l, lambda x, i: F.struct(F.get(l, i - 1).alias("a"), x.alias("b"))), lambda s: s["b"] - s["a"] > 1))
    return pages.select("page", F.get(steps, F.lit(0)).alias("s")).where("s is not null").select("page", F.col("s.a").alias("from_level"), F.col("s.b").alias("to_level"))


_LD = [
    (1, '{"@type":"Organization","name":"A","sameAs":["https://x.com/a"]}'), (2, '{"@graph":[{"@type":["Product","Thing"]},{"@type":"FAQPage","mainEntity":[]}]}'), (3, '{"broken": '), (4, ""), (5, '[{"@type":"Bakery","name":"Your Business"}]'),
]
_LD_ROWS = per_page(_values(_LD), "id, j", j=('"A"', '"A{n}"'))
_LD_SQL = f"(SELECT CAST(id AS BIGINT) AS id, j FROM {_LD_ROWS} v(id, j) WHERE json_valid(j))"


@query(rf"""
SELECT DISTINCT id, unnest(list_concat(regexp_extract_all(j, '"@type":"([^"]*)"', 1), flatten(list_transform(regexp_extract_all(j, '"@type":\[([^\]]*)\]', 1), lambda x: regexp_extract_all(x, '"([^"]*)"', 1))))) AS type FROM {_LD_SQL}""")
def jsonld_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ld(spark, sf_dir).select("id", F.explode("dom.schema_types").alias("type"))


@query(rf"""
WITH n AS (SELECT id, unnest(regexp_extract_all(j, '\{{[^{{}}]*\}}')) AS n FROM {_LD_SQL}), needs(type, property) AS (VALUES ('Product', 'name'), ('FAQPage', 'mainEntity'), ('Bakery', 'name'), ('Bakery', 'address'), ('Organization', 'name'))
SELECT id, 'missing' AS kind, type, property FROM n JOIN needs ON regexp_matches(n, '"@type":[^,}}]*"' || type || '"') WHERE NOT regexp_matches(n, '"' || property || '":("[^"]|\[[^\]]|\{{[^}}]|[0-9])')
UNION ALL SELECT id, 'placeholder', regexp_extract(n, '"@type":[^"]*"([^"]*)"', 1), NULL FROM n WHERE regexp_matches(n, '(?i)"your (business|company)[^"]*"')""")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ld(spark, sf_dir).select("id", F.inline("dom.schema_problems")).select("id", "kind", "type", "property")


def _ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = rows(spark, f"SELECT id, j FROM {_LD_ROWS} AS v(id, j)", sf_dir)
    return parsed(j.select("id", F.lit("https://x.test/").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), "j", F.lit("</script>")).alias("html")))


@query(f"""
WITH p AS (SELECT {_SITE} AS site, url, page_id % 7 AS k FROM pages),
s AS (SELECT site, CASE WHEN k = 0 THEN 'redirected' WHEN k = 1 THEN 'server' WHEN k = 2 THEN 'client' WHEN k = 3 THEN 'unreachable' ELSE 'ok' END AS class FROM p)
SELECT site, count(*) FILTER (class = 'ok') AS ok, count(*) FILTER (class = 'redirected') AS redirected, count(*) FILTER (class = 'client') AS client_error, count(*) FILTER (class = 'server') AS server_error, count(*) FILTER (class = 'unreachable') AS unreachable FROM s GROUP BY site""")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, plain = F.col("page_id") % 7, F.regexp_replace("url", r"[?#].*", "")
    read = table(spark, sf_dir, "pages").select(U.bare_host(F.col("url")).alias("site"), plain.alias("url"), F.when(k == 0, F.concat(plain, F.lit("/moved"))).otherwise(plain).alias("final_url"), F.when(k == 1, 503).when(k == 2, 404).when(k == 3, 0).otherwise(200).alias("status"))
    return links.status_classes(read)


_MAPS = [
    (1, "https://a.test/", "<urlset><loc>https://a.test/</loc><loc>https://a.test/b</loc></urlset>"), (2, "https://a.test/", "<urlset></urlset>"), (3, "https://a.test/", "<urlset><loc>http://a.test/x</loc><loc>https://b.test/</loc></urlset>"),
    (4, "https://a.test/", "<urlset><loc>https://www.a.test</loc><loc>https://a.test/</loc></urlset>"),
]


_MAP_ROWS = per_page(_values(_MAPS), "id, u, x", u=("a.test", "a{n}.test"), x=("a.test", "a{n}.test"))


@query(rf"""
WITH m AS (SELECT CAST(id AS BIGINT) AS id, u, regexp_extract_all(x, '<loc>([^<]*)</loc>', 1) AS l FROM {_MAP_ROWS} v(id, u, x)),
k AS (SELECT *, list_transform(l, lambda x: rtrim(regexp_replace(x, '^[a-z]+://(www\.)?', ''), '/')) AS keys, rtrim(regexp_replace(u, '^[a-z]+://(www\.)?', ''), '/') AS own FROM m)
SELECT id, CASE WHEN len(l) = 0 THEN 1 ELSE CAST(len(list_filter(keys, lambda x: split_part(x, '/', 1) <> split_part(own, '/', 1))) > 0 AS BIGINT) + CAST(starts_with(u, 'https:') AND len(list_filter(l, lambda x: starts_with(x, 'http:'))) > 0 AS BIGINT)
  + CAST(len(list_distinct(keys)) < len(keys) AS BIGINT) + CAST(NOT list_contains(keys, own) AS BIGINT) END AS issues FROM k""")
def sitemap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rows(spark, f"SELECT id, u AS url, x AS xml FROM {_MAP_ROWS} AS v(id, u, x)", sf_dir)
    return m.select("id", engine.sitemap_facts(F.col("xml"), F.col("url"))["n_issues"].cast("long").alias("issues"))
