"""Ready-to-paste items and whole reports, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import kit
from ..sources.html import parsed
from .registry import query, table
from .rule_queries import _SITE, _TITLE


def _xml(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _md(x: str) -> str:
    return rf"regexp_replace(replace(replace(replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_{{}}\[\]()#+!|~])', '\\\1', 'g')"


_N = "chr(10)"
_HEADERS = " || chr(10) || ".join(f"'add_header {k} \"{v}\" always;'" for k, v in kit.HEADERS)


@query(rf"""
WITH p AS (SELECT page_id, url, {_SITE} AS site, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title FROM pages),
h AS (SELECT site, min(page_id) AS home FROM p GROUP BY site), s AS (SELECT p.*, regexp_extract(lower(url), '^[a-z]+://[^/?#:]*') AS origin, coalesce(nullif(title, ''), site) AS name FROM p JOIN h USING (site) WHERE page_id = home),
i AS (SELECT p.site, p.url, p.title, row_number() OVER (PARTITION BY p.site ORDER BY p.page_id, p.url) AS k FROM p JOIN h USING (site) WHERE page_id <> home),
l AS (SELECT site, list(url ORDER BY k) AS urls, string_agg('- [' || {_md("coalesce(nullif(title, ''), url)")} || '](' || url || ')', {_N} ORDER BY k) AS entries FROM i WHERE k <= {kit.MOST_PAGES} GROUP BY site),
j AS (SELECT s.*, coalesce(urls, []) AS urls, entries FROM s LEFT JOIN l USING (site)),
u AS (SELECT site, list_filter(list_transform(range(1, len(a) + 1), lambda n: CASE WHEN list_position(a, a[n]) = n THEN a[n] END), lambda x: x IS NOT NULL) AS a FROM (SELECT site, list_concat([url], urls) AS a FROM j))
SELECT site, item, content FROM (
  SELECT site, 'canonical' AS item, '<link rel="canonical" href="' || {_xml("url")} || '">' AS content FROM j
  UNION ALL SELECT site, 'robots.txt', 'User-agent: *' || {_N} || 'Allow: /' || {_N} || {_N} || 'Sitemap: ' || origin || '/sitemap.xml' || {_N} FROM j
  UNION ALL SELECT site, 'sitemap.xml', '{kit.SITEMAP_HEAD.replace(chr(10), "' || chr(10) || '")}' || array_to_string(list_transform(a, lambda x: '  <url><loc>' || {_xml("x")} || '</loc></url>'), {_N}) || {_N} || '</urlset>' || {_N} FROM u
  UNION ALL SELECT site, 'organization', replace('{{"@context":"https://schema.org","@type":"Organization","name":"' || replace(replace(name, '\', '\\'), '"', '\"') || '","url":"' || origin || '/"}}', '<', '\u003c') FROM j
  UNION ALL SELECT site, 'llms.txt', '# ' || {_md("name")} || coalesce({_N} || {_N} || '## Pages' || {_N} || entries, '') || {_N} FROM j
  UNION ALL SELECT site, 'open-graph', '<meta property="og:title" content="' || {_xml("name")} || '">' || {_N} || '<meta property="og:type" content="website">' || {_N} || '<meta property="og:url" content="' || {_xml("url")} || '">' FROM j
  UNION ALL SELECT site, 'head', '<title>' || {_xml("name")} || '</title>' || {_N} || '<meta name="viewport" content="width=device-width, initial-scale=1">' FROM j
  UNION ALL SELECT site, 'headers', {_HEADERS} FROM j)""")
def fix_kit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's text for every site of the pages table: its least page is the homepage, no page has a description."""
    p = parsed(table(spark, sf_dir, "pages")).select("page_id", "url", U.bare_host(F.col("url")).alias("site"), F.col("dom.title_line").alias("title"))
    home = p.groupBy("site").agg(F.min("page_id").alias("home"))
    p = p.join(home, "site")
    sites = p.where("page_id = home").select("site", "url", "title", F.lit(None).cast("string").alias("description"))
    return kit.texts(sites, p.where("page_id <> home").select("site", F.col("page_id").alias("ord"), "url", "title"))
