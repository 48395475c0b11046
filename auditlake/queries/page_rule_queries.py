"""The rules over every site of the pages table, their verdicts found again by SQL from markup.

The table holds neither headers nor files beside the pages, so rules on those have one verdict everywhere; rules whose
part is absent (probes, rendering, robots lines, measurements) do not apply and have no row in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import catalogue as C
from ..plans import engine
from ..sources.html import parsed
from . import rule_fixtures as R
from .registry import query, table
from .rule_queries import _BODY, _PLAIN, _SITE, _n_words, _unescape

# Weight and severity of every rule, by module.
FIXED = {
    "technical": (
        "status-ok 8 critical; https 7 high; indexable 8 critical; title 6 high; title-length 3 low; meta-description 5 medium; meta-description-length 2 low; single-h1 5 medium; "
        "canonical 3 medium; html-lang 2 low; viewport 5 high; image-alt 4 medium; robots-txt 3 low; sitemap 5 medium; structured-data 4 medium; open-graph 2 low; mobile-layout 4 medium; "
        "hsts 2 low; not-truncated 2 medium; json-ld-valid 4 high; schema-complete 3 medium; canonical-valid 3 medium; heading-order 2 low; security-headers 3 low; image-dimensions 2 low; "
        "internal-links 3 low; broken-links 4 high; https-redirect 3 high; host-redirect 3 medium; soft-404 3 medium; hreflang-valid 3 medium; article-authorship 3 medium; "
        "sitemap-quality 3 medium; robots-sitemap 2 low; pages-titles 4 medium; pages-descriptions 3 medium; pages-h1 3 low; pages-content 3 low"
    ),
    "geo": (
        "ai-crawler-oai-searchbot 10 high; ai-crawler-claude-searchbot 10 high; ai-crawler-perplexitybot 10 high; ai-crawler-googlebot 6 critical; content-in-html 20 critical; "
        "organisation-schema 12 medium; question-headings 10 medium; question-answers 3 medium; citable-passage 14 medium; llms-txt 4 low; freshness-signals 4 low"
    ),
    "content": (
        "cta-present 18 high; headline-clear 10 medium; contact-info 10 medium; trust-signals 8 medium; navigation 10 medium; about-page 6 low; policy-pages 6 medium; content-depth 4 low; "
        "readability 4 low; copyright-year 4 low"
    ),
    "marketing": (
        "analytics 10 medium; lead-capture 12 medium; offer-clarity 10 medium; content-hub 8 low; reviews-markup 8 low; risk-reversal 8 low; specific-proof 8 medium; contact-channels 6 low"
    ),
    "social": (
        "has-profiles 25 medium; profile-links-valid 15 low; key-platforms 15 medium; schema-sameas 10 low; profiles-reachable 25 high; profile-activity 10 medium"
    ),
    "performance": (
        "perf-score 40 medium; lcp 20 medium; cls 15 medium; tbt 15 medium; fcp 10 medium"
    ),
    "citation": (
        "entity-early 12 medium; definition 12 medium; answer-passage 18 medium; facts 8 low; structure 10 medium; clarity 8 low; schema-fit 10 high; authority 10 low; "
        "external-authority 12 low"
    ),
    "crawl": (
        "canonical-consistency 20 high; orphan-pages 15 low; internal-redirects 10 low; render-links 15 high; render-schema 10 medium; render-headings 15 high; render-hydration 15 high"
    ),
}
#: (module, id, weight, severity); a test holds them against the catalogue, whose rules are made only with a Spark context.
RULES = [(m, *x.split(" ")) for m, own in FIXED.items() for x in own.split("; ")]

_BLOCK = "p|h[1-6]|div|ul|ol|table|article|section|footer|nav|aside|header|form|blockquote"
_CUT = rf"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(</?(?:{_BLOCK}|body)[ >])', '</p>\1', 'g')"
#: Paragraphs as a browser closes them: at the next block, whatever closes it in the markup.
_PARAGRAPHS = _unescape("regexp_replace(x, '<[^>]*>', '', 'g')")
_PS = rf"list_transform(regexp_extract_all({_CUT}, '(?s)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace({_PARAGRAPHS}, '\s+', ' ', 'g')))"

_GEO = R._GEO | {"content-in-html": f"{_n_words(_PLAIN)} >= 150", "citable-passage": R._some(_PS, f"{R._words('x')} BETWEEN 40 AND 200")}
_CONTENT = {k: v for k, v in R._CONTENT.items() if k not in ("content-depth", "readability")} | {"copyright-year": "coalesce(TRY_CAST(regexp_extract(html, '(?:©|&copy;|\\(c\\)|copyright)[^0-9<]{0,20}([0-9]{4})', 1) AS INT) >= 2023, true)"}
_BY_MODULE = {"technical": R._TECHNICAL, "geo": _GEO, "content": _CONTENT, "marketing": R._MARKETING, "social": R._SOCIAL}
_KINDS = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INT", "double": "DOUBLE"}
_GIVEN = {"site": _SITE, "url": "url", "html": "html", "status": "200", "truncated": "strlen(html) > 2000000", "broken": "0"}
_HOMES = "(SELECT " + ", ".join(f"{_GIVEN.get(k, f'CAST(NULL AS {_KINDS[R._type(k)]})')} AS {k}" for k in R._HOMES[0] if k != "kind") + f" FROM (SELECT *, page_id = min(page_id) OVER (PARTITION BY {_SITE}) AS is_home FROM pages) WHERE is_home) v"
_INNER_IDS = ("pages-titles", "pages-descriptions", "pages-h1", "pages-content", "internal-redirects")


def _wanted() -> list[C.Rule]:
    of_home = [r for m, own in _BY_MODULE.items() for r in C.rules((m,)) if r.id in own]
    return of_home + [r for r in C.rules(("technical", "crawl")) if r.id in _INNER_IDS]


def _sql() -> str:
    wanted = [x for x in RULES if x[1] in _BY_MODULE.get(x[0], ()) or x[1] in _INNER_IDS]
    pairs = ", ".join(f"{{'module': '{m}', 'id': '{k}', 'passed': {v}}}" for m, own in _BY_MODULE.items() for k, v in own.items())
    title = _unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")
    return rf"""
WITH h AS (SELECT * FROM {_HOMES}), f AS (SELECT *, {R._READ}, coalesce(regexp_extract_all(sitemap, '<loc>([^<]*)</loc>', 1), []) AS locs FROM h),
g AS (SELECT *, array_to_string(ps, ' ') AS p, list_distinct(list_filter(list_transform(hrefs, lambda x: regexp_extract(x, '^https?://(www[.])?(facebook|linkedin)[.]com/[a-z]', 2)), lambda x: x <> '')) AS platforms FROM f),
own AS (SELECT site, u.module AS module, u.id AS id, u.passed AS passed FROM (SELECT site, unnest([{pairs}]) AS u FROM g)),
pf AS (SELECT page_id, url, {_SITE} AS site, trim(regexp_replace({title}, '\s+', ' ', 'g')) AS title, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description, len(regexp_extract_all(html, '<h1[ >]')) AS h1, {_n_words(_PLAIN)} AS words FROM pages),
pg AS (SELECT *, page_id = min(page_id) OVER (PARTITION BY site) AS is_home FROM pf),
pt AS (SELECT *, (SELECT count(DISTINCT url) FROM pg o WHERE o.site = pg.site AND lower(o.title) = lower(pg.title)) AS t, (SELECT count(DISTINCT url) FROM pg o WHERE o.site = pg.site AND lower(o.description) = lower(pg.description)) AS d FROM pg),
inn AS (SELECT site, bool_and(title <> '' AND t = 1) AS titles, bool_and(description <> '' AND d = 1) AS descriptions, bool_and(h1 = 1) AS h1s, bool_and(words >= 100) AS contents FROM pt WHERE NOT is_home GROUP BY site),
every AS (SELECT * FROM own UNION ALL SELECT site, u.module, u.id, u.passed FROM (SELECT site, unnest([{{'module': 'technical', 'id': 'pages-titles', 'passed': titles}}, {{'module': 'technical', 'id': 'pages-descriptions', 'passed': descriptions}}, {{'module': 'technical', 'id': 'pages-h1', 'passed': h1s}},
  {{'module': 'technical', 'id': 'pages-content', 'passed': contents}}, {{'module': 'crawl', 'id': 'internal-redirects', 'passed': true}}]) AS u FROM inn)),
w AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{i}', {w}, '{v}')" for m, i, w, v in wanted)}) v(module, id, weight, severity))
SELECT site, module, id, CAST(weight AS INT) AS weight, passed, CASE WHEN NOT passed THEN severity END AS severity FROM every JOIN w USING (module, id) WHERE passed IS NOT NULL"""


@query(_sql())
def page_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, verdict and severity of about eighty rules for every site of the pages table."""
    parts = engine.PARTS - {"evidence", "citation"}
    o = engine.evaluate(engine.sites(engine.page_responses(table(spark, sf_dir, "pages")), parts=parts), _wanted())
    return o.select("site", "module", "id", "weight", "passed", F.col("finding.severity").alias("severity"))


_MAIN = rf"regexp_replace(regexp_replace(regexp_replace({_CUT}, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g'), '(?s)<aside>.*?</aside>', '', 'g')"
_MAIN_PS = rf"list_filter(list_transform(regexp_extract_all({_MAIN}, '(?s)<p>(.*?)</p>', 1), lambda x: trim(regexp_replace({_PARAGRAPHS}, '\s+', ' ', 'g'))), lambda x: x <> '')"
_MAIN_WORDS = _n_words(_unescape(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"))
_SENTENCES = "list_filter(regexp_split_to_array(replace(replace(replace(x, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), '[\\x01]'), lambda s: NOT regexp_matches(s, '[0-9]'))"
_ACRONYMS = rf"list_filter(list_distinct(regexp_extract_all(t, '\b[A-Z]{{2,6}}\b')), lambda a: len(list_filter(regexp_extract_all(t, '\b[A-Z]{{2,6}}\b'), lambda b: b = a)) >= 2 AND NOT list_contains([{', '.join(repr(a) for a in T.COMMON_ACRONYMS)}], a) AND NOT contains(t, '(' || a || ')') AND NOT regexp_matches(t, a || '\s*\('))"


@query(rf"""
WITH p AS (SELECT page_id, {_SITE} AS site, {_MAIN_PS} AS ps, {_MAIN_WORDS} AS words, len(regexp_extract_all(html, '<h[23][ >]')) AS sections FROM pages),
q AS (SELECT *, list_transform(ps, lambda x: {R._words('x')}) AS sizes, array_to_string(ps, ' ') AS t, coalesce(list_sum(list_transform(ps, lambda x: coalesce(list_sum(list_transform({_SENTENCES}, lambda s: len(regexp_extract_all(s, '(?i){T.VAGUE}')))), 0))), 0) AS vague FROM p),
s AS (SELECT *, coalesce(list_sum(sizes), 0) AS prose FROM q)
SELECT site, page_id AS page_idx, CASE WHEN words >= 100 AND prose >= 100 THEN CASE WHEN len(list_filter(sizes, lambda n: n BETWEEN 134 AND 167)) > 0 THEN 1.0 WHEN len(list_filter(sizes, lambda n: n BETWEEN 40 AND 200)) > 0 THEN 0.5 ELSE 0.0 END END::DOUBLE AS answer_passage,
  CASE WHEN words >= 100 AND prose >= 100 THEN CASE WHEN len(list_filter(sizes, lambda n: n > 200)) > 0 OR (prose >= 400 AND sections < 2) THEN 0.0 ELSE 1.0 END END::DOUBLE AS structure,
  CASE WHEN words >= 100 THEN CASE WHEN vague < 3 AND len({_ACRONYMS}) < 2 THEN 1.0 ELSE 0.0 END END::DOUBLE AS clarity FROM s""")
def citation_states_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's paragraphs answer, are built well and are clear, found again by SQL from the markup."""
    p = parsed(engine.page_responses(table(spark, sf_dir, "pages")), "final_url", "body").drop("body")
    states = engine.citation_states(p.withColumn("entity", F.col("dom.entity")))
    return states.select("site", "page_idx", F.col("answer-passage").alias("answer_passage"), "structure", "clarity")
