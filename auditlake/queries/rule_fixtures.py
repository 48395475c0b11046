"""Every rule of the catalogue on sites made of all pages: the engine's outcomes against verdicts that SQL reads from the markup.

A healthy site is changed in one or two respects at a time. The same rows go to both engines; the SQL finds each
rule's verdict by its own patterns over markup, headers and files, never from a list of answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..plans import catalogue as C
from ..plans import engine
from .registry import query, table

_LOAF = "the loaf we bake at dawn is soft and warm and good to eat with salt or jam "
_HEAVY = "organisational responsibilities necessitate internationalisation notwithstanding administrative considerations "


def _of(words: str, n: int) -> str:
    """n words of running text, a full stop after each twelfth."""
    some = (words * (n // len(words.split()) + 1)).split()[:n]
    return " ".join(w + ("." if i % 12 == 11 or i == n - 1 else "") for i, w in enumerate(some))


def _ask(n: int, answer: int = 26) -> str:
    return "".join(f"<h2>How long does loaf {i} keep?</h2>\n<p>{_of(_LOAF, answer)}</p>\n" for i in range(n))


_PARTS = {
    "lang": ' lang="en"', "title": "Fresh bread baked daily in the old mill", "description": "Bread, rolls and cakes baked every night and brought to homes and shops before breakfast.", "robots_meta": "",
    "viewport": '<meta name="viewport" content="width=device-width">', "canonical": '<link rel="canonical" href="https://{site}.test/">', "og": '<meta property="og:title" content="Bread"><meta property="og:image" content="https://{site}.test/a.png">',
    "name": '<meta property="og:site_name" content="Leavenhall">', "alternates": '<link rel="alternate" hreflang="en" href="https://{site}.test/"><link rel="alternate" hreflang="de" href="https://{site}.test/de">',
    "ld": [
        '{"@type":"Bakery","name":"Leavenhall","address":"1 Mill Lane","sameAs":["https://www.facebook.com/leavenhall"],"aggregateRating":{"@type":"AggregateRating","ratingValue":5}}',
        '{"@type":"Article","headline":"Rye","author":{"name":"Mo"},"datePublished":"2023-05-01"}', '{"@type":"Organization","name":"Leavenhall"}',
    ],
    "scripts": '<script src="https://plausible.io/js/script.js"></script>', "nav": '<nav><a href="/about">About us</a> <a href="/blog/">Blog</a> <a href="/pricing">Pricing</a></nav>', "h1": "<h1>Bread for your table every morning</h1>",
    "first": "<p>Leavenhall is a bakery that makes bread for homes and shops across the whole county.</p>", "questions": _ask(1), "passage": f"<p>{_of(_LOAF, 150)}</p>", "more": f"<h2>Our mill</h2>\n<p>{_of(_LOAF, 120)}</p>",
    "proof": "<p>Rated 4.9 out of 5 by 1,200 customers since 1987.</p>", "offer": "<p>Loaves from £4 with a money-back guarantee.</p>", "images": '<img src="/a.png" alt="a" width="4" height="4">', "cta": '<a href="/order">Order now</a>',
    "contact": '<a href="tel:+441130000">Call</a> <a href="mailto:a@b.test">Write</a>', "privacy": '<a href="/privacy">Privacy</a>', "social": '<a href="https://www.facebook.com/leavenhall">f</a> <a href="https://www.linkedin.com/company/leavenhall">l</a>',
    "sources": '<a href="https://grain.example.org/x">grain</a> <a href="https://millers.example.net/y">millers</a>', "form": '<form action="/signup"><input type="email" name="email"></form>', "time": '<time datetime="2023-05-01">1 May</time>',
    "footer": "<footer>© 2024 Leavenhall</footer>",
}
_META = {
    "url": "https://{site}.test/", "status": 200, "truncated": False, "xcto": "nosniff", "xfo": "DENY", "ref": "no-referrer", "hsts": "max-age=1", "xrobots": None, "modified": None, "robots": "User-agent: *\nAllow: /\nSitemap: https://{site}.test/s.xml",
    "sitemap": "<urlset><loc>https://{site}.test/</loc><loc>https://{site}.test/about</loc></urlset>", "llms": "# bread", "overflow": False, "r_h1": 1, "r_links": 9, "r_ld": 3, "r_errors": 0, "http_to": "https://{site}.test/", "alt_to": "https://{site}.test/", "nf_status": 404,
    "broken": 0, "known": True, "answered": 2, "missing": 0, "newest": 20, "score": 0.95, "lcp": 2000.0, "cls": 0.05, "tbt": 100.0, "fcp": 1500.0,
}
_ORDER = "h1 first questions passage more proof offer images cta contact privacy social sources form time".split()


def _page(site: str, **changed) -> str:
    p = _PARTS | changed
    ld = "".join(f'<script type="application/ld+json">{x}</script>' for x in p["ld"])
    head = f'<title>{p["title"]}</title><meta name="description" content="{p["description"]}">' + "".join(p[k] for k in ("robots_meta", "viewport", "canonical", "og", "name", "alternates")) + ld + p["scripts"]
    return f'<!doctype html>\n<html{p["lang"]}><head>{head}</head>\n<body>\n{p["nav"]}\n' + "\n".join(p[k] for k in _ORDER) + f'\n<p>{{t}}</p>\n{p["footer"]}\n</body></html>'


_BAKERY, _ARTICLE, _FIRM = _PARTS["ld"]
_INNER_OK = {"title": "Rye bread", "h1": "<h1>Rye</h1>", "description": "About rye.", "canonical": '<link rel="canonical" href="https://{site}.test/{path}">', "ld": []}
#: site: what differs from the healthy one. "inner": (path, final path, parts that differ) of further pages.
_SITES: dict[str, dict] = {
    "healthy": {}, "plain": {"url": "http://{site}.test/", "http_to": "http://{site}.test/", "alt_to": "http://www.{site}.test/"}, "down": {"status": 503, "nf_status": 200, "broken": 3}, "noindex": {"robots_meta": '<meta name="robots" content="noindex">', "lang": ""},
    "noindexhead": {"xrobots": "noindex"}, "untitled": {"title": "", "description": "", "og": "", "name": ""}, "short": {"title": "Bread", "description": "Bread daily."}, "twoheads": {"h1": "<h1>One more loaf</h1><h1>Two more loaves</h1>"}, "nohead": {"h1": "", "canonical": "", "r_h1": 1},
    "desktop": {"viewport": "", "overflow": True}, "images": {"images": '<img src="/a.png"> <img src="/b.png">'}, "bare": {"robots": None, "sitemap": None, "llms": None}, "nodata": {"ld": [], "r_ld": 2}, "brokendata": {"ld": ['{"@type": "Organization", ', _FIRM]},
    "heads": {"xcto": None, "xfo": None, "ref": None, "hsts": None, "truncated": True}, "incomplete": {"ld": ['{"@type":"Product","sku":"1"}', '{"@type":"Article","headline":"Rye"}']}, "elsewhere": {"canonical": '<link rel="canonical" href="https://elsewhere.test/other">'}, "jumps": {"more": f"<h4>Mill</h4>\n<p>{_of(_LOAF, 120)}</p>"},
    "island": {"nav": "", "cta": "", "privacy": "", "r_links": 40}, "langs": {"alternates": '<link rel="alternate" hreflang="english" href="/en">'}, "maps": {"sitemap": "<urlset><loc>http://other.test/</loc></urlset>", "robots": "User-agent: *\nAllow: /"},
    "lost": {"sitemap": "<urlset><loc>https://{site}.test/</loc><loc>https://{site}.test/hidden</loc></urlset>"}, "shut": {"robots": "User-agent: PerplexityBot\nDisallow: /\n\nUser-agent: OAI-SearchBot\nDisallow: /\n\nUser-agent: Claude-SearchBot\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /"},
    "script": {"first": "", "questions": "", "passage": "", "more": ""}, "unanswered": {"questions": _ask(1, 4)}, "undated": {"time": "", "ld": [_FIRM]}, "headed": {"time": "", "ld": [_FIRM], "modified": "Mon, 01 May 2023 10:00:00 GMT"},
    "quiet": {"cta": '<a href="/bread">Bread</a>', "contact": "", "ld": [_FIRM], "form": "", "proof": "", "offer": "", "nav": '<nav><a href="/a">A</a> <a href="/b">B</a></nav>', "privacy": "", "scripts": ""}, "dense": {"passage": f"<p>{_of(_HEAVY, 150)}</p>", "more": f"<h2>Mill</h2>\n<p>{_of(_HEAVY, 120)}</p>"},
    "old": {"footer": "<footer>© 2019 Leavenhall</footer>"}, "loner": {"social": '<a href="https://www.facebook.com/">f</a>', "ld": [_ARTICLE, _FIRM], "missing": 1, "newest": 400}, "slow": {"score": 0.4, "lcp": 6000.0, "cls": 0.4, "tbt": 900.0, "fcp": 4000.0, "r_errors": 2, "known": False},
    "asks": {"questions": _ask(3)}, "faq": {"questions": _ask(3), "ld": [_BAKERY, '{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]}']}, "vague": {"first": "<p>Welcome to a place where every loaf is made with love and care by hand.</p>", "sources": ""}, "wall": {"passage": f"<p>{_of(_LOAF, 260)}</p>"},
    "inner": {"inner": [("rye", "rye", _INNER_OK), ("oat", "oat", _INNER_OK | {"title": "Oat bread", "description": "About oats."})]},
    "innerbad": {"inner": [("rye", "rye", _INNER_OK | {"first": "", "questions": "", "passage": "", "more": ""}), ("oat", "oats", _INNER_OK | {"h1": "", "canonical": '<link rel="canonical" href="https://{site}.test/rye">'})]},
}


def _fixtures() -> tuple[list[dict], list[dict]]:
    homes, inner = [], []
    for k0, (name, changed) in enumerate(_SITES.items()):
        site = name + "{n}"
        fill = lambda v, site=site: v.replace("{site}", site) if isinstance(v, str) else v
        parts = {k: v for k, v in changed.items() if k in _PARTS}
        meta = {k: fill(changed.get(k, v)) for k, v in _META.items()}
        homes.append({"kind": k0, "site": site, **meta, "html": fill(_page(site, **parts))})
        for k, (path, final, own) in enumerate(changed.get("inner", ()), 1):
            inner.append({"kind": k0, "site": site, "idx": k, "url": f"https://{site}.test/{path}", "final_url": f"https://{site}.test/{final}", "html": fill(_page(site, **own)).replace("{path}", final)})
    return homes, inner


_HOMES, _INNER = _fixtures()


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def _relation(rows: list[dict]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r.values())) + ")" for r in rows) + f") v({', '.join(rows[0])})"


def _woven(rows: list[dict]) -> str:
    """The rows as a relation over the pages table: every page makes a site of its own of one kind, with its number in all names and addresses and its title as one more paragraph."""
    fields = [f"replace(replace({c}, '{{n}}', n), '{{t}}', t) AS {c}" if any(isinstance(r[c], str) for r in rows) else c for c in rows[0] if c != "kind"]
    return f"(SELECT {', '.join(fields)} FROM {_relation(rows)} JOIN (SELECT page_id, CAST(page_id AS VARCHAR) AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) p ON page_id % {len(_SITES)} = kind) v"


def _some(items: str, test: str) -> str:
    return f"len(list_filter({items}, lambda x: {test})) > 0"


def _match(c: str, pattern: str) -> str:
    return "regexp_matches(" + c + ", '(?i)" + pattern.replace("'", "''") + "')"


_quoted = lambda pattern: pattern.replace("'", "''")
_N = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_words = lambda c: _N.replace("{}", c)
_any_of = lambda items, pattern: _some(items, _match("x", pattern))
#: What SQL reads from a page.
_READ = rf"""
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description, regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonical,
  len(regexp_extract_all(html, '<h1[ >]')) AS h1, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS headline, regexp_extract_all(html, '<img [^>]*>') AS imgs, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
  regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS own_hrefs, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS own_texts,
  regexp_extract_all(html, '(?s)<script type="application/ld.json">(.*?)</script>', 1) AS ld, array_to_string(regexp_extract_all(html, '(?s)<script type="application/ld.json">(.*?)</script>', 1), ' ') AS lds,
  array_to_string(regexp_extract_all(html, '(?s)<script.*?</script>'), ' ') AS scripts, list_transform(regexp_extract_all(html, '<h([1-6])[ >]', 1), lambda x: CAST(x AS INT)) AS levels, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps,
  regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)</body>', 1), '(?s)<script.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body, regexp_extract_all(html, '<h[23]>([^<]*\?)</h', 1) AS asked,
  regexp_extract_all(html, '<h[23]>[^<]*\?</h[23]>\s*<p>([^<]*)</p>', 1) AS answers, regexp_extract_all(html, '<link rel="alternate" hreflang="([^"]*)"', 1) AS codes, regexp_extract_all(html, '<link rel="alternate" hreflang="[^"]*" href="([^"]*)"', 1) AS versions"""
_TECHNICAL = {
    "status-ok": "status = 200", "https": "starts_with(url, 'https://')", "indexable": "NOT regexp_matches(html, '<meta name=\"robots\" content=\"[^\"]*noindex') AND NOT contains(coalesce(xrobots, ''), 'noindex')", "title": "title <> ''",
    "title-length": "title = '' OR length(title) BETWEEN 15 AND 60", "meta-description": "description <> ''", "meta-description-length": "description = '' OR length(description) BETWEEN 70 AND 160", "single-h1": "h1 = 1", "canonical": "canonical <> ''",
    "html-lang": "regexp_matches(html, '<html lang=\"[a-z]')", "viewport": "contains(html, '<meta name=\"viewport\"')", "image-alt": "len(list_filter(imgs, lambda x: NOT contains(x, ' alt='))) <= 0.1 * len(imgs)", "robots-txt": "robots IS NOT NULL", "sitemap": "sitemap IS NOT NULL",
    "structured-data": _some("ld", "json_valid(x)"), "open-graph": "contains(html, 'og:title') AND contains(html, 'og:image')", "mobile-layout": "NOT overflow", "hsts": "hsts IS NOT NULL", "not-truncated": "NOT truncated", "json-ld-valid": f"NOT ({_some('ld', 'NOT json_valid(x)')})",
    "schema-complete": "NOT " + _some("ld", "json_valid(x) AND ((json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.\"@type\"') IN ('Product', 'Organization', 'Bakery') AND json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.name') IS NULL) OR (json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.\"@type\"') = 'Bakery' AND json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.address') IS NULL) OR (json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.\"@type\"') = 'FAQPage' AND json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.mainEntity') IS NULL))"),
    "canonical-valid": "canonical = '' OR (rtrim(regexp_replace(canonical, '^https?', ''), '/') = rtrim(regexp_replace(url, '^https?', ''), '/') AND NOT (starts_with(canonical, 'http:') AND starts_with(url, 'https:')))",
    "heading-order": "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] - levels[i - 1] > 1)) = 0", "security-headers": "xcto IS NOT NULL AND xfo IS NOT NULL AND ref IS NOT NULL",
    "image-dimensions": "len(list_filter(imgs, lambda x: NOT (contains(x, ' width=') AND contains(x, ' height=')))) <= 0.2 * len(imgs)", "internal-links": "len(list_distinct(list_filter(list_transform(own_hrefs, lambda x: rtrim(x, '/')), lambda x: x <> ''))) >= 2", "broken-links": "broken = 0",
    "https-redirect": "starts_with(http_to, 'https://')", "host-redirect": "split_part(alt_to, '/', 3) = split_part(url, '/', 3)", "soft-404": "nf_status <> 200",
    "hreflang-valid": "CASE WHEN len(codes) > 0 THEN len(list_filter(codes, lambda x: NOT regexp_full_match(x, '(?i)x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*'))) = 0 AND len(list_filter(versions, lambda x: NOT starts_with(x, 'http'))) = 0 AND " + _some("versions", "rtrim(regexp_replace(x, '^https?', ''), '/') = rtrim(regexp_replace(url, '^https?', ''), '/')") + " END",
    "sitemap-quality": "CASE WHEN sitemap IS NOT NULL THEN len(locs) > 0 AND len(list_filter(locs, lambda x: split_part(x, '/', 3) <> split_part(url, '/', 3) OR (starts_with(url, 'https:') AND starts_with(x, 'http:')))) = 0 AND len(list_distinct(list_transform(locs, lambda x: rtrim(x, '/')))) = len(locs) AND " + _some("locs", "rtrim(regexp_replace(x, '^https?', ''), '/') = rtrim(regexp_replace(url, '^https?', ''), '/')") + " END",
    "robots-sitemap": "regexp_matches(robots, '(?im)^sitemap:')",
}
_GEO = {f"ai-crawler-{b.lower()}": f"NOT regexp_matches(coalesce(robots, ''), '(?i)user-agent: {b}\\ndisallow: /')" for b, role in C.CRAWLERS if role != "training"} | {
    "content-in-html": f"{_words('body')} >= 150", "organisation-schema": _match("lds", '"@type":"(' + "|".join(C.ORGANISATION_TYPES) + ')"'), "question-headings": "len(asked) > 0 OR contains(lds, '\"FAQPage\"')",
    "question-answers": f"CASE WHEN len(asked) > 0 THEN len(list_filter(answers, lambda x: {_words('x')} BETWEEN 20 AND 200)) = len(asked) END", "citable-passage": _some("ps", f"{_words('x')} BETWEEN 40 AND 200"), "llms-txt": "llms IS NOT NULL",
    "freshness-signals": "regexp_matches(html, 'datetime=\"[0-9]{4}') OR regexp_matches(lds, '\"datePublished\":\"[0-9]{4}') OR regexp_matches(coalesce(modified, ''), '[0-9]{4}')",
}
_CONTENT = {
    "cta-present": _some("texts", f"length(x) BETWEEN 1 AND 40 AND {_match('x', C.CTA)}"), "headline-clear": f"{_words('headline')} BETWEEN 3 AND 20", "contact-info": f"{_any_of('hrefs', '^(tel:|mailto:)')} OR {_any_of('hrefs', C.CONTACT_HREF)} OR {_any_of('texts', C.CONTACT_TEXT)}", "trust-signals": _match("body", C.TRUST),
    "navigation": "len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a ')) >= 3", "about-page": f"{_any_of('own_hrefs', C.ABOUT_HREF)} OR {_any_of('own_texts', C.ABOUT_TEXT)}", "policy-pages": f"{_any_of('hrefs', 'privacy')} OR {_any_of('texts', 'privacy')}",
    "content-depth": f"{_words('concat_ws(chr(32), array_to_string(ps, chr(32)), headline, array_to_string(asked, chr(32)))')} >= 300",
    "readability": f"{_words('p')} < 100 OR 206.835 - 1.015 * {_words('p')} / len(regexp_extract_all(p, '[.!?]')) - 84.6 * len(regexp_extract_all(lower(p), '[aeiouy]+')) / {_words('p')} >= 50", "copyright-year": "CAST(regexp_extract(html, '© ([0-9]{4})', 1) AS INT) >= 2023",
}
_MARKETING = {
    "analytics": " OR ".join(_match("scripts", p) for p in C.ANALYTICS), "lead-capture": f"contains(html, 'type=\"email\"') OR {_any_of('hrefs', C.LEAD_SERVICES)}", "offer-clarity": f"{_match('body', C.OFFER)} OR {_any_of('own_hrefs', C.OFFER_LINK)} OR {_any_of('own_texts', C.OFFER_LINK)}",
    "content-hub": f"{_any_of('own_hrefs', C.HUB_HREF)} OR {_any_of('own_texts', C.HUB_TEXT)}", "reviews-markup": f"{_match('lds', '"@type":"(AggregateRating|Review)"')} OR {_match('scripts', C.REVIEW_WIDGET)}", "risk-reversal": _match("body", C.RISK_REVERSAL), "specific-proof": " OR ".join(_match("body", p) for p in C.PROOF),
    "contact-channels": f"CAST({_any_of('hrefs', '^tel:')} AS INT) + CAST({_any_of('hrefs', '^mailto:')} AS INT) + CAST({_any_of('own_hrefs', 'contact|enquir|inquir')} AS INT) + CAST(contains(lds, '\"address\"') AS INT) >= 2",
}
_CITATION = {
    "entity-early": f"contains(lower(list_filter(ps, lambda x: {_words('x')} >= 8)[1]), lower(entity))", "definition": _some(f"list_filter(ps, lambda x: {_words('x')} >= 8)[1:2]", f"{_match('x', T.DEFINING)} AND (contains(lower(x), lower(entity)) OR {_match('x', r'\b(we|our|i|my)\b')})"),
    "answer-passage": f"CASE WHEN {_words('p')} >= 100 THEN " + _some("ps", f"{_words('x')} BETWEEN 134 AND 167") + " END", "structure": f"CASE WHEN {_words('p')} >= 100 THEN NOT (" + _some("ps", f"{_words('x')} > 200") + f" OR ({_words('p')} >= 400 AND len(list_filter(levels, lambda x: x IN (2, 3))) < 2)) END",
    "facts": f"CASE WHEN {_words('p')} >= 100 THEN len(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(concat_ws(chr(32), p, array_to_string(regexp_extract_all(html, '<h[1-6]>([^<]*)</h', 1), chr(32))), '(?i){_quoted(T.FACT)}'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '(?i){_quoted(T.NOT_A_FACT)}')), lambda x: lower(x)))) >= 3 END",
    "schema-fit": f"CASE WHEN len(list_filter(answers, lambda x: {_words('x')} >= 5)) >= 3 THEN contains(lds, '\"FAQPage\"') END", "external-authority": "known",
    "authority": f"CASE WHEN {_words('p')} >= 300 AND contains(lds, '\"Article\"') THEN len(list_distinct(list_filter(list_transform(list_filter(hrefs, lambda x: starts_with(x, 'http')), lambda x: regexp_extract(split_part(x, '/', 3), '[^.]+\\.[^.]+$')), lambda x: NOT list_contains([{', '.join(map(_literal, sorted(U.NOT_EXTERNAL)))}], x)))) >= 2 END",
}
_SOCIAL = {
    "has-profiles": "len(platforms) >= 2", "profile-links-valid": f"NOT ({_any_of('hrefs', '^https?://(www[.])?(facebook|linkedin)[.]com/?$')})", "key-platforms": "len(platforms) > 0", "schema-sameas": _match("lds", '"sameAs":[[]"https://www[.]facebook[.]com/[a-z]'),
    "profiles-reachable": "CASE WHEN answered > 0 THEN missing = 0 END", "profile-activity": "newest <= 180",
}
_SPEED = {"perf-score": "score >= 0.9", "lcp": "lcp <= 2500", "cls": "cls <= 0.1", "tbt": "tbt <= 200", "fcp": "fcp <= 1800"}
_RENDERED = {"render-links": "NOT (r_links >= 8 AND len(list_filter(hrefs, lambda x: starts_with(x, '/'))) < r_links / 2)", "render-schema": "r_ld <= len(ld)", "render-headings": "NOT (h1 = 0 AND r_h1 > 0)", "render-hydration": "r_errors = 0"}


def _verdicts(rules: dict[str, str]) -> str:
    pairs = ", ".join(f"{{'id': '{k}', 'passed': {v}}}" for k, v in rules.items())
    return rf"""
WITH h AS (SELECT * FROM {_woven(_HOMES)}),
f AS (SELECT *, {_READ}, coalesce(regexp_extract_all(sitemap, '<loc>([^<]*)</loc>', 1), []) AS locs FROM h),
g AS (SELECT *, array_to_string(ps, ' ') AS p, list_distinct(list_filter(list_transform(hrefs, lambda x: regexp_extract(x, '^https?://(www[.])?(facebook|linkedin)[.]com/[a-z]', 2)), lambda x: x <> '')) AS platforms,
  coalesce(nullif(regexp_extract(html, 'og:site_name" content="([^"]*)"', 1), ''), nullif(regexp_extract(lds, '"@type":"(?:Bakery|Organization)","name":"([^"]*)"', 1), ''), nullif(title, '')) AS entity FROM f)
SELECT site, u.id AS id, u.passed AS passed FROM (SELECT site, unnest([{pairs}]) AS u FROM g) WHERE u.passed IS NOT NULL"""


def _made(spark: SparkSession, sf_dir: str, rows_: list[dict]) -> DataFrame:
    """The same rows for Spark: a site of one kind for every page."""
    kinds = spark.createDataFrame([tuple(r.values()) for r in rows_], ", ".join(f"{k} {_type(k, rows_)}" for k in rows_[0]))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % len(_SITES)).cast("int").alias("kind"), F.col("page_id").cast("string").alias("n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    every = pages.join(F.broadcast(kinds), "kind")  # a fixed number of kinds
    return every.select(*[F.replace(F.replace(c, F.lit("{n}"), F.col("n")), F.lit("{t}"), F.col("t")).alias(c) if t == "string" else F.col(c) for c, t in kinds.dtypes if c != "kind"])


#: The part of a site's row that a rule reads beside the homepage, its own files and the counts over inner pages.
_PART_OF = {
    "article-authorship": "articles", "robots-sitemap": "robots", "broken-links": "broken", "sitemap": "sitemap", "sitemap-quality": "sitemap", "orphan-pages": "orphans", **{r: "robots" for r in _GEO if r.startswith("ai-crawler-")}, **dict.fromkeys(_CITATION, "citation"),
    **dict.fromkeys(("has-profiles", "profile-links-valid", "key-platforms"), "profiles"),
}


def _outcomes(spark: SparkSession, sf_dir: str, modules: tuple[str, ...], ids) -> DataFrame:
    """site, id, passed of some rules on the sites made of all pages, by the engine; only the parts that they read are worked out."""
    home, inner = _made(spark, sf_dir, _HOMES), _made(spark, sf_dir, _INNER)
    heads = {"x-content-type-options": "xcto", "x-frame-options": "xfo", "referrer-policy": "ref", "strict-transport-security": "hsts", "x-robots-tag": "xrobots", "last-modified": "modified"}
    headers = F.map_filter(F.create_map(*[x for k, c in heads.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    pages = home.select("site", F.lit(0).alias("page_idx"), F.lit(True).alias("is_home"), "url", F.col("url").alias("final_url"), "status", headers.alias("headers"), F.col("html").alias("body"), "truncated")
    pages = pages.unionByName(inner.select("site", F.col("idx").alias("page_idx"), F.lit(False).alias("is_home"), "url", "final_url", F.lit(200).alias("status"), F.col("html").alias("body"), F.lit(False).alias("truncated")), allowMissingColumns=True)
    rendered = F.struct(F.lit(500).alias("words"), F.col("overflow").alias("mobile_overflow"), F.col("r_h1").alias("h1"), F.col("r_links").alias("links"), F.col("r_ld").alias("json_ld"), F.col("r_errors").alias("hydration_errors"))
    probes = F.struct(F.struct(F.col("http_to").alias("final_url"), F.lit(200).alias("status")).alias("http"), F.struct("url", F.col("alt_to").alias("final_url"), F.lit(200).alias("status")).alias("alternate_host"), F.struct(F.col("nf_status").alias("status")).alias("not_found"))
    meta = home.select(
        "site", F.col("robots").alias("robots_txt"), F.col("sitemap").alias("sitemap_xml"), F.col("llms").alias("llms_txt"), F.lit("2024-06-01").cast("timestamp").alias("fetched_at"), rendered.alias("rendered"), probes.alias("probes"), F.col("known").alias("known_source"),
        F.struct("answered", "missing", F.col("newest").alias("newest_days")).alias("reads"), F.struct("score", "lcp", "cls", "tbt", "fcp").alias("speed"),
    )
    broken = home.select("site", F.explode(F.sequence(F.lit(0), F.col("broken"))).alias("k")).where("k > 0").select("site", F.lit("https://x.test/").alias("url"), F.lit(404).alias("status"))
    rules = [r for r in C.rules(modules) if r.id in ids]
    return engine.evaluate(engine.sites(pages, meta, broken, frozenset(_PART_OF[i] for i in ids if i in _PART_OF)), rules).select("site", "id", "passed")


def _type(column: str, rows_: list[dict] | None = None) -> str:
    kinds = {type(r[column]) for r in rows_ or _HOMES} - {type(None)}
    return {str: "string", bool: "boolean", int: "int", float: "double"}[kinds.pop()]


def _only(module: str, rules) -> callable:
    return lambda spark, sf_dir: _outcomes(spark, sf_dir, (module,), rules)


for _module, _rules in (("technical", _TECHNICAL), ("geo", _GEO), ("content", _CONTENT), ("marketing", _MARKETING), ("citation", _CITATION), ("social", _SOCIAL), ("performance", _SPEED)):
    query(_verdicts(_rules), f"rules_{_module}")(_only(_module, _rules))
query(_verdicts(_RENDERED), "rules_rendering")(_only("crawl", _RENDERED))

_ALL_PAGES = f"p AS (SELECT site, 0 AS idx, url, url AS final_url, html FROM {_woven(_HOMES)} UNION ALL SELECT site, idx, url, final_url, html FROM {_woven(_INNER)})"
_AUTHORED = """json_valid(x) AND json_extract_string(CASE WHEN json_valid(x) THEN x END, '$."@type"') = 'Article'"""
_INNER_SQL = rf"""
WITH {_ALL_PAGES}, f AS (SELECT *, {_READ} FROM p),
g AS (SELECT *, idx > 0 AND (title = '' OR EXISTS (SELECT 1 FROM f o WHERE o.site = f.site AND o.final_url <> f.final_url AND lower(o.title) = lower(f.title))) AS bad_title,
  idx > 0 AND (description = '' OR EXISTS (SELECT 1 FROM f o WHERE o.site = f.site AND o.final_url <> f.final_url AND lower(o.description) = lower(f.description))) AS bad_description FROM f),
s AS (SELECT site, NOT bool_or(bad_title) AS titles, NOT bool_or(bad_description) AS descriptions, bool_and(h1 = 1) FILTER (idx > 0) AS h1s, bool_and({_words('body')} >= 100) FILTER (idx > 0) AS contents, bool_and(canonical = final_url) FILTER (idx > 0 AND canonical <> '') AS canonicals,
  bool_and(url = final_url) FILTER (idx > 0) AS moves, count(*) FILTER (idx > 0) AS n, sum(len(list_filter(ld, lambda x: {_AUTHORED}))) AS articles, sum(len(list_filter(ld, lambda x: {_AUTHORED} AND (json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.author') IS NULL OR json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.datePublished') IS NULL)))) AS lacking FROM g GROUP BY site),
loc AS (SELECT site, unnest(regexp_extract_all(sitemap, '<loc>([^<]*)</loc>', 1)) AS loc FROM {_woven(_HOMES)}),
left_over AS (SELECT site, count(*) FILTER (split_part(loc, '/', 3) = site || '.test' AND NOT EXISTS (SELECT 1 FROM f WHERE f.site = loc.site AND (rtrim(split_part(f.url, ':', 2), '/') = rtrim(split_part(loc, ':', 2), '/') OR rtrim(split_part(f.final_url, ':', 2), '/') = rtrim(split_part(loc, ':', 2), '/')
    OR list_contains(list_transform(f.own_hrefs, lambda x: rtrim('https://' || f.site || '.test' || x, '/')), rtrim(loc, '/'))))) AS n FROM loc GROUP BY site)
SELECT site, u.id AS id, u.passed AS passed FROM (SELECT s.site, unnest([{{'id': 'pages-titles', 'passed': CASE WHEN s.n > 0 THEN titles END}}, {{'id': 'pages-descriptions', 'passed': CASE WHEN s.n > 0 THEN descriptions END}}, {{'id': 'pages-h1', 'passed': h1s}}, {{'id': 'pages-content', 'passed': contents}},
  {{'id': 'canonical-consistency', 'passed': canonicals}}, {{'id': 'internal-redirects', 'passed': moves}}, {{'id': 'article-authorship', 'passed': CASE WHEN articles > 0 THEN lacking = 0 END}}, {{'id': 'orphan-pages', 'passed': left_over.n = 0}}]) AS u FROM s LEFT JOIN left_over USING (site)) WHERE u.passed IS NOT NULL"""


@query(_INNER_SQL)
def rules_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that look at several pages of a site, of two modules."""
    wanted = ("pages-titles", "pages-descriptions", "pages-h1", "pages-content", "canonical-consistency", "internal-redirects", "article-authorship", "orphan-pages")
    return _outcomes(spark, sf_dir, ("technical", "crawl"), wanted)
