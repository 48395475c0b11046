"""The rule catalogue and the site engine on small sites made for the purpose."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from auditlake.operators import scoring
from auditlake.plans import catalogue, engine
from auditlake.sources.dom import facts_of

FILLER = " ".join(["We bake fresh bread for small shops in the town and bring it to your door each day."] * 10)
GOOD = f"""<!doctype html><html lang="en"><head><title>Fresh bread for small shops</title><meta name="description" content="{"Fresh bread, baked each night and brought to small shops in the town before seven."}">
<meta name="viewport" content="width=device-width"><link rel="canonical" href="https://www.bakery.test/"><meta property="og:title" content="a"><meta property="og:image" content="b">
<script src="https://plausible.io/js/x.js"></script><script type="application/ld+json">{{"@type":"Organization","name":"Bakery","sameAs":["https://x.com/bakery"],"address":"1 Road","dateModified":"2024-02-01"}}</script></head>
<body><div class="trustpilot"></div><header><a href="/about">About us</a><a href="/contact">Contact</a><a href="/blog/">Blog</a><a href="/privacy">Privacy</a><a href="tel:1">01 234</a><a href="https://facebook.com/bakery">f</a><a href="https://instagram.com/bakery">i</a></header>
<h1>Fresh bread for small shops</h1><p>Bakery is a family business. {FILLER} We serve 40 shops and 12 towns, with 30 years of work.</p><h2>When do you deliver?</h2>
<p>We deliver before seven each morning, from Monday to Saturday, to every shop in the town and to those on the road to the next one.</p><h2>More</h2><p>{FILLER}</p><p>Money-back guarantee. Prices from $3. Trusted by 500 customers.</p>
<form><input type="email" name="email"><textarea></textarea></form><img src="a.png" alt="" width="1" height="1"><footer>© 2024</footer></body></html>"""
HEADERS = {"strict-transport-security": "max-age=1", "x-content-type-options": "nosniff", "x-frame-options": "DENY", "referrer-policy": "same-origin"}
ROBOTS = "User-agent: *\nAllow: /\nSitemap: https://bakery.test/s.xml"
MAP = "<urlset><url><loc>https://bakery.test/</loc></url></urlset>"


def site(spark, changes: dict[str, tuple[str, dict]]):
    """One site for each change: a function of the good page, and columns of the meta row."""
    pages, meta = [], []
    for name, (body, m) in changes.items():
        pages.append((name, 0, True, "https://bakery.test/", m.pop("final_url", "https://bakery.test/"), m.pop("status", 200), m.pop("headers", HEADERS), body, m.pop("truncated", False)))
        meta.append((name, m.get("robots", ROBOTS), m.get("sitemap", MAP), m.get("llms", "# x"), datetime.datetime(2024, 6, 1)))
    p = spark.createDataFrame(pages, "site string, page_idx long, is_home boolean, url string, final_url string, status int, headers map<string,string>, body string, truncated boolean")
    return engine.evaluate(engine.sites(p, spark.createDataFrame(meta, "site string, robots_txt string, sitemap_xml string, llms_txt string, fetched_at timestamp")))


CHANGES = {
    "technical:status-ok": ("", {"status": 500}), "technical:https": ("", {"final_url": "http://bakery.test/"}), "technical:indexable": ("", {"headers": {**HEADERS, "x-robots-tag": "noindex"}}),
    "technical:title": ("<title>Fresh bread for small shops</title>|", {}), "technical:title-length": ("<title>Fresh bread for small shops</title>|<title>x</title>", {}), "technical:single-h1": ("</h1>|</h1><h1>again</h1>", {}),
    "technical:canonical-valid": ("https://www.bakery.test/|https://other.test/", {}), "technical:html-lang": (' lang="en"|', {}), "technical:viewport": ("viewport|port", {}), "technical:image-alt": (' alt=""|', {}),
    "technical:image-dimensions": (' width="1"|', {}), "technical:robots-sitemap": ("", {"robots": "User-agent: *\nAllow: /"}), "technical:sitemap-quality": ("", {"sitemap": "<urlset></urlset>"}), "technical:hsts": ("", {"headers": {}}),
    "technical:json-ld-valid": ('"name":"Bakery",|"name":,', {}), "technical:schema-complete": ('"name":"Bakery",|', {}), "technical:heading-order": ("<h2>More</h2>|<h4>More</h4>", {}), "technical:not-truncated": ("", {"truncated": True}),
    "geo:ai-crawler-googlebot": ("", {"robots": "User-agent: Googlebot\nDisallow: /\nSitemap: https://bakery.test/s.xml"}), "geo:llms-txt": ("", {"llms": None}), "geo:freshness-signals": ("2024-02-01|never", {}), "geo:organisation-schema": ('"Organization"|"Thing"', {}),
    "geo:question-headings": ("When do you deliver?|Delivery", {}), "content:cta-present": ("Contact<|Info<", {}), "content:headline-clear": ("<h1>Fresh bread for small shops</h1>|<h1>Bread</h1>", {}), "content:policy-pages": ('<a href="/privacy">Privacy</a>|', {}),
    "content:copyright-year": ("© 2024|© 2019", {}), "content:about-page": ('<a href="/about">About us</a>|<a href="/x">x</a>', {}), "marketing:analytics": ("plausible.io|example.test", {}), "marketing:content-hub": ('<a href="/blog/">Blog</a>|', {}),
    "marketing:risk-reversal": ("Money-back guarantee. |", {}), "social:has-profiles": ("https://facebook.com/bakery|https://facebook.com/", {}), "social:profile-links-valid": ("https://facebook.com/bakery|https://facebook.com/", {}), "social:schema-sameas": ("https://x.com/bakery|https://y.test/", {}),
    "citation:entity-early": ("Bakery is a family business|This is a family business", {}),
}


@pytest.fixture(scope="module")
def found(spark):
    sites = {"good": (GOOD, {})}
    for rule, (edit, m) in CHANGES.items():
        old, _, new = edit.partition("|")
        assert not old or old in GOOD, rule
        sites[rule] = (GOOD.replace(old, new) if old else GOOD, dict(m))
    out = {}
    for r in site(spark, sites).where("finding is not null").select("site", "finding.id").collect():
        out.setdefault(r["site"], set()).add(r["id"])
    return out


def test_a_sound_site_has_no_findings(found):
    assert found.get("good", set()) == set()


@pytest.mark.parametrize("rule", sorted(CHANGES))
def test_one_change_raises_its_finding(found, rule):
    assert rule in found.get(rule, set())


def test_orphan_pages(spark):
    urls = lambda *paths: "<urlset>" + "".join(f"<url><loc>https://bakery.test{x}</loc></url>" for x in paths) + "</urlset>"
    maps = {
        "linked": urls("/", "/about/", "/deep/b.html"), "orphan": urls("/", "/about", "/lost"), "other-host": urls("/").replace("</urlset>", "<url><loc>https://other.test/lost</loc></url></urlset>"), "none": None,
        "index": urls("/lost").replace("urlset", "sitemapindex"), "large": urls(*[f"/{i}" for i in range(61)]), "capped": urls("/lost"), "alone": urls("/", "/lost"),
    }
    page = lambda s, i, path, body: (s, i, i == 0, f"https://bakery.test{path}", f"https://www.bakery.test{path}", 200, body)
    pages = [page(s, 0, "/", GOOD) for s in maps] + [page(s, 1, "/deep/a", "<a class=x href='b.html'>b</a>") for s in maps if s != "alone"] + [page("capped", i, f"/p{i}", "x") for i in range(2, 11)]
    p = spark.createDataFrame(pages, "site string, page_idx long, is_home boolean, url string, final_url string, status int, body string")
    rows = engine.sites(p, spark.createDataFrame(list(maps.items()), "site string, sitemap_xml string"), parts=frozenset({"orphans"})).persist()
    assert {r["site"]: r["orphans"] for r in rows.select("site", "crawl.orphans").collect()} == {"linked": 0, "orphan": 1, "other-host": 0, "none": None, "index": None, "large": 61, "capped": 1, "alone": 1}
    outcomes = engine.evaluate(rows, [r for r in catalogue.rules() if r.id == "orphan-pages"]).select("site", "passed", "finding.id").collect()
    assert {r["site"]: (r["passed"], r["id"]) for r in outcomes} == {"linked": (True, None), "orphan": (False, "crawl:orphan-pages"), "other-host": (True, None), **{s: (False, "crawl:orphan-pages") for s in ("alone", "large", "capped")}}


def test_weights(spark):
    always = [r for r in catalogue.rules() if r.applies is None]
    total = lambda m: sum(r.weight for r in always if r.module == m)
    assert (total("technical"), total("content"), total("marketing")) == (100, 80, 70)
    assert sum(r.weight for r in catalogue.geo() if r.id != "question-answers") == 100
    assert len(catalogue.technical()) == 38 and sum(w for w, _ in scoring.READINESS.values()) == 100
    assert len({(r.module, r.id) for r in catalogue.rules()}) == len(catalogue.rules())


def test_the_rubric_lists_every_rule_and_question(spark):
    from auditlake.queries.page_rule_queries import RULES

    assert [(m, i, int(w), v) for m, i, w, v in RULES] == [(r.module, r.id, r.weight, r.severity) for r in catalogue.rules()]
    table = catalogue.rubric(spark).collect()
    assert len(table) == len(RULES) + 10 and len({(r["module"], r["id"]) for r in table}) == len(table) and len({r["check_ord"] for r in table}) == len(table)
    ai = {m: sum(r["weight"] for r in table if r["module"] == m and r["kind"] == "review") for m in ("content", "marketing")}
    assert ai == {"content": 20, "marketing": 30}


def test_broken_pages_fail_no_job(spark):
    o = site(spark, {"junk": ("<<<>>><p><b></i></table><script>", {}), "none": ("", {})})
    assert o.groupBy("site").count().count() == 2


def test_long_pages_are_read_whole_and_cut_only_where_asked(spark):
    """A page whose byte 2,000,000 lies inside a character, and one of 5 MB."""
    from auditlake.functions.text import word_count
    from auditlake.sources.html import MOST_BYTES, capped, parsed

    inside = "<title>x</title>" + "a" * 1_999_983 + "\u00e9" * 20
    assert inside.encode()[MOST_BYTES - 1 : MOST_BYTES + 1] == "\u00e9".encode()
    long = "<title>long</title><p>" + "word \U0001f600 " * 500_000 + "</p><h1>last</h1>"
    pages = spark.createDataFrame([(1, "https://a.test/", inside), (2, "https://b.test/", long), (3, "https://c.test/", None), (4, "https://d.test/", "\u00e9")], "page_id long, url string, html string")
    facts = {r["page_id"]: r for r in parsed(pages).select("page_id", "dom.error", "dom.h1", word_count(F.col("dom.text")).alias("words")).collect()}
    assert all(r["error"] is None for r in facts.values())
    assert (facts[1]["words"], facts[2]["words"], facts[2]["h1"]) == (1, 1_000_001, 1)
    cut = {r["page_id"]: (r["t"] or "") for r in pages.select("page_id", capped(F.col("html")).alias("t")).collect()}
    assert cut[1] == inside.encode()[:MOST_BYTES].decode(errors="replace") and cut[4] == "\u00e9"
    assert len(cut[2].encode()) <= MOST_BYTES + 2 and cut[2] == long.encode()[:MOST_BYTES].decode(errors="replace")
    rows = engine.page_responses(pages).select("page_idx", "truncated").collect()
    assert {r["page_idx"] for r in rows if r["truncated"]} == {1, 2}
    assert engine.evaluate(engine.sites(engine.page_responses(pages), parts=frozenset())).where("id = 'not-truncated' and not passed").count() == 2


def test_html_recovery():
    f = facts_of("https://x.test/a/", "<p>one<p>two<ul><li>a<li>b</ul></div>end<table><tr><td>1<td>2</table>")
    assert f["paragraphs"] == ["one", "two"] and f["text"] == "onetwoabend12"


def test_scores_of_outcomes(spark):
    rows = [(1, "geo", 10, True, None), (1, "geo", 10, False, 0.5), (1, "geo", 5, False, 7.0), (2, "geo", 4, False, None)]
    o = spark.createDataFrame(rows, "site long, module string, weight int, passed boolean, credit double").withColumn("finding", F.lit(None).cast("string"))
    assert {r["site"]: r["score"] for r in scoring.module_scores(o).collect()} == {1: 80, 2: 0}


def test_kit_texts_are_escaped_for_their_places(spark):
    from auditlake.operators import kit

    sites = spark.createDataFrame([("a.test", "https://a.test/?x=1&y=2", '</script><b>"Bread" & rolls', "It's <good>"), ("b.test", "https://b.test/", None, None)], "site string, url string, title string, description string")
    pages = spark.createDataFrame([("a.test", k, f"https://a.test/p{k}", "[x](y)" if k else "") for k in range(12)], "site string, ord int, url string, title string")
    got = {(r["site"], r["item"]): r["content"] for r in kit.texts(sites, pages).collect()}
    assert len(got) == 16
    assert got["a.test", "canonical"] == '<link rel="canonical" href="https://a.test/?x=1&amp;y=2">'
    assert "</script>" not in got["a.test", "organization"] and "&lt;/script&gt;" in got["a.test", "head"] and "&apos;s &lt;good&gt;" in got["a.test", "open-graph"]
    assert got["a.test", "sitemap.xml"].count("<loc>") == 11 and "\\[x\\]" in got["a.test", "llms.txt"] and "## Pages" not in got["b.test", "llms.txt"]
    assert got["b.test", "head"].startswith("<title>b.test</title>\n<meta name=\"viewport\"")
    found = spark.createDataFrame([("a.test", "technical:canonical"), ("b.test", "geo:llms-txt"), ("b.test", "no:such")], "site string, id string")
    assert {(r["site"], r["item"]) for r in kit.called_for(kit.texts(sites, pages), found).collect()} == {("a.test", "canonical"), ("b.test", "llms.txt")}


def test_evidence_names_the_first_pages_in_order(spark):
    page = lambda s, i, title, h1=1, body="": (s, i, i == 0, f"https://{s}.test/{i or ''}", f"https://{s}.test/{i or ''}", 200, f"<title>{title}</title>" + "<h1>x</h1>" * h1 + body)
    many = [page("a", i, "Same" if i % 2 else f"Own {i}", 0) for i in range(40)]
    rows = many + [page("b", 0, "Home"), page("b", 1, "One", body="<p>" + "word " * 120), page("c", 0, "Alone")]
    p = spark.createDataFrame(rows, "site string, page_idx long, is_home boolean, url string, final_url string, status int, body string").repartition(7)
    broken = spark.createDataFrame([("b", f"https://b.test/x{i:02}", 404) for i in range(20)], "site string, url string, status int")
    found = {(r["site"], r["id"]): [e["url"].rsplit("/", 1)[1] for e in r["finding"]["evidence"]] for r in engine.evaluate(engine.sites(p, None, broken)).where("finding is not null").collect()}
    assert found["a", "pages-titles"] == [str(i) for i in (1, 3, 5, 7, 9, 11)] and found["a", "pages-h1"] == [str(i) for i in range(1, 7)] and found["a", "pages-content"] == found["a", "pages-h1"]
    assert found["b", "broken-links"] == [f"x{i:02}" for i in range(8)] and ("b", "pages-titles") not in found and ("b", "pages-h1") not in found and ("c", "pages-titles") not in found
    assert found["c", "title-length"] == [""]


def test_missing_markup_is_made_from_what_a_page_states(spark):
    import json

    from auditlake.operators import snippets
    from auditlake.sources.html import parsed

    words = "word " * 320
    pages = [
        ("a", False, "https://a.test/blog/x", f'<meta name="author" content=" Ann  Lee "><meta property="og:image" content="i.png"><article><h1>{"T" * 200}</h1><time datetime="2024-02-03">x</time><p>{words}</p></article>'), ("a", True, "https://a.test/", f"<article><h1>Home</h1><p>{words}</p></article>"),
        ("b", False, "https://b.test/p", '<meta name="description" content="Nice"><meta property="product:price:amount" content="9.5"><meta property="product:price:currency" content="EUR"><h1>Mug</h1>$9.50 <button>Add to cart</button>'), ("b", False, "https://b.test/list", "<h1>All</h1>" + "".join(f"${i}.00 <button>Buy now</button>" for i in range(6))),
        ("c", True, "https://c.test/", "".join(f"<h2>Is it {i}?</h2><p>Yes it is number {i} today</p>" for i in range(12))), ("c", False, "https://c.test/q", "<h2>Why?</h2><p>Too short</p>" * 4), ("d", True, "https://d.test/", "<<<"),
    ]
    df = parsed(spark.createDataFrame(pages, "site string, is_home boolean, final_url string, body string"), "final_url", "body").withColumn("entity", F.when(F.col("site") == "a", "Acme"))
    got = {(r["url"], r["type"]): json.loads(r["snippet"]) for r in snippets.schema_gaps(df).collect()}
    assert set(got) == {("https://a.test/blog/x", "Article"), ("https://b.test/p", "Product"), ("https://c.test/", "FAQPage")}
    article = got["https://a.test/blog/x", "Article"]
    assert article["author"] == {"@type": "Person", "name": "Ann Lee"} and article["datePublished"] == "2024-02-03" and article["publisher"]["name"] == "Acme" and len(article["headline"]) == 110 and article["image"] == "i.png"
    assert got["https://b.test/p", "Product"]["offers"] == {"@type": "Offer", "price": "9.5", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}
    assert len(got["https://c.test/", "FAQPage"]["mainEntity"]) == 10
    assert snippets.faq_pairs(df).where("site = 'c'").count() == 12
