"""From pages to outcomes: one row per site, all rules in one projection, no site ever collected into a list.

    pages -> parse (one Arrow pass) -> homepage row + counts over inner pages -> inline(array of rules) -> outcomes

Inner pages are only counted, so a site with a third of all pages costs partial aggregates, not one large row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..sources import robots
from ..sources.html import MOST_BYTES, parsed
from ..storage import Stash
from . import catalogue as C

PAGE = {"site": "string", "page_idx": "long", "is_home": "boolean", "url": "string", "final_url": "string", "status": "int", "headers": "map<string,string>", "body": "string", "truncated": "boolean"}
RENDERED = "struct<words:int,mobile_overflow:boolean,h1:int,links:int,json_ld:int,hydration_errors:int>"
PROBES = "struct<http:struct<final_url:string,status:int>,alternate_host:struct<url:string,final_url:string,status:int>,not_found:struct<status:int>>"
EVIDENCE = "map<string,array<struct<url:string,note:string>>>"
META = {
    "site": "string", "robots_txt": "string", "sitemap_xml": "string", "llms_txt": "string", "fetched_at": "timestamp", "rendered": RENDERED, "probes": PROBES, "known_source": "boolean",
    "reads": "struct<answered:int,missing:int,newest_days:int>", "speed": "struct<score:double,lcp:double,cls:double,tbt:double,fcp:double>",
}


def completed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the listed columns, nulls of the right type where it lacks one."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def page_responses(pages: DataFrame) -> DataFrame:
    """The pages table as responses: the host is the site, its least page the homepage.

    The table holds no status and no headers: every page counts as answered with 200 and none, so the rules on
    headers fail and the one on the status passes. A page over the size limit is marked as cut.
    """
    site = U.bare_host(F.col("url"))
    first = pages.groupBy(site.alias("site")).agg(F.min("page_id").alias("home"))
    rows = pages.withColumn("site", site).join(first, "site")
    return completed(rows.select("site", F.col("page_id").alias("page_idx"), (F.col("page_id") == F.col("home")).alias("is_home"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.col("html").alias("body"), (F.octet_length("html") > MOST_BYTES).alias("truncated")), PAGE)


def _bad_values(pages: DataFrame, value: str, name: str) -> DataFrame:
    """Inner pages per site whose value is empty or also on another address. By grouping, without a join."""
    keyed = pages.select("site", "is_home", "final_url", F.lower(F.col(value)).alias("key"))
    groups = keyed.groupBy("site", "key").agg(F.count_if(~F.col("is_home")).alias("n"), F.min("final_url").alias("lo"), F.max("final_url").alias("hi"))
    bad = F.when((F.col("key") == "") | (F.col("lo") != F.col("hi")), F.col("n")).otherwise(0)
    return groups.groupBy("site").agg(F.sum(bad).alias(name))


def citation_states(pages: DataFrame) -> DataFrame:
    """Per page and criterion: 1 pass, 0.5 partial, 0 fail, null where it does not apply."""
    dom = F.col("dom")
    paragraphs = dom["main_paragraphs"]
    entity = F.lower(F.col("entity"))
    sizes = F.transform(paragraphs, T.word_count)
    words, home = T.word_count(dom["main_text"]), F.col("is_home")
    prose = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    substantive = F.filter(paragraphs, lambda p: T.word_count(p) >= 8)
    names = lambda s: F.coalesce(F.contains(F.lower(s), entity), F.lit(False))
    defines = lambda s: C.has(s, T.DEFINING) & (names(s) | C.has(s, r"\b(we|our|i|my)\b"))
    judged, essay = words >= 100, (words >= 100) & (prose >= 100)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    between = lambda lo, hi: F.exists(sizes, lambda n: n.between(lo, hi))
    sections = F.size(F.filter(dom["headings"], lambda h: h["level"].isin(2, 3)))
    questions = F.filter(dom["headings"], lambda h: h["level"].between(2, 4) & h["text"].endswith("?") & (h["next_tag"] == "p") & (F.size(F.split(h["next_text"], " ")) >= 5))
    types = dom["schema_types"]
    faq = F.size(questions) >= 3
    path = U.path(F.col("final_url"))
    og_article = F.exists(dom["metas"], lambda m: (m["property"] == "og:type") & (m["content"] == "article"))
    article = ~home & (dom["article_tags"] > 0) & (words >= 300) & (C.has(path, r"^/(blog|news|articles?|insights|journal|guides?|posts?)\b") | F.coalesce(og_article, F.lit(False)) | dom["dated"])
    product = ~home & F.size(dom["prices"]).between(1, 4) & dom["buy_buttons"].between(1, 2) & (dom["h1_text"] != "")
    overlap = lambda *t: F.arrays_overlap(types, F.array(*map(F.lit, t)))
    gap = (faq & ~overlap("FAQPage", "QAPage")) | (article & ~overlap("Article", "NewsArticle", "BlogPosting", "TechArticle")) | (product & ~overlap("Product"))
    vague = F.aggregate(F.transform(paragraphs, T.vague_terms), F.lit(0).cast("long"), lambda a, x: a + x)
    facts = T.facts(F.array_join(F.concat(paragraphs, F.transform(dom["headings"], lambda h: h["text"])), " "))
    external = F.array_distinct(F.filter(F.transform(F.filter(dom["anchors"], lambda a: a["host"].isNotNull()), lambda a: U.registrable(a["host"])), lambda d: (d != U.registrable(U.host(F.col("final_url")))) & ~d.isin(U.NOT_EXTERNAL)))
    article_like = dom["article_tags"].between(1, 2) | F.exists(types, lambda t: t.rlike("Article|BlogPosting"))
    states = {
        "entity-early": F.when(home & F.col("entity").isNotNull(), yes(names(F.get(substantive, F.lit(0))))),
        "definition": F.when(home, yes(F.exists(F.slice(substantive, 1, 2), lambda p: F.exists(T.sentences(p), defines)))),
        "answer-passage": F.when(essay, F.when(between(134, 167), 1.0).when(between(40, 200), 0.5).otherwise(0.0)),
        "facts": F.when(essay & home, yes(F.size(facts) >= 3)),
        "structure": F.when(essay, yes(~(F.exists(sizes, lambda n: n > 200) | ((prose >= 400) & (sections < 2))))),
        "clarity": F.when(judged, yes((vague < 3) & (F.size(T.undefined_acronyms(F.array_join(paragraphs, " "))) < 2))),
        "schema-fit": F.when(faq | article | product, yes(~gap)),
        "authority": F.when((words >= 300) & article_like, yes(F.size(external) >= 2)),
    }
    return pages.select("site", "page_idx", "is_home", "final_url", *[v.cast("double").alias(k) for k, v in states.items()])


def page_scores(states: DataFrame) -> DataFrame:
    """Each page's citation score: earned over possible weight of the criteria that apply."""
    total, earned = F.lit(0.0), F.lit(0.0)
    for k, w in C.CITATION_WEIGHTS.items():
        if k in states.columns:
            total = total + F.when(F.col(f"`{k}`").isNotNull(), float(w)).otherwise(0.0)
            earned = earned + F.coalesce(F.col(f"`{k}`") * w, F.lit(0.0))
    return states.withColumn("score", T.js_round(F.try_divide(earned * 100, F.nullif(total, F.lit(0.0)))))


PARTS = frozenset({"articles", "citation", "robots", "broken", "profiles", "sitemap", "orphans", "evidence"})
# How many pages a finding names at most, by rule.
MOST_EVIDENCE = {
    **dict.fromkeys(("technical:article-authorship", "technical:pages-titles", "technical:pages-descriptions", "technical:pages-h1", "technical:pages-content"), 6), "technical:broken-links": 8, "crawl:canonical-consistency": 4,
    **dict.fromkeys(("crawl:orphan-pages", "crawl:internal-redirects"), 5), **{f"citation:{k}": 3 for k in C.CITATION_WEIGHTS if k != "external-authority"},
}


def first_rows(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their place ``n``. Tasks keep no more than that of each group before the shuffle."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most)


def _shared_values(pages: DataFrame, value: str, rule: str, what: str) -> DataFrame:
    """Evidence rows of inner pages whose value is empty or also on another address: the first ones of each value are enough."""
    keyed = pages.select("site", "page_idx", "is_home", "final_url", F.lower(F.col(value)).alias("key"))
    groups = keyed.groupBy("site", "key").agg((F.min("final_url") != F.max("final_url")).alias("shared")).where(F.col("shared") | (F.col("key") == ""))
    first = first_rows(keyed.where("not is_home"), ["site", "key"], ["page_idx", "final_url"], MOST_EVIDENCE[rule])
    note = F.when(F.col("key") == "", f"has no {what}").otherwise(F.concat(F.lit(f"shares its {what}: "), F.substring("key", 1, 100)))
    return first.join(groups, ["site", "key"]).select("site", F.lit(rule).alias("rule"), F.col("page_idx").alias("ord"), F.col("final_url").alias("url"), note.alias("note"))


def page_evidence(pages: DataFrame, states: DataFrame, broken: DataFrame | None = None, orphans: DataFrame | None = None) -> DataFrame:
    """site, evidence: map from a rule's id to the first pages that fail it, in page order, with a note each.

    pages: parsed, with description and title_key; states: as citation_states has them; broken: site, url, status; orphans:
    site, ord, url. All are cut to a rule's number by site before they are gathered, so no list grows with a site.
    """
    dom, words = F.col("dom"), T.word_count(F.col("dom.text"))
    lacking = F.size(F.filter(dom["articles"], lambda a: ~a["author"] | ~a["date"]))
    canonical = C.canonical()
    elsewhere = C._truthy(canonical) & F.coalesce(U.crawl_key(C.absolute(canonical, F.col("final_url"))) != U.crawl_key(F.col("final_url")), F.lit(False))
    inner = ~F.col("is_home")
    tests = {
        "technical:pages-h1": (inner & (dom["h1"] != 1), F.format_string("%d main headings", dom["h1"])), "technical:pages-content": (inner & (words < 100), F.format_string("%d words of text", words)),
        "technical:article-authorship": (lacking > 0, F.format_string("%d articles without an author or a date", lacking)), "crawl:canonical-consistency": (inner & elsewhere, F.concat(F.lit("its canonical link names "), F.substring(canonical, 1, 120))),
        "crawl:internal-redirects": (inner & (U.crawl_key(F.col("url")) != U.crawl_key(F.col("final_url"))), F.concat(F.lit("redirects to "), F.substring("final_url", 1, 120))),
    }
    failing = lambda own: F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), F.when(bad, note).alias("note")) for k, (bad, note) in own.items()]), lambda x: x["note"].isNotNull())
    own = pages.select("site", F.col("page_idx").alias("ord"), F.col("final_url").alias("url"), F.explode(failing(tests)).alias("f"))
    keys = [k for k in C.CITATION_WEIGHTS if k in states.columns]
    by_state = {f"citation:{k}": ((F.col(f"`{k}`") == 0) & (~F.col("is_home") if k == "answer-passage" else F.lit(True)), F.lit("this page does not meet it")) for k in keys}
    cited = states.select("site", F.col("page_idx").alias("ord"), F.col("final_url").alias("url"), F.explode(failing(by_state)).alias("f"))
    rows = own.unionByName(cited).select("site", "f.rule", "ord", "url", "f.note")
    rows = rows.unionByName(_shared_values(pages, "title_key", "technical:pages-titles", "title")).unionByName(_shared_values(pages, "description", "technical:pages-descriptions", "description"))
    if broken is not None:
        rows = rows.unionByName(broken.select("site", F.lit("technical:broken-links").alias("rule"), F.lit(0).cast("long").alias("ord"), "url", F.format_string("answered with %d", F.col("status")).alias("note")))
    if orphans is not None:
        rows = rows.unionByName(orphans.select("site", F.lit("crawl:orphan-pages").alias("rule"), F.col("ord").cast("long").alias("ord"), "url", F.lit("listed in the sitemap, linked from no page").alias("note")))
    cap = F.element_at(F.create_map(*[x for k, n in MOST_EVIDENCE.items() for x in (F.lit(k), F.lit(n))]), F.col("rule"))
    kept = first_rows(rows, ["site", "rule"], ["ord", "url"], max(MOST_EVIDENCE.values())).where(F.col("n") <= cap)
    lists = kept.groupBy("site", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url", "note"))), lambda x: F.struct(x["url"].alias("url"), x["note"].alias("note"))).alias("pages"))
    return lists.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("rule", "pages"))).alias("evidence"))  # one entry a rule


def sites(pages: DataFrame, meta: DataFrame | None = None, broken: DataFrame | None = None, parts: frozenset[str] = PARTS) -> DataFrame:
    """One row per site for the rules. pages as PAGE, meta as META (both may lack columns), broken: site, url, status.

    parts: what beside the homepage and the counts is worked out; a part left out is null or empty.
    """
    spark = pages.sparkSession
    p = parsed(completed(pages, PAGE), "final_url", "body").drop("body")
    p = p.withColumn("description", F.coalesce(F.trim(F.regexp_replace(F.coalesce(C.meta("name", "description"), F.lit("")), r"\s+", " ")), F.lit("")))
    p = p.withColumn("title_key", F.when(F.col("is_home"), F.col("dom.title")).otherwise(F.col("dom.title_line")))
    # Parsed once, read by several aggregates: a Python stage would run again for each.
    p = Stash(spark).put(p)
    home = p.where("is_home")
    inner = p.where("not is_home")
    counts = inner.groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(F.col("dom.h1") != 1).alias("bad_h1"), F.count_if(T.word_count(F.col("dom.text")) < 100).alias("thin"),
        F.count_if(U.crawl_key(F.col("url")) != U.crawl_key(F.col("final_url"))).alias("redirected"),
        F.count_if(C._truthy(C.canonical())).alias("canonicals"),
        F.count_if(C._truthy(C.canonical()) & F.coalesce(U.crawl_key(C.absolute(C.canonical(), F.col("final_url"))) != U.crawl_key(F.col("final_url")), F.lit(False))).alias("bad_canonicals"),
    )
    counts = counts.join(_bad_values(p, "title_key", "bad_titles"), "site", "left").join(_bad_values(p, "description", "bad_descriptions"), "site", "left")
    inner_struct = counts.select("site", F.struct("n", "bad_h1", "thin", "bad_titles", "bad_descriptions").alias("inner"), F.struct("n", "canonicals", "bad_canonicals", "redirected").alias("pages_crawl"))
    m = completed(meta if meta is not None else spark.createDataFrame([], "site string"), META)
    row = home.join(m, "site", "left").join(inner_struct, "site", "left")

    made: dict[str, DataFrame] = {}

    def articles() -> DataFrame:
        lacking = F.sum(F.size(F.filter("dom.articles", lambda a: ~a["author"] | ~a["date"])))
        return p.groupBy("site").agg(F.struct(F.sum(F.size("dom.articles")).alias("n"), lacking.alias("lacking")).alias("articles"))

    def states() -> DataFrame:
        if "states" not in made:
            made["states"] = Stash(spark).put(citation_states(p.join(home.select("site", F.col("dom.entity").alias("entity")), "site", "left")))
        return made["states"]

    def citation() -> DataFrame:
        keys = [k for k in C.CITATION_WEIGHTS if k != "external-authority"]
        shares = states().groupBy("site").agg(*[F.struct(F.avg(f"`{k}`").alias("share"), F.count_if((F.col(f"`{k}`") == 0) & ~F.col("is_home")).alias("inner_fails")).alias(k) for k in keys])
        return shares.select("site", F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"`{k}`"))]).alias("citation"))

    def robots_part() -> DataFrame:
        found = robots.parse(m)
        wanted = home.select("site", F.explode(F.array(*[F.lit(b) for b, _ in C.CRAWLERS])).alias("agent"), U.path(F.col("final_url")).alias("path"))
        allowed = robots.decide(found, wanted).groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("agent", "allowed"))).alias("allowed"))
        maps = found.where("kind = 'sitemap'").groupBy("site").agg(F.count("*").cast("int").alias("robots_sitemaps"))
        return allowed.join(maps, "site", "left")

    def broken_part() -> DataFrame:
        return (broken if broken is not None else spark.createDataFrame([], "site string, url string, status int")).groupBy("site").agg(F.count("*").alias("n_broken"))

    def profiles() -> DataFrame:
        found = home.select("site", F.explode_outer("dom.anchors").alias("a"), "final_url").select("site", T.once(C.absolute(F.col("a.href"), F.col("final_url")), U.social_profile).alias("s"))
        return found.groupBy("site").agg(F.struct(F.collect_set(F.when(F.col("s.kind") == "profile", F.col("s.platform"))).alias("platforms"), F.count_if(F.col("s.kind") == "homepage").alias("homepages")).alias("profiles"))

    def sitemap() -> DataFrame:
        return home.select("site", "final_url").join(m.select("site", "sitemap_xml"), "site").select("site", sitemap_facts(F.col("sitemap_xml"), F.col("final_url")).alias("sitemap"))

    def orphans() -> DataFrame:
        """Sitemap pages of the site's own host that were not read and that no page links to.

        All pages of a site are at hand, so its link graph is whole whatever its size; only an index that was not
        expanded, or a sitemap without locations, tells nothing, and has no row.
        """
        judgeable, left = unlinked()
        counted = left.select("site", "k").groupBy("site").agg(F.count("*").alias("n_left"))
        return judgeable.select("site").join(counted, "site", "left").select("site", F.coalesce("n_left", F.lit(0)).cast("long").alias("orphans"))

    def evidence() -> DataFrame:
        lost = unlinked()[1].select("site", F.col("pos").alias("ord"), F.col("loc").alias("url")) if "orphans" in parts else None
        return page_evidence(p, states(), broken, lost)

    def unlinked() -> tuple[DataFrame, DataFrame]:
        """(sites that can be judged, their locations that no page links to)."""
        if "unlinked" in made:
            return made["judgeable"], made["unlinked"]
        locs = sitemap_locs(F.col("sitemap_xml"))
        judgeable = home.select("site", U.bare_host(F.col("final_url")).alias("own")).join(m.where(~is_index(F.col("sitemap_xml"))).select("site", locs.alias("locs")), "site").where(F.size("locs") > 0)
        listed = judgeable.select("site", "own", F.posexplode("locs").alias("pos", "loc")).select("site", "own", "pos", "loc", U.crawl_key(F.col("loc")).alias("k")).where(F.split_part("k", F.lit("/"), F.lit(1)) == F.col("own"))
        judged = p.join(judgeable.select("site"), "site", "left_semi")
        anchors = judged.select("site", F.explode("dom.anchors").alias("a")).where(F.col("a.host").isNotNull())
        linked = anchors.select("site", U.crawl_key(F.concat(F.col("a.scheme"), F.lit("://"), F.col("a.host"), F.col("a.path"))).alias("k")).distinct()
        read = judged.select("site", F.explode(F.array(U.crawl_key(F.col("url")), U.crawl_key(F.col("final_url")))).alias("k")).distinct()
        made["judgeable"] = judgeable
        made["unlinked"] = Stash(spark).put(listed.join(linked, ["site", "k"], "left_anti").join(read, ["site", "k"], "left_anti").select("site", "k", "pos", "loc"))
        return made["judgeable"], made["unlinked"]

    for name, make, columns in (
        ("articles", articles, {"articles": "struct<n:long,lacking:long>"}), ("citation", citation, {"citation": "map<string,struct<share:double,inner_fails:long>>"}),
        ("robots", robots_part, {"allowed": "map<string,boolean>", "robots_sitemaps": "int"}), ("broken", broken_part, {"n_broken": "long"}),
        ("profiles", profiles, {"profiles": "struct<platforms:array<string>,homepages:long>"}), ("sitemap", sitemap, {"sitemap": "struct<is_index:boolean,urls:int,n_issues:int>"}),
        ("orphans", orphans, {"orphans": "long"}), ("evidence", evidence, {"evidence": EVIDENCE}),
    ):
        row = row.join(make(), "site", "left") if name in parts else row.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})
    # Written, for the rules' expressions on top of all these joins would make one plan that takes minutes to optimise.
    return Stash(spark).put(row.select(
        "site", "final_url", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "dom", "robots_txt",
        F.coalesce("robots_sitemaps", F.lit(0)).alias("robots_sitemaps"), F.coalesce("allowed", F.create_map().cast("map<string,boolean>")).alias("allowed"), "sitemap", "llms_txt",
        F.year(F.coalesce("fetched_at", F.lit("2024-01-01").cast("timestamp"))).alias("fetched_year"), "rendered", "probes", F.coalesce("n_broken", F.lit(0)).alias("n_broken"),
        F.coalesce("inner", F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "bad_h1", "thin", "bad_titles", "bad_descriptions")])).alias("inner"), "articles", F.struct("pages_crawl.n", "pages_crawl.canonicals", "pages_crawl.bad_canonicals", "pages_crawl.redirected", "orphans").alias("crawl"), "citation", "known_source",
        "profiles", "reads", "speed", "evidence",
    ))


def sitemap_locs(xml: Column) -> Column:
    return F.filter(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda x: x != "")


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def sitemap_facts(xml: Column, url: Column) -> Column:
    """struct<is_index, urls, n_issues>; null without a sitemap."""
    locs = sitemap_locs(xml)
    keys = F.transform(locs, U.table_key)
    issues = F.when(F.size(locs) == 0, 1).otherwise(
        F.exists(locs, lambda x: F.coalesce(U.bare_host(x), F.lit("")) != U.bare_host(url)).cast("int") + (url.startswith("https://") & F.exists(locs, lambda x: x.startswith("http://"))).cast("int")
        + (F.size(F.array_distinct(keys)) < F.size(keys)).cast("int") + (~F.array_contains(keys, U.table_key(url))).cast("int") + (F.size(locs) > 50_000).cast("int")
    )
    return F.when(xml.isNotNull(), F.struct(is_index(xml).alias("is_index"), F.size(locs).alias("urls"), issues.alias("n_issues")))


def evaluate(site_rows: DataFrame, rules: list[C.Rule] | None = None) -> DataFrame:
    """site, module, module_ord, check_ord, id, weight, passed, credit, finding: every rule that applies.

    All rules are one ``inline`` over an array of structs: a single projection whatever their number. A rule that
    comes out null (its part could not be read) does not apply.
    """
    out = []
    named = F.col("evidence") if "evidence" in site_rows.columns else F.lit(None).cast(EVIDENCE)
    for k, r in enumerate(rules if rules is not None else C.rules()):
        passed = r.passed if r.applies is None else F.when(r.applies, r.passed)
        fails = ~F.coalesce(passed, F.lit(True)) & (r.finds if r.finds is not None else F.lit(True))
        finding = F.struct(
            F.lit(f"{r.module}:{r.id}").alias("id"), F.lit(r.module).alias("module"), (r.severity_of if r.severity_of is not None else F.lit(r.severity)).alias("severity"), F.lit(r.effort).alias("effort"), F.lit(r.title).alias("title"), F.lit(r.fix).alias("fix"),
            F.coalesce(F.try_element_at(named, F.lit(f"{r.module}:{r.id}")), F.array(F.struct(F.col("final_url").alias("url"), (r.note if r.note is not None else F.lit(r.title)).alias("note")))).alias("evidence"),
        )
        out.append(F.struct(
            F.lit(r.module).alias("module"), F.lit(C.MODULES.index(r.module)).alias("module_ord"), F.lit(k).alias("check_ord"), F.lit(r.id).alias("id"), F.lit(r.weight).alias("weight"), passed.alias("passed"),
            (r.credit if r.credit is not None else F.lit(None)).cast("double").alias("credit"), F.when(fails, finding).alias("finding"),
        ))
    return site_rows.where(F.col("dom.error").isNull()).select("site", F.inline(F.array(*out))).where("passed is not null")
