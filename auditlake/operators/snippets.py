"""Structured data that pages call for: question pairs found on them, and the JSON-LD that is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..plans import catalogue as C

MOST_PAIRS = 10
# The types that count as an article's, and the paths of articles.
ARTICLES = ("Article", "NewsArticle", "BlogPosting", "TechArticle")
ARTICLE_PATH = r"^/(blog|news|articles?|insights|journal|guides?|posts?)\b"


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def pairs(dom: Column) -> Column:
    """array<struct<q, a>>: headings that ask, each with the paragraph under it, if that has five words or more."""
    asked = F.filter(dom["headings"], lambda h: h["level"].between(2, 4) & h["text"].endswith("?") & (h["next_tag"] == "p") & (F.size(F.split(h["next_text"], " ")) >= 5))
    return F.transform(asked, lambda h: F.struct(h["text"].alias("q"), h["next_text"].alias("a")))


def faq_pairs(pages: DataFrame) -> DataFrame:
    """site, url, place, q, a of parsed pages."""
    return pages.select("site", F.col("final_url").alias("url"), F.posexplode(pairs(F.col("dom"))).alias("p", "x")).select("site", "url", (F.col("p") + 1).cast("long").alias("place"), "x.q", "x.a")


def schema_gaps(pages: DataFrame) -> DataFrame:
    """site, url, type, why, snippet: what a page's content calls for and its markup lacks, one of each type a page.

    pages: parsed, with site, is_home, final_url and entity (may be null). A snippet states only what the page states;
    fields without a value are left out, and a price is never guessed.
    """
    dom = F.col("dom")
    types, words = dom["schema_types"], T.word_count(dom["main_text"])
    lacks = lambda *t: ~F.arrays_overlap(types, F.array(*map(F.lit, t)))
    text = lambda v: F.nullif(F.coalesce(v, F.lit("")), F.lit(""))
    prop = lambda name: text(C.meta("property", name, True))
    context = F.lit("https://schema.org").alias("@context")

    def question(p: Column) -> Column:
        return F.struct(F.lit("Question").alias("@type"), p["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), cut(p["a"], 500).alias("text")).alias("acceptedAnswer"))

    faq = F.to_json(F.struct(context, F.lit("FAQPage").alias("@type"), F.transform(F.slice(pairs(dom), 1, MOST_PAIRS), question).alias("mainEntity")))
    named = lambda kind, name: F.when(name.isNotNull(), F.struct(F.lit(kind).alias("@type"), name.alias("name")))
    author = text(F.trim(F.regexp_replace(F.coalesce(C.meta("name", "author"), F.lit("")), r"\s+", " ")))
    dated = F.coalesce(F.get(dom["dates"], F.lit(0)), prop("article:published_time"))
    article = F.to_json(F.struct(
        context, F.lit("Article").alias("@type"), cut(text(dom["h1_text"]), 110).alias("headline"), dated.alias("datePublished"), named("Person", author).alias("author"), prop("og:image").alias("image"), named("Organization", F.col("entity")).alias("publisher"),
    ))
    about = text(F.trim(F.regexp_replace(F.coalesce(C.meta("name", "description"), F.lit("")), r"\s+", " ")))
    price, currency = prop("product:price:amount"), prop("product:price:currency")
    offer = F.when(price.isNotNull() & currency.isNotNull(), F.struct(F.lit("Offer").alias("@type"), price.alias("price"), currency.alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability")))
    product = F.to_json(F.struct(context, F.lit("Product").alias("@type"), cut(dom["h1_text"], 150).alias("name"), cut(about, 300).alias("description"), prop("og:image").alias("image"), offer.alias("offers")))
    inner = ~F.col("is_home")
    og_article = F.exists(dom["metas"], lambda m: (m["property"] == "og:type") & (m["content"] == "article"))
    is_article = inner & (dom["article_tags"] > 0) & (words >= 300) & (C.has(U.path(F.col("final_url")), ARTICLE_PATH) | F.coalesce(og_article, F.lit(False)) | dom["dated"])
    is_product = inner & F.size(dom["prices"]).between(1, 4) & dom["buy_buttons"].between(1, 2) & (dom["h1_text"] != "")
    n = F.size(pairs(dom))
    found = [
        ((n >= 3) & lacks("FAQPage", "QAPage"), "FAQPage", F.format_string("%d questions, each with its answer", n), faq), (is_article & lacks(*ARTICLES), "Article", F.lit("an article without an article's markup"), article),
        (is_product & lacks("Product"), "Product", F.lit("a price and a buy button without a product's markup"), product),
    ]
    gaps = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("type"), why.alias("why"), snippet.alias("snippet"))) for test, kind, why, snippet in found]), lambda g: g.isNotNull())
    return pages.select("site", F.col("final_url").alias("url"), F.inline(gaps))
