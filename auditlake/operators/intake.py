"""What comes from outside, read and checked: text files, sitemaps, render replies, ideas, rivals, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U

# Patterns and bounds of what is accepted.
UNSAFE_IDEA = r"https?://|www\.|[\w.+-]+@[\w-]+\.[\w.]+|`|<[^>]*>|\b(curl|wget|sudo|chmod|powershell|eval)\b|rm\s+-rf|\+?\d[\d\s().-]{7,}\d"
HYDRATION = (
    r"hydration (failed|mismatch|error|node mismatch|completed but contains mismatches)|error while hydrating|text content does not match"
    r"|(text content|prop `[^`]*`|attribute `[^`]*`|extra attributes[^.]*|expected server html)[^.]{0,40}did not match|minified react error #(418|423|425)"
)
ERROR_KINDS = ("error", "warning", "warn")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
MOST_MEASURED, MOST_IDEAS, EFFORTS = 10_000_000, 8, ("low", "medium", "high")


def text_file(status: Column, content_type: Column, body: Column) -> Column:
    """The body of a text file; null if the answer is no file: another status, HTML by type or by its first character."""
    html = F.coalesce(F.lower(content_type), F.lit("")).contains("html") | body.rlike(r"^\s*<")
    return F.when((status == 200) & ~html, body)


def sitemap_locations(xml: Column) -> Column:
    """Addresses of a sitemap; CDATA is taken as it is, the five XML entities are decoded elsewhere."""
    raw = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(<!\[CDATA\[.*?\]\]>|[^<\s][^<]*?)\s*</loc>"), F.lit(1))

    def decoded(x: Column) -> Column:
        out = x
        for a, b in ENTITIES:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(x.startswith("<!["), F.trim(F.regexp_extract(x, r"(?s)^<!\[CDATA\[(.*)\]\]>\z", 1))).otherwise(out)

    return F.transform(raw, decoded)


def measured(value: Column) -> Column:
    """A number that a browser worker sent, if it is one that can be."""
    return F.when(value.between(0, MOST_MEASURED), value)


def is_hydration_error(kind: Column, message: Column) -> Column:
    return F.coalesce(kind.isin(*ERROR_KINDS) & message.rlike("(?i)" + HYDRATION), F.lit(False))


def lcp_resource(snippet: Column, page: Column) -> Column:
    """Address of the image in a markup snippet, absolute; null if there is none on the web."""
    src = F.coalesce(F.nullif(F.regexp_extract(snippet, r"(?i)\bsrc=[\"']([^\"']+)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(snippet, r"(?i)url\([\"']?([^)\"']+)[\"']?\)", 1), F.lit("")))
    return U.resolve(src, page)


def usable_ideas(ideas: DataFrame, found: DataFrame, most: int = MOST_IDEAS) -> DataFrame:
    """site, place, title, cites: ideas (site, ord, title, why, cites, effort) worth showing, in order.

    An idea must cite a finding (site, id) of its site, have an effort and a title, and be free of links, contacts and
    code; of equal titles the first counts; ``most`` a site. The first 50 replies of a site are looked at.
    """
    of_site = Window.partitionBy("site")
    first = ideas.withColumn("k", F.row_number().over(of_site.orderBy("ord"))).where("k <= 50")
    clean = first.withColumn("title", F.substring(F.trim("title"), 1, 120)).withColumn("why", F.substring(F.trim("why"), 1, 300))
    safe = ~F.col("title").rlike("(?i)" + UNSAFE_IDEA) & ~F.col("why").rlike("(?i)" + UNSAFE_IDEA)
    good = clean.where(F.col("effort").isin(*EFFORTS) & (F.length("title") >= 3) & safe)
    cited = good.join(found.select("site", F.col("id").alias("cites")).distinct(), ["site", "cites"], "left_semi")
    once = cited.withColumn("n", F.row_number().over(Window.partitionBy("site", F.lower("title")).orderBy("ord"))).where("n = 1")
    return once.withColumn("place", F.row_number().over(of_site.orderBy("ord")).cast("long")).where(F.col("place") <= most).select("site", "place", "title", "cites")


def candidates(named: DataFrame, most: int) -> DataFrame:
    """site, place, domain, source: rivals to look at. named: site, own, source_ord, source, pos, domain (cleaned).

    Sources in order; one domain of each registrable domain, the first; never the site's own.
    """
    reg = named.where("domain is not null").withColumn("reg", U.registrable(F.col("domain"))).where(F.col("reg") != U.registrable(F.col("own")))
    once = reg.withColumn("n", F.row_number().over(Window.partitionBy("site", "reg").orderBy("source_ord", "pos"))).where("n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("source_ord", "pos")).cast("long")).where(F.col("place") <= most).select("site", "place", "domain", "source")


def domain_rank(rank: Column) -> Column:
    """A rank of 0 to 10 with one decimal; null if it is none."""
    return F.when(rank.between(0, 10), F.floor(rank * 10 + 0.5) / 10)


def named_exactly(entity: Column, labels: Column) -> Column:
    """Whether one of the labels found is the entity's name; null without a name."""
    wanted = F.lower(F.trim(entity))
    return F.when(F.coalesce(wanted, F.lit("")) != "", F.coalesce(F.exists(labels, lambda x: F.coalesce(F.lower(F.trim(x)) == wanted, F.lit(False))), F.lit(False)))


def host_is_public(numbers: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a name resolved (IPv4 addresses as numbers) and to public addresses only; a null address is none."""
    inside = lambda n: F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges]), lambda r: n.between(r["a"], r["b"]))
    return F.coalesce((F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull() | inside(n)), F.lit(False))
