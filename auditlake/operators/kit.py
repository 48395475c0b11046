"""Ready-to-paste items: texts built from a site's own facts, each escaped for the place it goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .sinks import KIT

MOST_PAGES = 10
#: Response headers and the values to send.
HEADERS = (("X-Content-Type-Options", "nosniff"), ("X-Frame-Options", "SAMEORIGIN"), ("Referrer-Policy", "strict-origin-when-cross-origin"), ("Strict-Transport-Security", "max-age=31536000"))
SITEMAP_HEAD, SITEMAP_END = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n</urlset>\n"


def for_script(json: Column) -> Column:
    """JSON that may stand inside a script element: no markup can begin in it."""
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def _tag(name: str, key: str, value: Column) -> Column:
    return F.concat(F.lit(f'<meta {name}="{key}" content="'), T.escape_xml(value), F.lit('">'))


def texts(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """site, item, content. sites: site, url, title, description (may be null or empty); pages: site, ord, url, title.

    Of a site's pages the first MOST_PAGES by ord are listed. Facts that are missing leave their line out.
    """
    first = pages.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("ord", "url"))).where(F.col("k") <= MOST_PAGES)
    listed = first.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("k", "url", "title"))).alias("pages"))
    s = sites.join(listed, "site", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<k:int,url:string,title:string>>")))
    url, title, about = F.col("url"), F.coalesce(F.nullif(T.collapse(F.coalesce("title", F.lit(""))), F.lit("")), F.col("site")), F.nullif(T.collapse(F.coalesce("description", F.lit(""))), F.lit(""))
    origin = F.concat(U.scheme(url), F.lit("://"), U.host(url))
    lines = lambda *xs: F.array_join(F.array_compact(F.array(*xs)), "\n")
    urls = F.array_distinct(F.concat(F.array(url), F.transform("pages", lambda p: p["url"])))
    entry = lambda p: F.concat(F.lit("- ["), T.escape_markdown(F.coalesce(F.nullif(p["title"], F.lit("")), p["url"])), F.lit("]("), p["url"], F.lit(")"))
    made = {
        "canonical": F.concat(F.lit('<link rel="canonical" href="'), T.escape_xml(url), F.lit('">')),
        "robots.txt": F.concat(F.lit("User-agent: *\nAllow: /\n\nSitemap: "), origin, F.lit("/sitemap.xml\n")),
        "sitemap.xml": F.concat(F.lit(SITEMAP_HEAD), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("  <url><loc>"), T.escape_xml(u), F.lit("</loc></url>"))), "\n"), F.lit(SITEMAP_END)),
        "organization": for_script(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), title.alias("name"), F.concat(origin, F.lit("/")).alias("url"), about.alias("description")))),
        "llms.txt": F.concat(lines(F.concat(F.lit("# "), T.escape_markdown(title)), F.concat(F.lit("> "), T.escape_markdown(about)), F.when(F.size("pages") > 0, F.concat(F.lit("\n## Pages\n"), F.array_join(F.transform("pages", entry), "\n")))), F.lit("\n")),
        "open-graph": lines(_tag("property", "og:title", title), F.when(about.isNotNull(), _tag("property", "og:description", about)), F.lit('<meta property="og:type" content="website">'), _tag("property", "og:url", url)),
        "head": lines(F.concat(F.lit("<title>"), T.escape_xml(title), F.lit("</title>")), F.when(about.isNotNull(), _tag("name", "description", about)), F.lit('<meta name="viewport" content="width=device-width, initial-scale=1">')),
        "headers": F.lit("\n".join(f'add_header {k} "{v}" always;' for k, v in HEADERS)),
    }
    return s.select("site", F.explode(F.create_map(*[x for k, c in made.items() for x in (F.lit(k), c)])).alias("item", "content"))


def called_for(items: DataFrame, found: DataFrame) -> DataFrame:
    """The items that a site's findings (site, id) call for."""
    wanted = F.array(*[F.struct(F.lit(k).alias("item"), F.lit(i).alias("id")) for k, ids in KIT.items() for i in ids])
    asked = items.select("site").distinct().select("site", F.explode(wanted).alias("w")).select("site", "w.*").join(found.select("site", "id").distinct(), ["site", "id"], "left_semi")
    return items.join(asked.select("site", "item").distinct(), ["site", "item"], "left_semi")
