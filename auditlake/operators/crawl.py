"""The bounded crawl: a frontier that grows over the link graph, level by level, with a quota a site.

Pages are met in the order in which a crawler meets them: by the place of the page that links to them first, then by
the place of the link, then by key. A level is one join of the frontier with the links, an anti-join with what was
seen, and a ranking that keeps no more rows of a site than its quota before the shuffle, so a site with a third of all
links is no larger than any other. The number of levels is bounded by ``most_depth``; the crawl ends when a level
brings nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..storage import Stash


def link_graph(pages: DataFrame, hrefs: str = "hrefs") -> DataFrame:
    """site, src, dst, url, pos of links to pages of the own host, assets left out. pages: site, url and its hrefs in order."""
    at = pages.select("site", F.col("url").alias("base"), U.crawl_key(F.col("url")).alias("src"), F.posexplode(hrefs).alias("pos", "href"))
    to = at.withColumn("url", U.resolve(F.col("href"), F.col("base"))).where(F.col("url").isNotNull())
    own = to.where((U.bare_host(F.col("url")) == U.bare_host(F.col("base"))) & ~U.is_asset(F.col("url"))).withColumn("dst", U.crawl_key(F.col("url")))
    return own.where(F.col("dst") != F.col("src")).groupBy("site", "src", "dst").agg(F.min(F.struct("pos", "url")).alias("f")).select("site", "src", "dst", "f.url", F.col("f.pos").cast("long").alias("pos"))


def crawl(seeds: DataFrame, links: DataFrame, most_pages: int = 40, most_depth: int = 10, disallowed: DataFrame | None = None) -> DataFrame:
    """site, key, url, depth, place of the first ``most_pages`` pages of each site in crawl order.

    seeds: site, key, url, ord; links: site, src, dst, url, pos (as link_graph has them); disallowed: site, key of pages
    that robots rules keep out: neither read nor followed. A key that is linked but leads nowhere is met all the same,
    and has no links of its own.
    """
    stash = Stash(seeds.sparkSession)
    # Fewer than the quota are kept of a site whatever it links to, before any shuffle by site. Pages that share a key also
    # share the places of their links: among these the key decides, not the address, which may be http or https.
    ranked = lambda df, *order: df.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy(*order, "key"))).where(F.col("n") <= most_pages)
    barred = lambda df: df if disallowed is None else df.join(disallowed.select("site", "key").distinct(), ["site", "key"], "left_anti")
    first = barred(seeds.groupBy("site", "key").agg(F.min(F.struct("ord", "url")).alias("f")))
    seen = frontier = stash.put(ranked(first, "f.ord").select("site", "key", "f.url", F.lit(0).alias("depth"), F.col("n").cast("long").alias("place")))
    links = stash.put(links)
    for depth in range(1, most_depth + 1):
        met = frontier.select("site", F.col("key").alias("src"), "place").join(links, ["site", "src"])
        new = barred(met.groupBy("site", F.col("dst").alias("key")).agg(F.min(F.struct("place", "pos", "url")).alias("f"))).join(seen.select("site", "key"), ["site", "key"], "left_anti")
        had = seen.groupBy("site").agg(F.max("place").alias("had"))
        level = ranked(new, "f.place", "f.pos").join(had, "site").withColumn("place", F.col("had") + F.col("n"))
        frontier = stash.put(level.where(F.col("place") <= most_pages).select("site", "key", "f.url", F.lit(depth).alias("depth"), "place"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expanded(sitemaps: DataFrame, children: DataFrame, most_children: int = 5) -> DataFrame:
    """site, locs, listed, read, whole: locations of each site's sitemap, those of an index from its children.

    sitemaps: site, xml; children: site, url, status, xml of fetched child sitemaps. An index lists up to
    ``most_children`` children of its own host in order; one that is missing, no list of pages or beyond that number
    makes the result less than whole. locs is an array of arrays' texts in order, one row a site.
    """
    from .intake import sitemap_locations as locations
    from ..plans.engine import is_index

    s = sitemaps.select("site", is_index(F.col("xml")).alias("index"), locations(F.col("xml")).alias("locs"))
    wanted = s.where("index").select("site", F.posexplode("locs").alias("pos", "url")).where(U.bare_host(F.col("url")) == F.col("site"))
    asked = wanted.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("n") <= most_children)
    good = (F.col("status") == 200) & F.col("xml").rlike(r"(?i)<urlset[\s>]") & ~is_index(F.col("xml"))
    got = asked.join(children.where(good).select("site", "url", locations(F.col("xml")).alias("own")), ["site", "url"], "left")
    # At most most_children rows a site.
    by_site = got.groupBy("site").agg(F.count("own").alias("read"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("own", F.array().cast("array<string>")).alias("own")))), lambda x: x["own"])).alias("found"))
    j = s.join(by_site, "site", "left")
    listed, read = F.size("locs").cast("long"), F.coalesce("read", F.lit(0)).cast("long")
    return j.select(
        "site", F.when(F.col("index"), F.coalesce("found", F.array().cast("array<string>"))).otherwise(F.col("locs")).alias("locs"), F.when(F.col("index"), listed).alias("listed"), F.when(F.col("index"), read).alias("read"),
        (~F.col("index") | (read == listed)).alias("whole"),
    )
