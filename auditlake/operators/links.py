"""Link-graph operators: internal paths, external domains, orphans, unread sitemap pages, twins, suffix joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.anchors import with_hrefs


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, target of every anchor that has an address, in whatever form: resolved, null where it is none on the web."""
    found = with_hrefs(pages.select("page_id", "url", "html")).select("page_id", "url", F.explode("hrefs").alias("href"))
    return found.select("page_id", "url", U.resolve(F.col("href"), F.col("url")).alias("target"))


def internal_paths(found: DataFrame) -> DataFrame:
    """Distinct paths of the page's own host, other than its own."""
    u, t = F.col("url"), F.col("target")
    own = found.where((U.bare_host(t) == U.bare_host(u)) & (U.trimmed_path(t) != U.trimmed_path(u)))
    return own.groupBy("page_id").agg(F.countDistinct(U.trimmed_path(t)).alias("n_paths"))


def external_domains(found: DataFrame) -> DataFrame:
    """Per site: links, and distinct other sites without social networks."""
    d = found.select(U.registrable(U.host(F.col("url"))).alias("own"), U.registrable(U.host(F.col("target"))).alias("other"))
    named = (F.col("other") != F.col("own")) & (F.col("other") != "") & ~F.col("other").isin(U.NOT_EXTERNAL)
    return d.groupBy("own").agg(F.count("*").alias("n_links"), F.countDistinct(F.when(named, F.col("other"))).alias("n_external"))


def orphans(sitemap: DataFrame, found: DataFrame, read: DataFrame) -> DataFrame:
    """Sitemap entries (site, loc) of the site's own host that no page links to and no crawl has read.

    Two anti-joins on (site, key). The sides are reduced to distinct keys first.
    """
    m = sitemap.withColumn("k", U.crawl_key(F.col("loc"))).where(F.split_part("k", F.lit("/"), F.lit(1)) == F.col("site"))
    linked = found.select(U.bare_host(F.col("url")).alias("site"), U.crawl_key(F.col("target")).alias("k")).distinct()
    known = read.select("site", U.crawl_key(F.col("url")).alias("k")).distinct()
    return m.join(linked, ["site", "k"], "left_anti").join(known, ["site", "k"], "left_anti")


def unread(sitemap: DataFrame, read: DataFrame) -> DataFrame:
    """Distinct sitemap pages of the own host, assets left out, that were not read; queries count."""
    m = sitemap.where(~U.is_asset(F.col("loc"))).withColumn("k", U.sitemap_key(F.col("loc"))).where(F.split_part("k", F.lit("/"), F.lit(1)) == F.col("site"))
    firsts = m.groupBy("site", "k").agg(F.min("loc").alias("loc"))
    return firsts.join(read.select("site", U.sitemap_key(F.col("url")).alias("k")).distinct(), ["site", "k"], "left_anti")


def twins(values: DataFrame) -> DataFrame:
    """page_id, site, twin: the least page of the same site with the same value at another address.

    values: page_id, site, url, value. Per value the least page of each address is kept, and of these the two
    least: one of them is every page's twin. The join back is on a key with one row, so no value pairs up
    with itself, however many pages share it.
    """
    v = values.where("value <> ''").withColumn("key", F.lower("value"))
    by_url = v.groupBy("site", "key", "url").agg(F.min("page_id").alias("p"))
    least = by_url.groupBy("site", "key").agg(F.min(F.struct("p", "url")).alias("a"), F.count("*").alias("n")).where("n > 1")
    second = by_url.join(least, ["site", "key"]).where(F.col("url") != F.col("a.url")).groupBy("site", "key").agg(F.min("p").alias("b"), F.first("a").alias("a"))
    return v.join(second, ["site", "key"]).select("page_id", "site", F.when(F.col("url") == F.col("a.url"), F.col("b")).otherwise(F.col("a.p")).alias("twin"))


def status_classes(read: DataFrame) -> DataFrame:
    """site and how its addresses answered. read: site, url, final_url, status (0 or null: no answer). A page that moved counts as moved, whatever it answered."""
    moved, s = U.crawl_key(F.col("url")) != U.crawl_key(F.col("final_url")), F.coalesce("status", F.lit(0))
    c = read.select("site", moved.alias("moved"), s.alias("s"))
    m, s = F.col("moved"), F.col("s")
    return c.groupBy("site").agg(
        F.count_if(~m & s.between(1, 399)).alias("ok"), F.count_if(m).alias("redirected"), F.count_if(~m & s.between(400, 499)).alias("client_error"), F.count_if(~m & (s >= 500)).alias("server_error"), F.count_if(~m & (s == 0)).alias("unreachable")
    )


def by_suffix(rows: DataFrame, host: str, listed: DataFrame, domain: str = "domain") -> DataFrame:
    """rows joined with listed domains that are the host or a parent of it."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return rows.withColumn(domain, F.explode(suffixes)).join(listed, domain)
