"""What the findings of round 4 named."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F


def crawled(spark, folder):
    """Rows of crawl_frontier over folder's pages, and those of its SQL, in order."""
    from auditlake.queries.crawl_queries import crawl_frontier
    from auditlake.queries.registry import SQL

    got = crawl_frontier(spark, f"file://{folder}").select("site", "place", "depth", "key").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT site, place, depth, key FROM ({SQL['crawl_frontier']})").fetchall()
    return sorted(map(tuple, got)), sorted(want)


def test_pages_that_share_a_key_are_crawled_in_the_order_of_keys(spark, tmp_path):
    """Their links share places: whether a page is read by http or https must not decide."""
    from auditlake.operators import crawl

    page = lambda *words: "<p>" + "".join(f'<a href="/{w}">{w}</a>' for w in words)
    pages = [(1, "https://a.test/x#top", page("a", "d")), (2, "http://a.test/x/", page("b", "c")), (3, "https://b.test/x", page("m")), (4, "https://www.b.test/x?q=1", page("l", "k")), (5, "https://b.test/y", page("z")), (6, "http://b.test/y", page("zz"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got, want = crawled(spark, tmp_path)
    assert got == want and [r[3] for r in got[:5]] == ["a.test/x", "a.test/a", "a.test/b", "a.test/c", "a.test/d"]
    seeds = spark.createDataFrame([("s", "s/b", "http://s/b", 0), ("s", "s/a", "https://s/a", 0)], "site string, key string, url string, ord long")
    links = spark.createDataFrame([], "site string, src string, dst string, url string, pos long")
    assert [r["key"] for r in crawl.crawl(seeds, links).orderBy("place").collect()] == ["s/a", "s/b"]


def test_a_site_with_more_pages_than_an_integer_has_squares_for(spark, tmp_path):
    """The largest rank's square is beyond 2^31."""
    i = F.col("id")
    pages = spark.range(46_350).select(i.alias("page_id"), F.concat(F.lit("https://a.test/"), i.cast("string")).alias("url"), F.when(i % 9_000 < 2, F.concat(F.lit('<a href="/'), i % 7, F.lit('">x</a>'))).otherwise("").alias("html"))
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    got, want = crawled(spark, tmp_path)
    assert got == want and len(got) == 12
