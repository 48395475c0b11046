"""Page source, references, addresses and the crawl on small rows made for the purpose."""

from __future__ import annotations

import http.server
import ipaddress
import threading
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators import crawl
from auditlake.sources import responses as S
from auditlake.sources.anchors import hrefs

BASES = ["https://a.test/x/y/z.html?q=1#f", "http://a.test:8080", "https://a.test/x/"]
REFS = ["g", "./g", "g/", "/g", "//h.test", "?y", "g?y", "#s", "g#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "./../g", "./g/.", "g/./h", "g/../h", "g?y/./x", "g?y/../x", "/a//b/..//c"]


def test_references_resolve_as_the_standard_says(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = {(r["b"], r["r"]): r["t"] for r in spark.createDataFrame(rows, "b string, r string").select("b", "r", U.resolve(F.col("r"), F.col("b")).alias("t")).collect()}
    for b, r in rows:
        base = b if b.count("/") > 2 else b + "/"
        want = (urljoin(base, r) if r else base).partition("#")[0]
        want += "/" if want.count("/") == 2 else ""
        assert got[b, r] == want, (b, r)


def test_references_of_browsers(spark):
    cases = {
        " \\g\\h ": "https://a.test/g/h", "HTTPS://User:P@B.Test:443/x": "https://b.test/x", "http://b.test:80?q": "http://b.test/?q", "/%2E%2e/x/%2e": "https://a.test/x/", "mailto:a@b.c": None, "data:text/html,x": None, "https://": None, "g\nh": "https://a.test/x/y/gh",
        "g?a\\b": "https://a.test/x/y/g?a\\b", "?": "https://a.test/x/y/z.html", "http:g": None,
    }
    got = spark.createDataFrame([(r,) for r in cases] + [(None,)], "r string").select("r", U.resolve(F.col("r"), F.lit(BASES[0])).alias("t")).collect()
    assert {r["r"]: r["t"] for r in got} == {**cases, None: None}


def test_addresses_equal_the_library(spark):
    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:1::", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "g::", "12345::", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "", "a.test", None]
    got = {r["t"]: (r["h"], r["b"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.address_hex(F.col("t")).alias("h"), U.is_blocked_address(F.col("t")).alias("b")).collect()}
    nets = [ipaddress.ip_network(n) for n in [f"{a}/{b}" for a, b in [*U.BLOCKED_NETWORKS, *U.BLOCKED_NETWORKS_6]]]
    for t in texts:
        try:
            ip = ipaddress.ip_address((t or "").split("%")[0])
        except ValueError:
            assert got[t] == (None, True), t
            continue
        plain = ip.ipv4_mapped if ip.version == 6 and ip.ipv4_mapped else ip
        assert got[t][1] == any(plain in n for n in nets if n.version == plain.version), t
        assert int(got[t][0], 16) == (int(ip) if ip.version == 6 else int(ip) + (0xFFFF << 32)), t


def test_anchors_are_read_as_markup():
    page = """<a href="/1">x</a><A class=c HREF='/2?a&amp;b'>y</A><a href=/3>z</a><a name=n>no</a><!-- <a href="/c"> --><script>'<a href="/s">'</script><a href><area href="/m"><a
    title="t" href="/4"/>"""
    assert hrefs(page)[:3] == ["/1", "/2?a&b", "/3"] and hrefs(page)[-1] == "/4" and "/c" not in hrefs(page) and "/s" not in hrefs(page)


def plain_crawl(seeds, links, most, depth, barred=()):
    out = {}
    for site, key in seeds:
        if (site, key) in barred:
            continue
        seen, level = [key], [key]
        for _ in range(depth):
            new = []
            for k in level:
                for dst, _ in sorted(((d, p) for s, a, d, p in links if s == site and a == k), key=lambda x: (x[1], x[0])):
                    if dst not in seen and dst not in new and (site, dst) not in barred:
                        new.append(dst)
            level = new[: max(0, most - len(seen))]
            seen += level
        out.update({(site, k): i for i, k in enumerate(seen, 1)})
    return out


def test_crawl_order_quota_rings_and_barred_pages(spark):
    import random

    rng = random.Random(3)
    links = list({(s, a, b): (s, f"{s}/{a}", f"{s}/{b}", p) for p, (s, a, b) in enumerate((rng.choice("AB"), rng.randrange(25), rng.randrange(30)) for _ in range(160)) if a != b}.values())
    seeds, barred = [("A", "A/0"), ("B", "B/1"), ("C", "C/0")], {("A", "A/3"), ("B", "B/7")}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = df([(s, k, k, 0) for s, k in seeds], "site string, key string, url string, ord long"), df([(s, a, b, b, p) for s, a, b, p in links], "site string, src string, dst string, url string, pos long")
    for most, depth, out in ((40, 10, ()), (5, 10, barred), (12, 2, barred), (1, 3, ())):
        got = crawl.crawl(*frames, most, depth, df(list(out), "site string, key string") if out else None).collect()
        assert {(r["site"], r["key"]): r["place"] for r in got} == plain_crawl(seeds, links, most, depth, out)
    assert crawl.crawl(frames[0].limit(0), frames[1]).count() == 0 and crawl.crawl(frames[0], frames[1].limit(0)).count() == 3


def test_recorded_responses(spark, tmp_path):
    asked = [("a/b.test", 0, "https://a.test/"), ("a/b.test", 1, "https://a.test/r"), ("c", 0, "ftp://c/"), ("c", 1, "https://c/none"), ("c", 2, "https://c:8443/"), ("c", 3, "https://c/5")]
    answers = [("a/b.test", "https://a.test/", 200, {"Content-Type": "text/html"}, "é" * 40), ("a/b.test", "https://a.test/r", 302, {"LOCATION": "/"}, None)]
    answers += [("c", f"https://c/{i}", 301, {"location": str(i - 1)}, None) for i in range(1, 6)] + [("c", "https://c/0", 200, {}, None)]
    S.record(spark.createDataFrame(asked, "site string, ord long, url string"), spark.createDataFrame(answers, "site string, url string, status int, headers map<string,string>, body string"), f"file://{tmp_path}/r")
    read = S.responses(spark, f"file://{tmp_path}/r", most_bytes=11)
    got = {(r["site"], r["ord"]): r for r in read.collect()}
    assert len(got) == 6 and read.rdd.getNumPartitions() == 2
    a, b = got["a/b.test", 0], got["a/b.test", 1]
    assert a["body"] == "é" * 5 + "�" and a["truncated"] and a["headers"] == {"content-type": "text/html"} and (b["final_url"], b["hops"], b["body"]) == ("https://a.test/", 1, a["body"])
    assert [got["c", i]["error"] for i in range(4)] == ["blocked: scheme", "no answer", "blocked: port", None] and (got["c", 3]["hops"], got["c", 3]["body"]) == (5, "")
    only = S.responses(spark, f"file://{tmp_path}/r").where("site = 'c' and ord > 0")
    assert only.count() == 3 and only.rdd.getNumPartitions() == 1
    assert "site" in only._jdf.queryExecution().toString()


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        if self.path.startswith("/hop"):
            self.send_response(302)
            self.send_header("Location", "/end" if self.path == "/hop" else self.path)
            self.end_headers()
        else:
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"x" * 5000)

    def log_message(self, *a):
        pass


def test_fetching_guards_every_hop():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, anything = f"http://127.0.0.1:{server.server_port}", {"allowed": lambda ip: True, "may": lambda url: None}
    try:
        _, final, hops, status, headers, kind, body, cut, error = S.fetch(f"{at}/hop", 1000, **anything)
        assert (final, hops, status, kind, len(body), cut, error) == (f"{at}/end", 1, 200, "text/html", 1000, True, None) and headers["content-type"] == kind
        assert S.fetch(f"{at}/hop-on", 1000, **anything)[-1] == "too many redirects (more than 5)"
        assert S.fetch(f"{at}/end", 1000)[-1] == "blocked: port" and S.fetch(f"{at}/end", 1000, may=lambda url: None)[-1] == "blocked: not a public address"
    finally:
        server.shutdown()
    assert "blocked" in S.fetch("http://127.0.0.1/")[-1]


@pytest.mark.parametrize("xml,want", [("<urlset></urlset>", (0, None, None, True)), ("<sitemapindex></sitemapindex>", (0, 0, 0, True))])
def test_sitemaps_without_locations(spark, xml, want):
    r = crawl.expanded(spark.createDataFrame([("a.test", xml)], "site string, xml string"), spark.createDataFrame([], "site string, url string, status int, xml string")).first()
    assert (len(r["locs"]), r["listed"], r["read"], r["whole"]) == want
