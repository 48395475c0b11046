"""Pages as a fetch sees them: a Python data source over recorded responses, or over the web.

``spark.read.format("audit_responses")`` takes the options ``path`` (a folder of recorded responses, see ``record``),
``maxBytes`` and ``maxRedirects``. Each site is an input partition of its own, so sites are read side by side and a
slow one delays no other; filters on ``site`` are pushed down and leave whole partitions out. Redirects are followed
hop by hop, each hop judged like a first address; a chain that is too long, or leads nowhere, is a row with its error
and no body. A body is read up to ``maxBytes``, and a character that the end falls into becomes U+FFFD.

With ``transport`` set to ``http`` the addresses of a recorded folder are fetched from the web instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..ship import ship
from .html import MOST_BYTES

FORMAT = "audit_responses"
MOST_REDIRECTS, SECONDS = 5, 15
#: More sites than this share partitions, as many to each.
MOST_PARTITIONS = 20_000
AGENT = "auditlake/1"
SCHEMA = "site string, ord long, url string, final_url string, hops int, status int, headers map<string,string>, content_type string, body string, truncated boolean, error string"


def record(asked: DataFrame, answers: DataFrame, path: str) -> None:
    """Writes a folder of responses. asked: site, ord, url; answers: site, url, status, headers, body."""
    asked.select("site", "ord", "url").write.partitionBy("site").parquet(f"{path}/asked")
    answers.select("site", "url", "status", "headers", "body").write.partitionBy("site").parquet(f"{path}/answers")


def responses(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS, transport: str = "recorded") -> DataFrame:
    """What the addresses asked of a folder answer, in order of ``ord`` within a site."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResponseSource)
    return spark.read.format(FORMAT).option("path", path).option("maxBytes", most_bytes).option("maxRedirects", most_redirects).option("transport", transport).load()


class ResponseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ResponseReader(dict(self.options))


@dataclass
class Sites(InputPartition):
    names: list[str]


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_bytes, self.most_redirects = int(options.get("maxbytes", MOST_BYTES)), int(options.get("maxredirects", MOST_REDIRECTS))
        self.transport, self.only = options.get("transport", "recorded"), None

    def _folder(self, *below: str):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, "/".join([root.rstrip("/"), *below])

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("site",) else set(f.value) if isinstance(f, In) and f.attribute == ("site",) else None
            if wanted is None:
                yield f
            else:
                self.only = wanted if self.only is None else self.only & wanted

    def partitions(self) -> list[Sites]:
        from urllib.parse import unquote

        from pyarrow import fs

        system, root = self._folder("asked")
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(unquote(i.base_name.partition("=")[2]) for i in found if i.base_name.startswith("site="))
        names = [n for n in names if self.only is None or n in self.only]
        step = max(1, -(-len(names) // MOST_PARTITIONS))
        return [Sites(names[i : i + step]) for i in range(0, len(names), step)] or [Sites([])]

    def read(self, partition: Sites) -> Iterator[tuple]:
        for site in partition.names:
            rows = sorted(self._rows("asked", site, ["ord", "url"]), key=lambda r: (r["ord"], r["url"]))
            if self.transport == "http":
                yield from ((site, r["ord"], *fetch(r["url"], self.most_bytes, self.most_redirects)) for r in rows)
            else:
                yield from self._recorded(site, rows)

    def _rows(self, table: str, site: str, columns: list[str]) -> Iterator[dict]:
        from urllib.parse import quote

        import pyarrow.dataset as ds

        system, folder = self._folder(table)
        for name in dict.fromkeys((quote(site, safe="._-~"), site)):
            if system.get_file_info(f"{folder}/site={name}").type.name == "Directory":
                for batch in ds.dataset(f"{folder}/site={name}", filesystem=system, format="parquet").to_batches(columns=columns, batch_size=64):
                    yield from batch.to_pylist()
                return

    def _recorded(self, site: str, asked: list[dict]) -> Iterator[tuple]:
        """Chains are followed on addresses and statuses alone; then the bodies at their ends are read, a few at a time."""
        answers = {}
        for r in self._rows("answers", site, ["url", "status", "headers"]):
            answers.setdefault(r["url"], (r["status"], {k.lower(): v for k, v in (r["headers"] or [])}))
        ends: dict[str, list[tuple]] = {}
        for r in asked:
            url, hops, error = follow(r["url"], lambda u: answers.get(u, (None, {})), self.most_redirects)
            if error is None:
                ends.setdefault(url, []).append((r, hops))
            else:
                yield (site, r["ord"], r["url"], url, hops, None, None, None, None, None, error)
        for r in self._rows("answers", site, ["url", "body"]):
            for a, hops in ends.pop(r["url"], ()):
                status, headers = answers[r["url"]]
                raw = (r["body"] or "").encode("utf-8", "surrogatepass")
                yield (site, a["ord"], a["url"], r["url"], hops, status, headers, headers.get("content-type", ""), raw[: self.most_bytes].decode("utf-8", "replace"), len(raw) > self.most_bytes, None)


def fit_to_fetch(url: str) -> str | None:
    """Why an address is not fetched; null if it may be."""
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return "not an address"
    if u.scheme not in ("http", "https") or not u.hostname:
        return "scheme" if u.scheme and u.hostname else "not an address"
    if u.username or u.password:
        return "credentials"
    return None if port in (None, 80, 443) else "port"


def follow(url: str, answer, most: int) -> tuple[str, int, str | None]:
    """(last address, hops, error). answer: address -> (status or None, headers)."""
    for hop in range(most + 1):
        if why := fit_to_fetch(url):
            return url, hop, f"blocked: {why}"
        status, headers = answer(url)
        if status is None:
            return url, hop, "no answer"
        if not (300 <= status < 400 and headers.get("location")):
            return url, hop, None
        url = urljoin(url, headers["location"])
    return url, most + 1, f"too many redirects (more than {most})"


def fetch(url: str, most_bytes: int = MOST_BYTES, most_redirects: int = MOST_REDIRECTS, allowed=None, may=fit_to_fetch) -> tuple:
    """One address over the web, as the columns of SCHEMA after ``ord``. allowed: a test of the addresses a name resolves to."""
    import http.client
    import ipaddress
    import socket

    first, allowed = url, allowed or (lambda ip: ipaddress.ip_address(ip).is_global and not ipaddress.ip_address(ip).is_multicast)
    failed = lambda hop, why: (first, url, hop, None, None, None, None, None, why)
    for hop in range(most_redirects + 1):
        if why := may(url):
            return failed(hop, f"blocked: {why}")
        u = urlsplit(url)
        try:
            found = socket.getaddrinfo(u.hostname, u.port or (443 if u.scheme == "https" else 80), type=socket.SOCK_STREAM)
            if not found or not all(allowed(a[4][0]) for a in found):
                return failed(hop, "blocked: not a public address")
            kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
            connection = kind(u.hostname, u.port, timeout=SECONDS)
            # The address that was judged is the one connected to.
            connection._create_connection = lambda _, *a, to=found[0][4][:2], **k: socket.create_connection(to, *a, **k)
            connection.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": AGENT, "Accept": "text/html,text/plain;q=0.9,*/*;q=0.5"})
            got = connection.getresponse()
            headers = {k.lower(): v for k, v in got.getheaders()}
            if 300 <= got.status < 400 and headers.get("location"):
                connection.close()
                url = urljoin(url, headers["location"])
                continue
            raw = got.read(most_bytes + 1)
            connection.close()
        except (OSError, http.client.HTTPException, ValueError) as e:
            return failed(hop, f"{type(e).__name__}: {e}"[:200])
        return (first, url, hop, got.status, headers, headers.get("content-type", ""), raw[:most_bytes].decode("utf-8", "replace"), len(raw) > most_bytes, None)
    return failed(most_redirects + 1, f"too many redirects (more than {most_redirects})")


def snapshot(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, meta, broken, unread) of responses: the inputs of the site engine.

    found: site, ord, kind (home, inner, robots, sitemap, llms, probe-http, probe-host, probe-missing) and the columns
    of SCHEMA. A site whose homepage cannot be audited has no pages and says why in ``unread`` (site, what, why). Files
    of a site are its own few rows, so one conditional aggregate gathers them; inner pages stay rows.
    """
    html = F.coalesce(F.col("content_type"), F.lit("")).contains("html")
    status, kind = F.col("status"), F.col("kind")
    gate = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("could not be reached: "), "error")).when(status.isin(401, 403, 429), F.format_string("blocks automated access (HTTP %d)", status))
        .when(status >= 400, F.format_string("returned an error (HTTP %d)", status)).when(~html, "is not a web page")
    )
    home = found.where(kind == "home").withColumn("gate", gate)
    open_sites = home.where("gate is null").select("site")
    kept = found.join(open_sites, "site", "left_semi")
    inner = kept.where(kind == "inner")
    whole = (status == 200) & html & F.col("error").isNull()
    is_home = kind == "home"
    pages = kept.where(is_home | ((kind == "inner") & whole)).select("site", F.when(is_home, 0).otherwise(F.col("ord") + 1).alias("page_idx"), is_home.alias("is_home"), "url", "final_url", "status", "headers", "body", "truncated")
    one = lambda k, v: F.max(F.when(kind == k, v))
    from ..operators.intake import text_file

    text = text_file(status, F.col("content_type"), F.col("body"))
    probe = lambda k, *names: one(k, F.when(status.isNotNull(), F.struct(*[F.col(n) for n in names])))
    meta = kept.where(kind != "inner").groupBy("site").agg(
        one("robots", text).alias("robots_txt"), one("sitemap", F.when((status == 200) & F.col("body").rlike(r"(?i)<(urlset|sitemapindex)[\s>]"), F.col("body"))).alias("sitemap_xml"), one("llms", text).alias("llms_txt"),
        F.struct(probe("probe-http", "final_url", "status").alias("http"), probe("probe-host", "url", "final_url", "status").alias("alternate_host"), probe("probe-missing", "status").alias("not_found")).alias("probes"),
    )
    broken = inner.where(status >= 400).select("site", "url", "status")
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("could not be fetched: "), "error")).when(status == 200, "is not a web page").otherwise(F.format_string("returned HTTP %d", status))
    unread = inner.where(~F.coalesce(whole, F.lit(False)) & ~F.coalesce(status >= 400, F.lit(False))).select("site", F.col("url").alias("what"), why.alias("why"))
    return pages, meta, broken, home.where("gate is not null").select("site", F.col("url").alias("what"), F.col("gate").alias("why")).unionByName(unread)


__all__ = ["FORMAT", "ResponseReader", "ResponseSource", "fetch", "follow", "record", "responses", "snapshot"]
