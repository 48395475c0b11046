"""URL functions as Catalyst expressions: parts, the four page identities, domains, validation, address ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import has

# Suffixes with two labels, blocked networks, assets, platforms, markets.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.za com.br com.mx co.jp co.in com.sg com.hk com.cn".split()
BLOCKED_NETWORKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
BLOCKED_NETWORKS_6 = [("::", 127), ("64:ff9b::", 96), ("2001:db8::", 32), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8)]
ASSET = r"\.(png|jpe?g|gif|webp|svg|ico|css|js|mjs|pdf|zip|gz|mp4|mp3|woff2?|ttf|xml|json|txt)$"
PLATFORM_HOSTS = [
    ("facebook.com", "facebook", "www.facebook.com"), ("fb.com", "facebook", "www.facebook.com"), ("fb.me", "facebook", "www.facebook.com"), ("instagram.com", "instagram", "www.instagram.com"), ("x.com", "x", "x.com"),
    ("twitter.com", "x", "x.com"), ("linkedin.com", "linkedin", "www.linkedin.com"), ("youtube.com", "youtube", "www.youtube.com"), ("tiktok.com", "tiktok", "www.tiktok.com"), ("pinterest.com", "pinterest", "www.pinterest.com"),
    ("pinterest.com.au", "pinterest", "www.pinterest.com"), ("github.com", "github", "github.com"),
]
RESERVED_PATHS = (
    "explore home search i hashtag intent share sharer settings about login signup policies help privacy terms tr dialog plugins watch embed pin p reel reels stories tv oauth legal business ads directory "
    "public feed results playlist shorts"
).split()
NOT_EXTERNAL = "facebook.com instagram.com twitter.com x.com linkedin.com youtube.com tiktok.com pinterest.com github.com wa.me t.me".split()
NOT_COMPETITORS = (
    "facebook.com instagram.com linkedin.com youtube.com x.com twitter.com tiktok.com pinterest.com reddit.com github.com google.com bing.com wikipedia.org amazon.com amazon.com.au ebay.com ebay.com.au "
    "gumtree.com.au yelp.com yellowpages.com.au trustpilot.com quora.com medium.com"
).split()
MARKETS = {"au": "Australia", "uk": "the United Kingdom", "nz": "New Zealand", "ca": "Canada", "ie": "Ireland", "de": "Germany", "in": "India", "sg": "Singapore", "za": "South Africa", "fr": "France"}

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query with its mark; empty where there is none."""
    return F.regexp_extract(F.trim(url), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when((p == "") & (host(url) != ""), "/").otherwise(p)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def trimmed_path(url: Column) -> Column:
    return F.regexp_replace(path(url), r"/+\z", "")


def page_key(url: Column) -> Column:
    """Host without www and path without closing slashes, query dropped, root empty; null if not absolute."""
    return F.when(host(url) != "", F.concat(bare_host(url), trimmed_path(url)))


def crawl_key(url: Column) -> Column:
    """The same with root as a slash."""
    p = trimmed_path(url)
    return F.when(host(url) != "", F.concat(bare_host(url), F.when(p == "", "/").otherwise(p)))


def sitemap_key(url: Column) -> Column:
    """crawl_key with the query."""
    query = part(url, 5)
    return F.concat(crawl_key(url), F.when(query == "?", "").otherwise(query))


def table_key(url: Column) -> Column:
    """page_key; an address that cannot be read stays as it is."""
    return F.coalesce(page_key(url), url)


def is_asset(url: Column) -> Column:
    return path(url).rlike("(?i)" + ASSET)


def registrable(name: Column) -> Column:
    """The last two labels, three below a suffix of two."""
    labels = F.split(F.regexp_replace(F.lower(name), r"\.\z", ""), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def market(domain: Column) -> Column:
    last = F.element_at(F.split(F.lower(domain), r"\."), -1)
    out = F.lit(None).cast("string")
    for tld, name in MARKETS.items():
        out = F.when((last == tld) & domain.contains("."), name).otherwise(out)
    return out


def target_error(raw: Column) -> Column:
    """Why an address is not audited; null if it is fine."""
    t = F.trim(raw)
    full = F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    h, port = host(full), part(full, 3)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(F.length(t) > 2048, "too long")
        .when((h == "") | h.rlike(r"[^a-z0-9.\-\[\]_]") | h.rlike(r"\.\."), "not an address")
        .when(~scheme(full).isin("http", "https"), "scheme")
        .when(full.rlike("^[^/]*//[^/?#]*@"), "credentials")
        .when(~port.isin("", "80", "443"), "port")
        .when(h.rlike(r"^[0-9.]+\z") | h.startswith("["), "ip address")
        .when(~h.contains(".") | (h == "localhost") | h.endswith(".local") | h.endswith(".internal"), "not public")
    )


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is none."""
    octets = F.split(ip, r"\.")
    good = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(good, number)


def address_hex(ip: Column) -> Column:
    """An IPv4 or IPv6 address as 32 hexadecimal digits, which order as the numbers do; null if it is none.

    IPv4 addresses become the IPv4-mapped ones of IPv6, so that one list of ranges serves both. A zone (%eth0) is left out.
    """
    v4 = ipv4_number(ip)
    t = F.lower(F.split_part(ip, F.lit("%"), F.lit(1)))
    tail = ipv4_number(F.regexp_extract(t, r":([0-9.]+)\z", 1))
    dotted = F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]+\z", 1), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(65535))))
    t = F.when(t.contains("."), dotted).otherwise(t)
    groups = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))
    short = t.contains("::")
    head, rest = groups(F.split_part(t, F.lit("::"), F.lit(1))), F.when(short, groups(F.split_part(t, F.lit("::"), F.lit(2)))).otherwise(F.array().cast("array<string>"))
    n = F.size(head) + F.size(rest)
    good = F.forall(F.concat(head, rest), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z")) & ~t.contains(":::") & (F.split_part(t, F.lit("::"), F.lit(3)) == "") & F.when(short, n <= 7).otherwise(n == 8)
    digits = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
    v6 = F.when(good, F.concat(digits(head), F.repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - n)), digits(rest)))
    return F.when(v4.isNotNull(), F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(v4), 8, "0")))).when(ip.contains(":"), v6)


def address_ranges() -> list[tuple[str, str, str]]:
    """(network, first, last) of all networks that no public site is in, as address_hex has addresses."""
    import ipaddress

    nets = [(f"{n}/{b}", ipaddress.ip_network(f"::ffff:{n}/{96 + b}")) for n, b in BLOCKED_NETWORKS] + [(f"{n}/{b}", ipaddress.ip_network(f"{n}/{b}")) for n, b in BLOCKED_NETWORKS_6]
    return [(name, f"{int(x[0]):032x}", f"{int(x[-1]):032x}") for name, x in nets]


def is_blocked_address(ip: Column) -> Column:
    """Whether an address is none that a public site resolves to; what is no address is blocked too."""
    h = address_hex(ip)
    listed = F.lit(False)
    for _, lo, hi in address_ranges():
        listed = listed | h.between(lo, hi)
    return F.coalesce(listed, F.lit(True))


def without_dots(p: Column) -> Column:
    """A path that begins with a slash, its . and .. segments worked off; they may be written with %2e."""
    one, two = F.lit("(?i)^(\\.|%2e)\\z"), F.lit("(?i)^(\\.|%2e){2}\\z")
    return _once(F.split(F.substring(p, 2, 1 << 30), "/", -1), lambda segments: _worked_off(segments, one, two))


def _worked_off(segments: Column, one: Column, two: Column) -> Column:
    kept = F.aggregate(segments, F.lit(""), lambda acc, x: F.when(F.rlike(x, two), F.regexp_replace(acc, r"/[^/]*\z", "")).when(F.rlike(x, one), acc).otherwise(F.concat(acc, F.lit("/"), x)))
    last = F.element_at(segments, -1)
    return _once(kept, lambda k: F.concat(k, F.when(F.rlike(last, one) | F.rlike(last, two) | (k == ""), "/").otherwise("")))


def _once(value: Column, f) -> Column:
    """f(value) with value evaluated a single time: a plan repeats an expression wherever it is used."""
    return F.transform(F.array(value), f)[0]


def resolve(href: Column, base: Column) -> Column:
    """A reference in markup made absolute against an http address, without its fragment; null if that is no web address.

    Blanks around it and line ends and tabs inside count for nothing, backslashes are slashes; scheme and host are
    lower-cased, default ports dropped, an empty path is a slash.
    """
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+\z|(?<!^)[\t\n\r]+", ""), r"#(?s).*\z", "")
    slashed = lambda r: F.concat(F.replace(F.regexp_extract(r, r"^([^?]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(r, r"(\?(?s).*)\z", 1))
    of_base = F.struct(scheme(base).alias("scheme"), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1).alias("host"), F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"))

    def full(r: Column, b: Column) -> Column:
        root, path = F.concat(b["scheme"], F.lit("://"), b["host"]), F.when(b["path"] == "", "/").otherwise(b["path"])
        return (
            F.when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.when(r.rlike(r"(?i)^https?://"), r)).when(r.startswith("//"), F.concat(b["scheme"], F.lit(":"), r)).when(r.startswith("/"), F.concat(root, r)).when(r == "", F.concat(root, path, b["query"]))
            .when(r.startswith("?"), F.concat(root, path, r)).otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*\z", ""), r))
        )

    def normal(u: Column) -> Column:
        parts = r"^([a-zA-Z]+)://(?:[^/?@]*@)?([^/?:]*)(?::([0-9]*))?(/[^?]*)?(\?(?s).*)?\z"
        return _once(F.struct(*[F.lower(F.regexp_extract(u, parts, i)).alias(n) if i < 3 else F.regexp_extract(u, parts, i).alias(n) for i, n in enumerate(("s", "h", "port", "p", "q"), 1)]), joined)

    def joined(x: Column) -> Column:
        port = F.when((x["port"] == "") | ((x["s"] == "http") & (x["port"] == "80")) | ((x["s"] == "https") & (x["port"] == "443")), "").otherwise(F.concat(F.lit(":"), x["port"]))
        dots = F.when(x["p"] == "", "/").when(~x["p"].rlike(r"(?i)/(\.|%2e)"), x["p"]).otherwise(without_dots(x["p"]))  # most paths have none to work off
        return F.when((x["h"] != "") & x["s"].isin("http", "https"), F.concat(x["s"], F.lit("://"), x["h"], port, dots, F.when(x["q"] == "?", "").otherwise(x["q"])))

    return _once(of_base, lambda b: _once(_once(clean, slashed), lambda r: _once(full(r, b), normal)))


def network_range(net: str, bits: int) -> tuple[int, int]:
    a = 0
    for x in net.split("."):
        a = a * 256 + int(x)
    return a, a + 2 ** (32 - bits) - 1


def platform_of(name: Column) -> Column:
    """Index into PLATFORM_HOSTS of the first host that is the name or a parent of it."""
    out = F.lit(None).cast("int")
    for i in range(len(PLATFORM_HOSTS) - 1, -1, -1):
        h = PLATFORM_HOSTS[i][0]
        out = F.when((name == h) | name.endswith("." + h), i).otherwise(out)
    return out


def social_profile(url: Column) -> Column:
    """struct<platform, url, handle, kind> of a link to a social site; null for anything else."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    read = F.struct(platform_of(host(url)).alias("k"), segments.alias("segments"), scheme(url).isin("http", "https").alias("web"), F.nullif(F.regexp_extract(part(url, 5), r"[?&]id=([^&]+)", 1), F.lit("")).alias("id"))
    # Bound once: each part is used many times below, and the plan would repeat it each time.
    return _once(read, _profile)


def _profile(read: Column) -> Column:
    names = F.array(*[F.lit(p) for _, p, _ in PLATFORM_HOSTS])
    homes = F.array(*[F.lit(c) for *_, c in PLATFORM_HOSTS])
    k, segments = read["k"], read["segments"]
    platform, home = F.get(names, k), F.get(homes, k)
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    two = lambda *heads: F.when(first.isin(*heads) & second.isNotNull(), F.concat_ws("/", first, second))
    handle = (
        F.when(platform == "linkedin", two("company", "in", "school"))
        .when(platform == "youtube", F.coalesce(F.when(first.startswith("@"), first), two("channel", "c", "user")))
        .when((platform == "facebook") & (first == "profile.php"), F.concat(F.lit("profile.php?id="), read["id"]))
        .when((platform == "facebook") & first.isin("pages", "people", "groups") & second.isNotNull(), F.concat_ws("/", first, second))
        .when(platform == "tiktok", F.when(first.startswith("@"), first))
        .otherwise(first)
    )
    web = read["web"] & k.isNotNull()
    make = lambda u, h, kind: F.struct(platform.alias("platform"), u.alias("url"), h.alias("handle"), F.lit(kind).alias("kind"))
    front = make(F.concat(F.lit("https://"), home, F.lit("/")), F.lit(None).cast("string"), "homepage")
    profile = make(F.concat(F.lit("https://"), home, F.lit("/"), handle), handle, "profile")
    return F.when(web & (F.size(segments) == 0), front).when(web & ~F.lower(first).isin(RESERVED_PATHS) & handle.isNotNull(), profile)


def clean_domain(raw: Column, own: Column) -> Column:
    """A bare public domain that may be a rival's; null otherwise."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "^https?://", ""), r"[/?#].*\z", "")
    d = F.regexp_replace(d, r"^www\.", "")
    listed = F.lit(False)
    for x in NOT_COMPETITORS:
        listed = listed | (d == x) | d.endswith("." + x)
    ok = d.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+\z") & target_error(d).isNull() & ~listed & (registrable(d) != registrable(own))
    return F.when(ok, d)


__all__ = [n for n in dir() if n.islower() and n not in ("annotations", "has")]
