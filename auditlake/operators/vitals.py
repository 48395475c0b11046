"""Measurements from speed replies of unknown shape, read as variants: no schema, nothing trusted, malformed ones left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

MOST_SHIFTS, MOST_BLOCKERS, MOST_SCRIPTS = 4, 5, 3
_AUDITS = "$.lighthouseResult.audits"
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def number(v: Column, path: str) -> Column:
    """A number at a path, null for anything else, also for numbers written as text."""
    is_number = T.once(F.schema_of_variant(F.try_variant_get(v, path, "variant")), lambda k: k.isin(*_NUMBERS) | k.startswith("DECIMAL"))
    return F.when(is_number, F.try_variant_get(v, path, "double"))


def string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def items(v: Column, audit: str) -> Column:
    """The items of an audit as variants; an empty array where there are none."""
    return F.coalesce(F.try_variant_get(v, f"{_AUDITS}['{audit}'].details.items", "array<variant>"), F.array().cast("array<variant>"))


def _first_node(found: Column) -> Column:
    """struct<selector, snippet> of the first element, whether it stands in an item or in a table inside one."""
    node = lambda x: F.struct(string(x, "$.node.selector").alias("selector"), string(x, "$.node.snippet").alias("snippet"))
    nested = F.flatten(F.transform(found, lambda x: F.concat(F.array(node(x)), F.transform(F.coalesce(F.try_variant_get(x, "$.items", "array<variant>"), F.array().cast("array<variant>")), node))))
    return F.get(F.filter(nested, lambda n: n["selector"].isNotNull() | n["snippet"].isNotNull()), F.lit(0))


def _resource(snippet: Column, page: Column) -> Column:
    src = F.coalesce(F.nullif(F.regexp_extract(snippet, r"(?i)(?:^|[^A-Za-z0-9_])src=[\"']([^\"']+)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(snippet, r"(?i)url\([\"']?([^)\"']+)[\"']?\)", 1), F.lit("")))
    return U.resolve(src, page)


def rating(ms: Column) -> Column:
    return F.when(ms <= 200, "good").when(ms <= 500, "needs improvement").when(ms.isNotNull(), "poor")


def read_vitals(replies: DataFrame, key: str, url: str = "url", reply: str = "reply") -> DataFrame:
    """key, parsed, lcp_element, lcp_resource, shifts, inp_ms, inp_rating, blockers, scripts of each reply.

    shifts: the largest layout shifts; blockers: the first files that block rendering; scripts: the slowest script files, the
    page itself and labels that are no address left out. A reply that is no JSON has parsed false and nothing else.
    """
    v = F.col("v")
    # Largest first, the earlier one where numbers tie: the negative number and the place lead the struct.
    shift = F.transform(items(v, "layout-shifts"), lambda x, i: F.struct((-number(x, "$.score")).alias("down"), i.alias("i"), F.coalesce(string(x, "$.node.selector"), string(x, "$.node.snippet"), F.lit("")).alias("selector"), F.try_variant_get(x, "$.node", "variant").isNotNull().alias("node")))
    shifts = F.slice(F.sort_array(F.filter(shift, lambda s: s["node"] & s["down"].isNotNull())), 1, MOST_SHIFTS)
    blocker = F.transform(items(v, "render-blocking-resources"), lambda x: F.struct(string(x, "$.url").alias("url"), T.js_round(number(x, "$.wastedMs")).alias("ms")))
    blockers = F.slice(F.filter(blocker, lambda b: b["url"].isNotNull() & b["ms"].isNotNull()), 1, MOST_BLOCKERS)
    script = F.transform(items(v, "bootup-time"), lambda x, i: F.struct((-number(x, "$.total")).alias("down"), i.alias("i"), string(x, "$.url").alias("url")))
    page = F.col("page")
    plain = lambda u: F.concat(U.scheme(u), F.lit("://"), U.host(u), U.part(u, 3), U.trimmed_path(u), U.part(u, 5))
    scripts = F.slice(F.sort_array(F.filter(script, lambda s: s["url"].rlike("(?i)^https?://") & s["down"].isNotNull() & (T.once(s["url"], plain) != page))), 1, MOST_SCRIPTS)
    inp = T.js_round(number(v, "$.loadingExperience.metrics.INTERACTION_TO_NEXT_PAINT.percentile"))
    paint = T.once(_first_node(items(v, "largest-contentful-paint-element")), lambda n: F.struct(n["selector"].alias("element"), T.once(n["snippet"], lambda x: _resource(x, F.col(url))).alias("resource")))
    # The explode keeps the reply from being parsed again for each column.
    read = replies.select(key, url, F.inline(F.array(F.struct(plain(F.col(url)).alias("page"), F.try_parse_json(F.col(reply)).alias("v")))))
    out = read.select(
        key, v.isNotNull().alias("parsed"), F.inline(F.array(F.struct(paint.alias("paint"), inp.alias("inp_ms")))), F.transform(shifts, lambda s: F.struct(s["selector"].alias("selector"), (-s["down"]).alias("score"))).alias("shifts"),
        blockers.alias("blockers"), F.transform(scripts, lambda s: F.struct(s["url"].alias("url"), T.js_round(-s["down"]).alias("ms"))).alias("scripts"),
    )
    return out.select(key, "parsed", F.col("paint.element").alias("lcp_element"), F.col("paint.resource").alias("lcp_resource"), "shifts", "inp_ms", rating(F.col("inp_ms")).alias("inp_rating"), "blockers", "scripts")


def merged(speed: DataFrame, browser: DataFrame, key: str) -> DataFrame:
    """key, source, lcp_ms, cls, inp_ms, inp_rating, inp_source: a speed run's numbers, from the browser what it lacks.

    speed: key, lcp_ms, cls, inp_ms (null without field data); browser: key, light, lcp_ms, cls_milli, inp_ms. A page that
    the browser measured without its images and styles says nothing.
    """
    s = speed.select(key, F.col("lcp_ms").alias("s_lcp"), F.col("cls").alias("s_cls"), F.col("inp_ms").alias("s_inp"), F.lit(True).alias("s"))
    b = browser.where(~F.coalesce("light", F.lit(False))).select(key, F.col("lcp_ms").alias("b_lcp"), F.col("cls_milli").alias("b_cls"), F.when(F.col("inp_ms") > 0, F.col("inp_ms")).alias("b_inp"))
    j = s.join(b, key, "full")
    own, lab = F.col("s").isNotNull(), F.col("b_lcp") > 0
    inp = F.coalesce("s_inp", "b_inp")
    out = j.where(own | lab).select(
        key, F.when(own, "speed").otherwise("browser").alias("source"), F.when(own, F.col("s_lcp")).otherwise(F.col("b_lcp")).alias("lcp_ms"), F.when(own, F.col("s_cls")).otherwise(F.coalesce("b_cls", F.lit(0)) / 1000).alias("cls"),
        inp.alias("inp_ms"), rating(inp).alias("inp_rating"), F.when(F.col("s_inp").isNotNull(), "field").when(F.col("b_inp").isNotNull(), "lab").alias("inp_source"),
    )
    return out
