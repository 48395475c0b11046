"""robots.txt as rows: parsing and deciding, for many sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(texts: DataFrame, site: str = "site", text: str = "robots_txt") -> DataFrame:
    """site, grp, kind (agent, allow, disallow or sitemap), value, ordinal; one row per meaning line.

    Consecutive user-agent lines share a group; rules before any agent belong to none and are left out.
    """
    lines = texts.where(F.col(text).isNotNull()).select(F.col(site).alias("site"), F.posexplode(F.split(text, r"\r?\n")).alias("ordinal", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*", ""))
    parts = lines.select("site", "ordinal", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("value"), line.contains(":").alias("ok")).where("ok")
    # A sitemap line does not end a run of agents; every other line does.
    run = Window.partitionBy("site").orderBy("ordinal")
    known = parts.where("key <> 'sitemap'").withColumn("before", F.lag("key").over(run))
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.col("before"), F.lit("")) != "user-agent")
    grouped = known.withColumn("grp", F.sum(starts.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(F.col("key") == "user-agent", "agent").otherwise(F.col("key"))
    rules = grouped.where("grp > 0 and ((key in ('allow', 'disallow') and value <> '') or key = 'user-agent')").select("site", "grp", kind.alias("kind"), F.when(kind == "agent", F.lower("value")).otherwise(F.col("value")).alias("value"), "ordinal")
    maps = parts.where("key = 'sitemap' and value <> ''").select("site", F.lit(None).cast("long").alias("grp"), F.lit("sitemap").alias("kind"), "value", "ordinal")
    return rules.unionByName(maps)


def tokens(agent):
    """Product tokens of a user agent, its contact address left out."""
    return F.filter(F.split(F.lower(F.regexp_replace(agent, r"\(\+[^)]*\)", " ")), "[^a-z0-9._-]+"), lambda x: x != "")


def fits(path: Column, rule: Column) -> Column:
    """Whether a rule's path fits: a star is any text, a closing dollar sign the end.

    The pieces between stars are looked for one after another, each at its first place, so a rule of many stars
    costs no more than its length times the path's.
    """
    anchored = rule.endswith("$")
    pieces = F.split(F.when(anchored, F.left(rule, F.length(rule) - 1)).otherwise(rule), r"\*+", -1)
    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    middle = F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - F.when(anchored, 2).otherwise(1)))
    after = lambda at, x: F.position(x, path, at)
    step = lambda at, x: F.when((at == 0) | (x == ""), at).when(after(at, x) == 0, 0).otherwise(after(at, x) + F.length(x))
    at = F.aggregate(middle, F.when(path.startswith(first), F.length(first) + 1).otherwise(0), step)
    end = F.when(F.size(pieces) == 1, path == first).otherwise((at > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at))
    return F.when(anchored, end).otherwise(at > 0)


def decide(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (site, agent, path) with ``allowed``.

    Groups that name the agent count together, else those of the star; the longest fitting rule wins, allow on a
    tie; nothing that fits means allowed. A join of rules with requests by site, then an argmax.
    """
    r = requests.withColumn("rid", F.xxhash64("site", "agent", "path")).withColumn("tokens", tokens(F.col("agent")))
    agents = parsed.where("kind = 'agent'").select("site", "grp", F.col("value").alias("name"))
    rules = parsed.where("kind in ('allow', 'disallow')").select("site", "grp", "kind", "value")
    named = r.join(agents, "site").where(F.array_contains("tokens", F.col("name")) & (F.col("name") != "*"))
    star = r.join(agents.where("name = '*'"), "site")
    own = named.select("site", "agent", "path", "grp").distinct()
    rest = star.join(named.select("rid").distinct(), "rid", "left_anti").select("site", "agent", "path", "grp").distinct()
    fit = own.unionByName(rest).join(rules, ["site", "grp"]).where(fits(F.col("path"), F.col("value")))
    best = fit.groupBy("site", "agent", "path").agg(F.max_by(F.col("kind") == "allow", F.struct(F.length("value"), F.col("kind") == "allow")).alias("verdict"))
    return requests.join(best, ["site", "agent", "path"], "left").select(*requests.columns, F.coalesce("verdict", F.lit(True)).alias("allowed"))
