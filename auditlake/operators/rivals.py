"""Comparing a site with its rivals: score gaps, checks they pass, what only they have, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def score_gaps(own: DataFrame, rivals: DataFrame, least: int = 10) -> DataFrame:
    """own: site, module, score; rivals: site, rival, module, score. How many are ahead by ``least``, and who leads.

    Here and below joins are on the site alone, a site's own rows in one: tables partitioned by site meet without a shuffle.
    """
    mine = own.where("score is not null").groupBy("site").agg(F.collect_list(F.struct("module", F.col("score").alias("mine"))).alias("own"))
    j = rivals.where("score is not null").join(mine, "site").withColumn("own", F.explode(F.filter("own", lambda x: x["module"] == F.col("module")))).withColumn("mine", F.col("own.mine"))
    ahead = F.col("score") - F.col("mine") >= least
    agg = j.groupBy("site", "module", "mine").agg(F.count_if(ahead).alias("n_ahead"), F.max_by("rival", F.struct(F.col("score"), F.col("rival"))).alias("leader"), F.max("score").alias("best"))
    return agg.where("n_ahead > 0")


def common_checks(failed: DataFrame, passed: DataFrame, most: int = 4) -> DataFrame:
    """Own failed checks (site, id) that half of the rivals or more pass (site, rival, id); the most common first. A site has so many checks at most."""
    theirs = passed.groupBy("site", "rival").agg(F.collect_set("id").alias("ids")).groupBy("site").agg(F.count("rival").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    # An own check that is listed twice counts twice.
    own = failed.groupBy("site").agg(F.collect_list("id").alias("own"))
    counted = own.join(theirs, "site").select("site", "n", "own", "ids", F.explode(F.array_distinct("own")).alias("id")).select("site", "n", "id", (F.size(F.filter("own", lambda x: x == F.col("id"))) * F.size(F.filter("ids", lambda x: x == F.col("id")))).cast("long").alias("n_pass"))
    often = counted.where((F.col("n_pass") > 0) & (F.col("n_pass") >= F.ceil(F.col("n") / 2)))
    return often.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n_pass"), "id")).cast("long")).where(F.col("place") <= most)


def only_theirs(own: DataFrame, theirs: DataFrame, most: int = 5, least: int = 1) -> DataFrame:
    """Values (site, rival, value) that ``least`` rivals or more have and the site (site, value) has not."""
    counted = theirs.distinct().groupBy("site", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    has = own.groupBy("site").agg(F.collect_set("value").alias("own"))
    gap = counted.join(has, "site", "left").where(~F.coalesce(F.array_contains("own", F.col("value")), F.lit(False))).drop("own")
    return gap.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "value")).cast("long")).where(F.col("place") <= most)


def medians(own: DataFrame, theirs: DataFrame, factor: float = 1.5) -> DataFrame:
    """Sites whose number lies well below the median of their rivals' (site, rival, value)."""
    m = theirs.where("value is not null").groupBy("site").agg(T.js_round(F.median("value")).alias("median"))
    return m.join(own, "site").where(F.col("median") >= F.col("value") * factor)


def sentences(gaps: DataFrame, n_rivals: DataFrame, checks: DataFrame, theirs: DataFrame, words: DataFrame) -> DataFrame:
    """site, place, sentence: what the comparison says, in a fixed order; one line a site where it says nothing.

    gaps: as score_gaps, with ord for the module's place; n_rivals: site, n; checks: as common_checks, with label and n; theirs:
    as only_theirs; words: as medians, with value. Every kind has a bounded number of rows a site.
    """
    s, t = lambda c: F.col(c).cast("string"), F.lit
    of = F.concat(t(" of "), s("n_rivals"), t(" rivals "))
    parts = [
        gaps.join(n_rivals.withColumnRenamed("n", "n_rivals"), "site").select("site", t(0).alias("kind"), F.col("ord").cast("long").alias("ord"), F.concat(s("n_ahead"), of, t("lead by 10 points or more in "), "module", t(": "), s("leader"), t(" has "), s("best"), t(", you have "), s("mine"), t(".")).alias("sentence")),
        checks.join(n_rivals.withColumnRenamed("n", "n_rivals"), "site").select("site", t(1).alias("kind"), F.col("place").alias("ord"), F.concat(s("n_pass"), of, t("pass where you fail: "), "label", t(".")).alias("sentence")),
        theirs.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).select("site", t(2).alias("kind"), t(0).cast("long").alias("ord"), F.concat(t("Only rivals have: "), F.array_join(F.transform("v", lambda x: x["value"]), ", "), t(".")).alias("sentence")),
        words.select("site", t(3).alias("kind"), t(0).cast("long").alias("ord"), F.concat(t("Rivals' median is "), s("median"), t(" against your "), s("value"), t(".")).alias("sentence")),
    ]
    said = parts[0]
    for p in parts[1:]:
        said = said.unionByName(p)
    none = n_rivals.select("site", t(9).alias("kind"), t(0).cast("long").alias("ord"), t("No clear gap to these rivals.").alias("sentence"))
    order = Window.partitionBy("site").orderBy("kind", "ord", "sentence")
    # The last resort stands first only where it stands alone: what is said need not be worked out a second time to know.
    rows = said.unionByName(none).withColumn("least", F.min("kind").over(Window.partitionBy("site"))).where("kind < 9 or least = 9")
    return rows.select("site", F.row_number().over(order).cast("long").alias("place"), "sentence")
