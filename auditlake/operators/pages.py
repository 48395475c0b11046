"""Tables about pages and runs: the page table, the comparison with expected findings, what could not be checked, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def page_table(facts: DataFrame, evidence: DataFrame, *more: str) -> DataFrame:
    """url, title, headline, h1, words, issues of each page, and more columns of facts. facts: url, title, headline, h1, words; evidence: finding, url.

    A finding that names one page several times counts once; addresses are compared by their table key.
    """
    n = evidence.select(U.table_key(F.col("url")).alias("k"), "finding").distinct().groupBy("k").agg(F.count("*").alias("issues"))
    cut = facts.select(*more, "url", F.substring("title", 1, 120).alias("title"), F.substring("headline", 1, 120).alias("headline"), "h1", "words", U.table_key(F.col("url")).alias("k"))
    return cut.join(n, "k", "left").select(*more, "url", "title", "headline", "h1", "words", F.coalesce("issues", F.lit(0)).alias("issues"))


def compared(found: DataFrame, truth: DataFrame) -> DataFrame:
    """site, n_expected, n_found, n_false: findings (site, id) against truth (site, id, kind expect or absent, exact)."""
    t = truth.groupBy("site", "id").agg(F.max(F.col("kind") == "expect").alias("expected"))
    exact = truth.groupBy("site").agg(F.max("exact").alias("exact"))
    j = found.distinct().withColumn("hit", F.lit(True)).join(t, ["site", "id"], "full").join(exact, "site")
    wrong = F.col("hit") & (~F.col("expected") | (F.col("expected").isNull() & F.col("exact")))
    return j.groupBy("site").agg(F.count_if("expected").alias("n_expected"), F.count_if(F.col("expected") & F.col("hit")).alias("n_found"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("n_false"))


def could_not_check(*parts: DataFrame) -> DataFrame:
    """site, what, why of all sources in turn, each once."""
    out = parts[0].select("site", "what", "why")
    for p in parts[1:]:
        out = out.unionByName(p.select("site", "what", "why"))
    return out.distinct()


def run_metrics(runs: DataFrame, modules: DataFrame, steps: DataFrame) -> DataFrame:
    """run, metrics (map): runs: run and number columns; modules: run, module, score; steps: run, step, ms. Nulls are left out."""
    own = runs.select("run", F.explode(F.create_map(*[x for c in runs.columns if c != "run" for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    scores = modules.select("run", F.concat(F.lit("score_"), "module").alias("name"), F.col("score").cast("double").alias("value"))
    times = steps.groupBy("run", "step").agg(F.sum("ms").cast("double").alias("value")).select("run", F.concat(F.lit("step_ms_"), "step").alias("name"), "value")
    named = own.unionByName(scores).unionByName(times).where("value is not null")
    # Names are modules, steps and columns: a bounded list a run.
    return named.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))


def telemetry_totals(steps: DataFrame) -> DataFrame:
    """run, total_ms, n_done, n_warned, slowest of steps (run, step, ms, warned)."""
    return steps.groupBy("run").agg(F.sum("ms").alias("total_ms"), F.count_if(~F.col("warned")).alias("n_done"), F.count_if("warned").alias("n_warned"), F.max_by("step", F.struct("ms", "step")).alias("slowest"))


def shared_values(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """site, rival, n_shared: how many values (site, value) a rival (site, rival, value) has too."""
    both = theirs.distinct().join(own.distinct().withColumn("mine", F.lit(1)), ["site", "value"], "left")
    return both.groupBy("site", "rival").agg(F.count("mine").alias("n_shared"))


def positional(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str = "ord") -> DataFrame:
    """Rows of two lists paired by their places, not by the order in which they lie."""
    return left.join(right, [*keys, ordinal])

