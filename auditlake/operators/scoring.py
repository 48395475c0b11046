"""From outcomes to scores, rankings and reports. All orders are total: module order, then rule order, break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalogue import EFFORTS, MODULE_WEIGHTS, MODULES, SEVERITIES

# The readiness lens. component: (weight, {module:rule: weight}).
READINESS = {
    "crawler-access": (25, {"geo:ai-crawler-oai-searchbot": 10, "geo:ai-crawler-claude-searchbot": 10, "geo:ai-crawler-perplexitybot": 10, "geo:ai-crawler-googlebot": 6, "technical:indexable": 10}),
    "structured-data": (20, {"technical:structured-data": 10, "technical:json-ld-valid": 8, "technical:schema-complete": 8, "citation:schema-fit": 8, "crawl:render-schema": 6}),
    "answer-blocks": (20, {"geo:question-headings": 10, "geo:question-answers": 3, "geo:citable-passage": 14, "content:readability": 5, "citation:answer-passage": 14, "citation:structure": 5}),
    "entity-clarity": (15, {"geo:organisation-schema": 12, "technical:canonical": 4, "content:about-page": 4, "citation:entity-early": 10, "citation:definition": 8}),
    "render-parity": (12, {"geo:content-in-html": 20, "technical:not-truncated": 4, "crawl:render-links": 8, "crawl:render-headings": 8, "crawl:render-hydration": 8}),
    "freshness": (8, {"geo:freshness-signals": 4, "geo:llms-txt": 2}),
}


def rank_of(c: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(len(names))
    for i, n in reversed(list(enumerate(names))):
        out = F.when(c == n, i).otherwise(out)
    return out


def earned() -> Column:
    """What an outcome contributes: its weight, or a part of it between nothing and all."""
    credit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("credit"), F.lit(0.0))))
    return F.col("weight") * F.when(F.col("passed"), F.lit(1.0)).otherwise(credit)


def module_scores(outcomes: DataFrame, unchecked: DataFrame | None = None) -> DataFrame:
    """site, module, score, status, n_passed, n_findings. unchecked: site, module of what could not be checked.

    Sums of credits depend on their order in the last bits; rounded to nine places first, a half is a half on any cluster.
    """
    agg = outcomes.groupBy("site", "module").agg(
        T.js_round(F.round(F.try_divide(F.sum(earned()) * 100, F.nullif(F.sum("weight").cast("double"), F.lit(0.0))), 9)).alias("score"), F.count_if("passed").alias("n_passed"), F.count("finding").alias("n_findings")
    )
    if unchecked is None:
        return agg.withColumn("status", F.lit("ok"))
    gaps = unchecked.groupBy("site", "module").agg(F.count("*").alias("n_gaps"))
    out = agg.join(gaps, ["site", "module"], "full")
    return out.withColumn("status", F.when(F.col("n_passed").isNull(), "failed").when(F.col("n_gaps").isNotNull(), "partial").otherwise("ok")).drop("n_gaps")


def overall_scores(modules: DataFrame) -> DataFrame:
    weight = F.lit(0)
    for m, w in MODULE_WEIGHTS.items():
        weight = F.when(F.col("module") == m, w).otherwise(weight)
    scored = modules.where("score is not null").withColumn("w", weight)
    return scored.groupBy("site").agg(T.js_round(F.try_divide(F.sum(F.col("score") * F.col("w")).cast("double"), F.nullif(F.sum("w"), F.lit(0)))).alias("overall")).withColumn("grade", T.grade(F.col("overall")))


def strongest_weakest(modules: DataFrame) -> DataFrame:
    """The best and worst module of a site; the first in order wins a tie; competitors do not count."""
    order = rank_of(F.col("module"), MODULES)
    m = modules.where("score is not null and module <> 'competitors'")
    return m.groupBy("site").agg(
        F.max_by("module", F.struct("score", -order)).alias("strongest"), F.max("score").alias("best"), F.min_by("module", F.struct("score", order)).alias("weakest"), F.min("score").alias("worst")
    )


def findings(outcomes: DataFrame) -> DataFrame:
    """site, module_ord, check_ord, id, severity, effort, title, sev, eff."""
    f = outcomes.where("finding is not null").select("site", "module_ord", "check_ord", "finding.id", "finding.severity", "finding.effort", "finding.title")
    return f.withColumn("sev", rank_of(F.col("severity"), SEVERITIES)).withColumn("eff", rank_of(F.col("effort"), EFFORTS))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("site").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def _placed(found: DataFrame, by: list, within: list | None = None) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy("site", *(within or [])).orderBy(*by)).cast("long"))


def top_fixes(found: DataFrame, most: int = 10) -> DataFrame:
    return _placed(found, ["sev", "eff", "module_ord", "check_ord"]).where(F.col("place") <= most)


def quick_wins(found: DataFrame, most: int = 5) -> DataFrame:
    return _placed(found.where("effort = 'low' and sev <= 2"), ["sev", "module_ord", "check_ord"]).where(F.col("place") <= most)


def roadmap(found: DataFrame) -> DataFrame:
    """Ids by effort, the most severe first."""
    rows = found.groupBy("site", "effort").agg(F.array_sort(F.collect_list(F.struct("sev", "module_ord", "check_ord", "id"))).alias("f"))
    return rows.select("site", "effort", F.array_join("f.id", " ").alias("ids"))


def quadrant(sev: Column, hard: Column) -> Column:
    high = sev <= 1
    return F.when(high & ~hard, "quick wins").when(high, "big bets").when(~hard, "fill-ins").otherwise("deprioritise")


def impact_matrix(found: DataFrame) -> DataFrame:
    return _placed(found.withColumn("quadrant", quadrant(F.col("sev"), F.col("effort") == "high")), ["sev", "eff", "module_ord", "check_ord"], ["quadrant"])


def chart_layout(matrix: DataFrame, width: float, height: float) -> DataFrame:
    """A dot for each finding: number, x and y; the largest radius that lets the fullest quadrant fit."""
    qw, qh = width / 2, height / 2
    full = matrix.groupBy("site", "quadrant").agg(F.count("*").alias("n")).groupBy("site").agg(F.max("n").alias("fullest"))
    largest = min(14.0, qw / 6, qh / 6)
    sizes, r = [largest], largest
    while r > 2:
        r -= 0.5
        sizes.append(r)
    grid = lambda r: (max(1, int((qw - r) // (r * 2.4))), max(1, int((qh - r) // (r * 2.4))))
    radius = F.lit(sizes[-1])
    for r in reversed(sizes[:-1]):
        radius = F.when(F.col("fullest") <= grid(r)[0] * grid(r)[1], r).otherwise(radius)
    m = matrix.join(full, "site").withColumn("radius", radius)
    columns = F.greatest(F.lit(1), F.floor((qw - F.col("radius")) / (F.col("radius") * 2.4)))
    q = rank_of(F.col("quadrant"), ("quick wins", "big bets", "fill-ins", "deprioritise"))
    n = F.row_number().over(Window.partitionBy("site").orderBy(q, "place")).cast("long")
    k, step = F.col("place") - 1, F.col("radius") * 2.4
    x = q % 2 * qw + F.col("radius") + 4 + (k % columns) * step
    y = F.floor(q / 2) * qh + F.col("radius") + 4 + F.floor(k / columns) * step
    return m.select("site", "id", n.alias("n"), "radius", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def members(spark) -> DataFrame:
    rows = [(c, w, *k.split(":"), m) for c, (w, ms) in READINESS.items() for k, m in ms.items()]
    return spark.createDataFrame(rows, "component string, component_weight int, module string, id string, member_weight int")


def readiness(outcomes: DataFrame) -> DataFrame:
    """site, component, component_weight, score, n_failed over members that ran: passed, or with a finding."""
    ran = outcomes.where("passed or finding is not null").select("site", "module", "id", "passed")
    j = ran.join(F.broadcast(members(outcomes.sparkSession)), ["module", "id"])
    good = F.sum(F.when(F.col("passed"), F.col("member_weight")).otherwise(0))
    return j.groupBy("site", "component", "component_weight").agg(T.js_round(good * 100.0 / F.sum("member_weight")).alias("score"), F.count_if(~F.col("passed")).alias("n_failed"))


def not_run(outcomes: DataFrame) -> DataFrame:
    """site, component, id of the members that no outcome of the site tells of: they count neither way, and are named."""
    ran = outcomes.where("passed or finding is not null").select("site", "module", "id")
    asked = outcomes.select("site").distinct().select("site", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(k.split(":")[0]).alias("module"), F.lit(k.split(":")[1]).alias("id")) for c, (_, ms) in READINESS.items() for k in ms])).alias("m")).select("site", "m.*")
    return asked.join(ran, ["site", "module", "id"], "left_anti").select("site", "component", F.concat_ws(":", "module", "id").alias("member"))


def readiness_total(components: DataFrame) -> DataFrame:
    t = components.groupBy("site").agg(T.js_round(F.sum(F.col("score") * F.col("component_weight")).cast("double") / F.sum("component_weight")).alias("score"))
    return t.withColumn("band", T.readiness_band(F.col("score")))


def readiness_gaps(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """The failed members that cost most: member times component weight."""
    failed = outcomes.where("not passed and finding is not null").select("site", "module", "id")
    j = failed.join(F.broadcast(members(outcomes.sparkSession)), ["module", "id"]).withColumn("lost", (F.col("member_weight") * F.col("component_weight")).cast("long"))
    return j.select("site", F.concat_ws(":", "module", "id").alias("gap"), "lost").withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("lost"), "gap")).cast("long")).where(F.col("place") <= most)


def idea_findings(found: DataFrame, per_module: int = 5, most: int = 12) -> DataFrame:
    """The findings ideas may build on: the worst of each module, then the first in module order."""
    own = found.withColumn("k", F.row_number().over(Window.partitionBy("site", "module_ord").orderBy("sev", "check_ord"))).where(F.col("k") <= per_module)
    return _placed(own, ["module_ord", "k"]).where(F.col("place") <= most)


def verdict_sentence() -> Column:
    """One sentence by fixed templates, of overall, grade, strongest, best, weakest, worst, the counts by severity and n_quick."""
    n = F.coalesce(F.col("critical") + F.col("high") + F.col("medium") + F.col("low"), F.lit(0))
    quick = F.coalesce(F.col("n_quick"), F.lit(0))
    areas = F.when(F.col("best") != F.col("worst"), F.format_string("Strongest: %s (%d), weakest: %s (%d).", "strongest", "best", "weakest", "worst"))
    issues = F.when(n == 0, "No issues found.").otherwise(F.concat(n.cast("string"), F.when(n == 1, " issue").otherwise(" issues"), F.when(quick == 0, "").otherwise(F.concat(F.lit(", "), quick.cast("string"), F.when(quick == 1, " quick win").otherwise(" quick wins"))), F.lit(".")))
    return F.concat_ws(" ", F.format_string("Grade %s (%d/100).", "grade", "overall"), areas, issues)


def verdicts(overall: DataFrame, ends: DataFrame, counts: DataFrame, wins: DataFrame) -> DataFrame:
    """One sentence a site."""
    j = overall.join(ends, "site", "left").join(counts, "site", "left").join(wins.groupBy("site").agg(F.count("*").alias("n_quick")), "site", "left")
    return j.select("site", verdict_sentence().alias("verdict"))
