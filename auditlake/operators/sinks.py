"""Reports as text: Markdown, the fix prompt, ready-to-paste items. String columns only; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What each ready-to-paste item answers to.
KIT = {
    "canonical": ("technical:canonical", "technical:canonical-valid"), "robots.txt": ("technical:robots-txt", "technical:robots-sitemap", "geo:ai-crawler-oai-searchbot", "geo:ai-crawler-claude-searchbot", "geo:ai-crawler-perplexitybot", "geo:ai-crawler-googlebot"),
    "sitemap.xml": ("technical:sitemap", "technical:sitemap-quality"), "organization": ("geo:organisation-schema", "technical:structured-data", "technical:schema-complete"), "page-schema": ("citation:schema-fit",), "llms.txt": ("geo:llms-txt",),
    "open-graph": ("technical:open-graph",), "head": ("technical:title", "technical:title-length", "technical:meta-description", "technical:meta-description-length", "technical:viewport"), "headers": ("technical:security-headers", "technical:hsts"),
}


def _lines(rows: Column, f) -> Column:
    return F.array_join(F.transform(rows, f), "\n")


def markdown_text() -> Column:
    """The report of site, overall, grade, m (module, score) and f (place, severity, effort, title)."""
    score = lambda c: F.coalesce(c.cast("string"), F.lit("n/a"))
    head = F.concat(F.lit("# Audit of "), T.escape_markdown(F.col("site").cast("string")), F.lit("\n\nOverall "), score(F.col("overall")), F.lit(", grade "), F.coalesce("grade", F.lit("n/a")))
    table = F.concat(F.lit("\n\n| Module | Score |\n|---|---|\n"), _lines(F.col("m"), lambda x: F.concat(F.lit("| "), T.escape_markdown(x["module"]), F.lit(" | "), score(x["score"]), F.lit(" |"))))
    top = F.when(F.size("f") > 0, _lines(F.col("f"), lambda x: F.concat(x["place"].cast("string"), F.lit(". "), T.escape_markdown(x["title"]), F.lit(" ("), x["severity"], F.lit(", "), x["effort"], F.lit(" effort)")))).otherwise("No issues found.")
    return F.concat(head, F.coalesce(table, F.lit("")), F.lit("\n\n## Top fixes\n\n"), F.coalesce(top, F.lit("No issues found.")))


def markdown(overall: DataFrame, modules: DataFrame, fixes: DataFrame) -> DataFrame:
    """site, report. overall: site, overall, grade; modules: site, module, score; fixes: site, place, id, severity, effort, title."""
    m = modules.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("module", "score"))).alias("m"))
    f = fixes.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "severity", "effort", "title"))).alias("f"))
    return overall.join(m, "site", "left").join(f, "site", "left").select("site", markdown_text().alias("report"))


def fix_prompt(fixes: DataFrame) -> DataFrame:
    """site, prompt: the findings as a numbered request."""
    f = fixes.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "severity", "title"))).alias("f"))
    body = _lines(F.col("f"), lambda x: F.concat(x["place"].cast("string"), F.lit(". ["), F.upper(x["severity"]), F.lit("] "), x["title"]))
    return f.select("site", F.concat(F.lit("An audit found these problems, the worst first. Give the exact change for each.\n\n"), body).alias("prompt"))


def fix_kit(found: DataFrame) -> DataFrame:
    """site, items: which ready-to-paste items the findings (site, id) call for; the scheduled audit always."""
    fired = found.groupBy("site").agg(F.collect_set("id").alias("ids"))
    items = F.array_compact(F.array(*[F.when(F.arrays_overlap("ids", F.array(*map(F.lit, ids))), k) for k, ids in KIT.items()], F.lit("scheduled-audit")))
    return fired.select("site", F.array_join(items, " ").alias("items"))


def lookup(asked: DataFrame, reports: DataFrame, now: Column, most_age_us: int) -> DataFrame:
    """asked (id) with status and the newest report (id, us, report): 404 where there is none, or none young enough."""
    newest = reports.groupBy("id").agg(F.max_by(F.struct("us", "report"), F.struct("us", "report")).alias("r"))
    fresh = F.col("r").isNotNull() & (F.col("r.us") > now - most_age_us)
    return asked.join(newest, "id", "left").select("id", F.when(fresh, 200).otherwise(404).alias("status"), F.when(fresh, F.col("r.report")).alias("report"))


def accuracy(cards: DataFrame) -> DataFrame:
    """site, recall_percent, false_positives, verdict of comparisons (site, n_expected, n_found, n_false)."""
    recall = F.try_divide(F.col("n_found") * 100.0, F.col("n_expected"))
    shown = F.floor(recall * 10 + 0.5) / 10
    verdict = F.when(F.coalesce(recall, F.lit(100.0)) < 95, "below the floor").when(F.col("n_false") > 0, "false alarms").otherwise("sound")
    return cards.select("site", shown.alias("recall_percent"), F.col("n_false").alias("false_positives"), verdict.alias("verdict"))
