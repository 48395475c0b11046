"""A site's whole report out of its outcomes, gathered once: one short list a site, from which all sections are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalogue import EFFORTS, MODULE_WEIGHTS, MODULES, SEVERITIES
from . import scoring as S
from . import sinks

QUADRANTS = ("big bets", "deprioritise", "fill-ins", "quick wins")


def _at(values: list, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


def _sum(rows: Column, f: Callable[[Column], Column], start: Column | None = None) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long") if start is None else start, lambda a, x: a + f(x))


def _lines(lines: list[Column]) -> Column:
    """Those that are not null."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _module(rows: Column, name: str) -> Column:
    """struct<module, score, ord, w>; null where the site has no outcome of the module."""
    score = lambda own: T.js_round(F.round(F.try_divide(_sum(own, lambda x: x["earned"], F.lit(0.0)) * 100, F.nullif(_sum(own, lambda x: x["weight"]).cast("double"), F.lit(0.0))), 9))
    made = lambda own: F.when(F.size(own) > 0, F.struct(F.lit(name).alias("module"), score(own).alias("score"), F.lit(MODULES.index(name)).alias("ord"), F.lit(MODULE_WEIGHTS.get(name, 0)).alias("w")))
    return T.once(F.filter(rows, lambda x: x["module_ord"] == MODULES.index(name)), made)


def _component(ran: Column, name: str, keys: list[str]) -> Column:
    """struct<component, component_weight, score, n_failed> of the members that ran; null where none did."""
    weight, members = S.READINESS[name]
    of = lambda x: _at([members.get(k, 0) for k in keys], x["check"])
    good = lambda own: _sum(own, lambda x: F.when(x["passed"], of(x)).otherwise(0))
    made = lambda own: F.when(
        F.size(own) > 0,
        F.struct(F.lit(name).alias("component"), F.lit(weight).alias("component_weight"), T.js_round(good(own) * 100.0 / _sum(own, of)).alias("score"), F.size(F.filter(own, lambda x: ~x["passed"])).alias("n_failed")),
    )
    return T.once(F.filter(ran, lambda x: of(x) > 0), made)


def whole(outcomes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """site, report in ten sections. outcomes: site, check_ord, weight, passed, credit, finding; rules: module, id and title by check_ord.

    What is gathered of an outcome are numbers; its texts are looked up in ``rules`` afterwards. Where outcomes lie by
    site, nothing is shuffled.
    """
    keys, s = [f"{m}:{i}" for m, i, _ in rules], lambda c: F.col(c).cast("string")
    costs = {k: w * own for w, ms in S.READINESS.values() for k, own in ms.items()}
    found = F.col("finding").isNotNull()
    one = F.struct(
        F.when(found, S.rank_of(F.col("finding.severity"), SEVERITIES)).alias("sev"), F.when(found, S.rank_of(F.col("finding.effort"), EFFORTS)).alias("eff"), F.col("check_ord").cast("int").alias("check"),
        F.col("weight").cast("int").alias("weight"), "passed", S.earned().alias("earned"),
    )
    # Only scored sites have a report. Weights are not negative; asked here, no filter is worked out over the lists.
    got = outcomes.select("site", "weight", one.alias("one")).groupBy("site").agg(F.collect_list("one").alias("x"), F.max("weight").alias("most")).where("most > 0")
    ordered = lambda x: F.struct(x["sev"], x["eff"], _at([MODULES.index(m) for m, *_ in rules], x["check"]).alias("module_ord"), x["check"], x["weight"], x["passed"], x["earned"])
    rows = got.select("site", F.array_sort(F.transform("x", ordered)).alias("x"))
    ran = F.filter("x", lambda x: x["passed"] | x["sev"].isNotNull())
    parts = rows.select("site", F.filter("x", lambda x: x["sev"].isNotNull()).alias("found"), F.array_compact(F.array(*[_module(F.col("x"), m) for m in sorted(MODULES)])).alias("m"), ran.alias("ran"))
    gaps = lambda r: F.array_sort(F.transform(F.filter(r, lambda x: ~x["passed"] & x["sev"].isNotNull() & (_at([costs.get(k, 0) for k in keys], x["check"]) > 0)), lambda x: F.struct((-_at([costs.get(k, 0) for k in keys], x["check"])).alias("lost"), _at(keys, x["check"]).alias("gap"))))
    parts = parts.select("site", "found", "m", F.filter("m", lambda x: x["score"].isNotNull()).alias("scored"), F.array_compact(F.array(*[_component(F.col("ran"), c, keys) for c in sorted(S.READINESS)])).alias("ready"), F.slice(gaps(F.col("ran")), 1, 3)["gap"].alias("gaps"))

    ranked = F.filter("scored", lambda x: x["module"] != "competitors")
    best = F.array_max(F.transform("ranked", lambda x: F.struct(x["score"], -x["ord"], x["module"])))
    worst = F.array_min(F.transform("ranked", lambda x: F.struct(x["score"], x["ord"], x["module"])))
    fix = lambda x, i: F.struct((i + 1).alias("place"), _at(list(SEVERITIES), x["sev"]).alias("severity"), _at(list(EFFORTS), x["eff"]).alias("effort"), _at([t for *_, t in rules], x["check"]).alias("title"))
    # Within one effort and within one quadrant the order of all findings is that by severity, module and rule.
    low = F.slice(F.filter("found", lambda x: (x["eff"] == EFFORTS.index("low")) & (x["sev"] <= 2)), 1, 5)
    overall = T.js_round(F.try_divide(_sum(F.col("scored"), lambda x: x["score"] * x["w"]).cast("double"), F.nullif(_sum(F.col("scored"), lambda x: x["w"]), F.lit(0))))
    total = T.js_round(F.try_divide(_sum(F.col("ready"), lambda x: x["score"] * x["component_weight"]).cast("double"), _sum(F.col("ready"), lambda x: x["component_weight"])))
    counts = [F.size(F.filter("found", lambda x: x["sev"] == i)).cast("long").alias(name) for i, name in enumerate(SEVERITIES)]
    wide = parts.select("*", ranked.alias("ranked"), overall.alias("overall"), F.transform(F.slice("found", 1, 10), fix).alias("f"), low.alias("easy"), total.alias("total"), *counts)
    wide = wide.select("*", T.grade(F.col("overall")).alias("grade"), best.alias("b"), worst.alias("c"), F.size("easy").cast("long").alias("n_quick"))
    wide = wide.select("*", F.col("b.module").alias("strongest"), F.col("b.score").alias("best"), F.col("c.module").alias("weakest"), F.col("c.score").alias("worst"))

    t = F.lit
    texts = [
        ("Summary", S.verdict_sentence(), "No summary."),
        ("Findings by severity", F.when(F.size("found") > 0, F.concat(t("| Critical | High | Medium | Low |\n|---|---|---|---|\n| "), s("critical"), t(" | "), s("high"), t(" | "), s("medium"), t(" | "), s("low"), t(" |"))), "None."),
        ("Strongest and weakest", F.concat(t("Strongest: "), "strongest", t(" ("), s("best"), t("). Weakest: "), "weakest", t(" ("), s("worst"), t(").")), "Not scored."),
        ("Quick wins", F.when(F.size("easy") > 0, F.array_join(F.transform("easy", lambda x, i: F.concat((i + 1).cast("string"), t(". `"), _at(keys, x["check"]), t("`"))), "\n")), "None."),
        ("Roadmap", F.when(F.size("found") > 0, _lines([_listed(F.filter("found", lambda x: x["eff"] == e), f"- {name} effort: ", lambda x: _at(keys, x["check"]), " ") for e, name in enumerate(EFFORTS)])), "Nothing to do."),
        ("Impact and effort", F.when(F.size("found") > 0, _lines([_listed(F.filter("found", lambda x: S.quadrant(x["sev"], x["eff"] == EFFORTS.index("high")) == q), f"- {q}: ", lambda x: F.concat(t("`"), _at(keys, x["check"]), t("`")), ", ") for q in QUADRANTS])), "Nothing to place."),
        ("AI readiness", F.concat(t("Score "), s("total"), t(", "), F.coalesce(T.readiness_band(F.col("total")), t("")), t("."), F.when(F.size("gaps") > 0, F.concat(t(" Main gaps: "), F.array_join("gaps", "; "), t("."))).otherwise("")), "Not measured."),
        ("Readiness by component", F.when(F.size("ready") > 0, F.array_join(F.transform("ready", lambda x: F.concat(t("- "), x["component"], t(": "), x["score"].cast("string"), t(" (weight "), x["component_weight"].cast("string"), t(", failed "), x["n_failed"].cast("string"), t(")"))), "\n")), "Not measured."),
    ]
    more = [x for heading, text, otherwise in texts for x in (t(f"\n\n## {heading}\n\n"), F.coalesce(text, t(otherwise)))]
    return wide.select("site", F.concat(sinks.markdown_text(), *more).alias("report"))


def _listed(rows: Column, head: str, name: Callable[[Column], Column], between: str) -> Column:
    return T.once(rows, lambda r: F.when(F.size(r) > 0, F.concat(F.lit(head), F.array_join(F.transform(r, name), between))))
