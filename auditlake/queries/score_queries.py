"""Scores, rankings and comparisons over outcomes that both engines derive from lineitem in the same way: a site an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rivals as R
from ..operators import scoring as S
from ..plans import catalogue as C
from .registry import per_page, query, rows, table

_MEMBERS = [k for _, ms in S.READINESS.values() for k in ms]
_ALL = [f"{m}:{r}" for m, rs in {"technical": ["title", "https", "hsts"], "geo": ["x-one"], "content": ["cta", "nav"], "marketing": ["offer", "proof"], "social": ["links"], "performance": ["lcp", "cls"]}.items() for r in rs]
_IDS = _MEMBERS + _ALL
_CASE = lambda x, names: "CASE " + x + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"

#: Outcomes as SQL that both engines read alike: site, key, weight, passed, credit, severity, effort.
OUTCOMES_SQL = f"""
SELECT site, {_CASE('k', [k.split(':')[0] for k in _IDS])} AS module, {_CASE('k', [str(C.MODULES.index(k.split(':')[0])) for k in _IDS])} AS module_text, k AS check_ord, {_CASE('k', [k.split(':')[1] for k in _IDS])} AS id,
  1 + a % 20 AS weight, b % 3 <> 0 AS passed, CASE WHEN b % 3 = 0 AND a % 4 = 0 THEN (a % 13) / 10.0 - 0.1 END AS credit, b % 3 = 0 AND a % 4 <> 0 AS found,
  {_CASE('a % 4', C.SEVERITIES)} AS severity, {_CASE('b % 5 % 3', C.EFFORTS)} AS effort
FROM (SELECT l_orderkey AS site, (l_partkey + 11 * j) % {len(_IDS)} AS k, max(l_partkey + j) AS a, max(l_suppkey + l_linenumber + j) AS b FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) v(j) GROUP BY l_orderkey, (l_partkey + 11 * j) % {len(_IDS)}) g"""


def by_site(df: DataFrame, site: str = "site") -> DataFrame:
    """df spread by site, in a number of parts that stays: groups, windows and joins of a site need no other shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), site)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow lines are shuffled, once; what they are unfolded into stays where it is."""
    lines = by_site(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_orderkey")
    o = spark.sql(OUTCOMES_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    finding = F.struct(F.concat_ws(":", "module", "id").alias("id"), "module", "severity", "effort", F.concat(F.lit("Problem with "), "id").alias("title"))
    return o.select("site", "module", F.col("module_text").cast("int").alias("module_ord"), "check_ord", "id", "weight", "passed", F.col("credit").cast("double").alias("credit"), F.when(F.col("found"), finding).alias("finding"))


_O = f"o AS ({OUTCOMES_SQL})"
_M = f"""{_O}, m AS (SELECT site, module, CAST(floor(round(100 * sum(weight * CASE WHEN passed THEN 1.0 ELSE least(1.0, greatest(0.0, coalesce(CAST(credit AS DOUBLE), 0.0))) END) / CAST(sum(weight) AS DOUBLE), 9) + 0.5) AS BIGINT) AS score,
  count(*) FILTER (passed) AS n_passed, count(*) FILTER (found) AS n_findings FROM o GROUP BY site, module)"""
_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_EFF = "CASE effort WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_F = f"{_O}, f AS (SELECT site, CAST(module_text AS INT) AS module_ord, check_ord, module || ':' || id AS id, severity, effort, {_SEV} AS sev, {_EFF} AS eff FROM o WHERE found)"
_W = "CASE module " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in C.MODULE_WEIGHTS.items()) + " END"
_ORD = "CASE module " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(C.MODULES)) + " END"
_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query(f"WITH {_M} SELECT site, module, score, n_passed, n_findings, 'ok' AS status FROM m")
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.module_scores(outcomes(spark, sf_dir))


@query(f"""WITH {_M}, u AS (SELECT DISTINCT site, 'geo' AS module FROM o WHERE site % 3 = 0 UNION ALL SELECT DISTINCT site, 'competitors' FROM o WHERE site % 5 = 0)
SELECT site, module, m.score, CASE WHEN m.score IS NULL THEN 'failed' WHEN u.site IS NOT NULL THEN 'partial' ELSE 'ok' END AS status FROM m FULL JOIN u USING (site, module)""")
def module_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    s = o.select("site").distinct()
    gaps = s.where("site % 3 = 0").select("site", F.lit("geo").alias("module")).unionByName(s.where("site % 5 = 0").select("site", F.lit("competitors").alias("module")))
    return S.module_scores(o, gaps).select("site", "module", "score", "status")


_OV = f"""{_M}, t AS (SELECT site, CAST(floor(CAST(sum(score * {_W}) AS DOUBLE) / sum({_W}) + 0.5) AS BIGINT) AS overall FROM m GROUP BY site)"""


@query(f"WITH {_OV} SELECT site, overall, {_GRADE.format('overall')} AS grade FROM t")
def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overall_scores(S.module_scores(outcomes(spark, sf_dir)))


@query(f"WITH {_OV} SELECT grade, count(*) AS sites, CAST(min(overall) AS BIGINT) AS lowest FROM (SELECT overall, {_GRADE.format('overall')} AS grade FROM t) GROUP BY grade")
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overall_scores(S.module_scores(outcomes(spark, sf_dir))).groupBy("grade").agg(F.count("*").alias("sites"), F.min("overall").alias("lowest"))


_ENDS = f"""e AS (SELECT site, arg_min(module, -score * 100 + {_ORD}) AS strongest, max(score) AS best, arg_min(module, score * 100 + {_ORD}) AS weakest, min(score) AS worst FROM m GROUP BY site)"""


@query(f"WITH {_M}, {_ENDS} SELECT * FROM e")
def strongest_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strongest_weakest(S.module_scores(outcomes(spark, sf_dir)))


_COUNTS = "c AS (SELECT site, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in C.SEVERITIES) + " FROM f GROUP BY site)"


@query(f"WITH {_F}, {_COUNTS} SELECT * FROM c")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.severity_counts(S.findings(outcomes(spark, sf_dir)))


@query(f"WITH {_F} SELECT site, id, severity, effort, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sev, eff, module_ord, check_ord) AS place FROM f) WHERE place <= 10")
def top_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_fixes(S.findings(outcomes(spark, sf_dir))).select("site", "id", "severity", "effort", "place")


_QUICK = "q AS (SELECT site, id, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY sev, module_ord, check_ord) AS place FROM f WHERE effort = 'low' AND sev <= 2) WHERE place <= 5)"


@query(f"WITH {_F}, {_QUICK} SELECT * FROM q")
def quick_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quick_wins(S.findings(outcomes(spark, sf_dir))).select("site", "id", "place")


@query(f"WITH {_F} SELECT site, effort, string_agg(id, ' ' ORDER BY sev, module_ord, check_ord) AS ids FROM f GROUP BY site, effort")
def roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.roadmap(S.findings(outcomes(spark, sf_dir)))


_QUAD = "CASE WHEN sev <= 1 AND effort <> 'high' THEN 'quick wins' WHEN sev <= 1 THEN 'big bets' WHEN effort <> 'high' THEN 'fill-ins' ELSE 'deprioritise' END"
_MATRIX = f"{_F}, x AS (SELECT site, id, {_QUAD} AS quadrant, row_number() OVER (PARTITION BY site, {_QUAD} ORDER BY sev, eff, module_ord, check_ord) AS place FROM f)"


@query(f"WITH {_MATRIX} SELECT * FROM x")
def impact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.impact_matrix(S.findings(outcomes(spark, sf_dir))).select("site", "id", "quadrant", "place")


@query(f"""WITH {_MATRIX}, n AS (SELECT site, max(n) AS fullest FROM (SELECT site, quadrant, count(*) AS n FROM x GROUP BY ALL) GROUP BY site),
r AS (SELECT unnest(generate_series(4, 28)) / 2.0 AS r), g AS (SELECT CAST(r AS DOUBLE) AS r, greatest(1, floor((160 - r) / (r * 2.4))) * greatest(1, floor((120 - r) / (r * 2.4))) AS cells FROM r),
s AS (SELECT site, coalesce(max(r) FILTER (cells >= fullest), 2.0) AS radius FROM n CROSS JOIN g GROUP BY site),
p AS (SELECT x.*, radius, greatest(1, floor((160 - radius) / (radius * 2.4))) AS cols, CASE quadrant WHEN 'quick wins' THEN 0 WHEN 'big bets' THEN 1 WHEN 'fill-ins' THEN 2 ELSE 3 END AS q FROM x JOIN s USING (site))
SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY q, place) AS n, radius, round(q % 2 * 160 + radius + 4 + ((place - 1) % cols) * radius * 2.4, 6) AS x, round(floor(q / 2) * 120 + radius + 4 + floor((place - 1) / cols) * radius * 2.4, 6) AS y FROM p""")
def chart_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chart_layout(S.impact_matrix(S.findings(outcomes(spark, sf_dir))), 320.0, 240.0)


_B = "b AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {w}, '{k.split(':')[0]}', '{k.split(':')[1]}', {m})" for c, (w, ms) in S.READINESS.items() for k, m in ms.items()) + ") v(component, cw, module, id, mw))"
_READY = f"""{_O}, {_B}, y AS (SELECT site, component, cw AS component_weight, CAST(floor(100.0 * sum(CASE WHEN passed THEN mw ELSE 0 END) / sum(mw) + 0.5) AS BIGINT) AS score, count(*) FILTER (NOT passed) AS n_failed FROM o JOIN b USING (module, id) WHERE passed OR found GROUP BY site, component, cw)"""


@query(f"WITH {_READY} SELECT * FROM y")
def readiness_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.readiness(outcomes(spark, sf_dir))


@query(f"""WITH {_READY}, t AS (SELECT site, CAST(floor(CAST(sum(score * component_weight) AS DOUBLE) / sum(component_weight) + 0.5) AS BIGINT) AS score FROM y GROUP BY site),
l AS (SELECT site, module || ':' || id AS gap, CAST(mw * cw AS BIGINT) AS lost FROM o JOIN b USING (module, id) WHERE NOT passed AND found),
g AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lost DESC, gap) AS place FROM l)
SELECT site, score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Moderate' WHEN score >= 40 THEN 'Weak' ELSE 'Very weak' END AS band, string_agg(gap, '; ' ORDER BY place) AS gaps FROM t LEFT JOIN (SELECT * FROM g WHERE place <= 3) g USING (site) GROUP BY site, score""")
def readiness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    return readiness_verdict_of(o, S.readiness(o))


def readiness_verdict_of(o: DataFrame, ready: DataFrame) -> DataFrame:
    gaps = S.readiness_gaps(o).groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "gap"))), lambda x: x["gap"]), "; ").alias("gaps"))
    return S.readiness_total(ready).join(gaps, "site", "left")


@query(f"WITH {_F}, k AS (SELECT *, row_number() OVER (PARTITION BY site, module_ord ORDER BY sev, check_ord) AS k FROM f) SELECT site, id, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY module_ord, k) AS place FROM k WHERE k <= 5) WHERE place <= 12")
def idea_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.idea_findings(S.findings(outcomes(spark, sf_dir))).select("site", "id", "place")


@query(f"""WITH {_F}, i AS (SELECT DISTINCT site, id AS cites FROM f WHERE check_ord % 2 = 0 UNION ALL SELECT DISTINCT site, 'made:up' FROM f) SELECT site, count(*) AS ideas FROM i WHERE EXISTS (SELECT 1 FROM f WHERE f.site = i.site AND f.id = i.cites) GROUP BY site""")
def ideas_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideas count only if they cite a finding of their site."""
    f = S.findings(outcomes(spark, sf_dir))
    ideas = f.where("check_ord % 2 = 0").select("site", F.col("id").alias("cites")).distinct().unionByName(f.select("site", F.lit("made:up").alias("cites")).distinct())
    return ideas.join(f.select("site", F.col("id").alias("cites")), ["site", "cites"], "left_semi").groupBy("site").agg(F.count("*").alias("ideas"))


_V = f"""{_OV}, f AS (SELECT site, CAST(module_text AS INT) AS module_ord, check_ord, module || ':' || id AS id, severity, effort, {_SEV} AS sev, {_EFF} AS eff FROM o WHERE found), {_ENDS}, {_COUNTS}, {_QUICK}, w AS (SELECT site, count(*) AS n_quick FROM q GROUP BY site)"""


@query(f"""WITH {_V}, z AS (SELECT t.*, e.strongest, e.best, e.weakest, e.worst, coalesce(critical + high + medium + low, 0) AS n, coalesce(n_quick, 0) AS k FROM t LEFT JOIN e USING (site) LEFT JOIN c USING (site) LEFT JOIN w USING (site))
SELECT site, concat_ws(' ', printf('Grade %s (%d/100).', {_GRADE.format('overall')}, overall), CASE WHEN best <> worst THEN printf('Strongest: %s (%d), weakest: %s (%d).', strongest, best, weakest, worst) END,
  CASE WHEN n = 0 THEN 'No issues found.' ELSE n || CASE WHEN n = 1 THEN ' issue' ELSE ' issues' END || CASE WHEN k = 0 THEN '' WHEN k = 1 THEN ', 1 quick win' ELSE ', ' || k || ' quick wins' END || '.' END) AS verdict FROM z""")
def site_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    m, f = S.module_scores(o), S.findings(o)
    return S.verdicts(S.overall_scores(m), S.strongest_weakest(m), S.severity_counts(f), S.quick_wins(f))


# A site's rivals are the three after it.
_RIVAL = "v AS (SELECT m.site - d.d AS site, m.site AS rival, m.module, m.score FROM m CROSS JOIN (VALUES (1), (2), (3)) d(d))"


def _of_rivals(df: DataFrame) -> DataFrame:
    """A site's rows as a rival's of the three sites before it. They move as one row."""
    own = [c for c in df.columns if c != "site"]
    packed = df.groupBy("site").agg(F.collect_list(F.struct(*own)).alias("rows")) if own else df
    moved = packed.select(F.col("site").alias("rival"), *(["rows"] if own else []), F.explode(F.array(*[F.col("site") - d for d in (1, 2, 3)])).alias("site"))
    return by_site(moved).select("site", "rival", *([F.inline("rows")] if own else []))


@query(f"""WITH {_M}, {_RIVAL}, j AS (SELECT v.*, m.score AS mine FROM v JOIN m ON m.site = v.site AND m.module = v.module)
SELECT site, module, mine, count(*) FILTER (score - mine >= 10) AS n_ahead, arg_max(rival, score * 1000 + rival) AS leader, max(score) AS best FROM j GROUP BY site, module, mine HAVING count(*) FILTER (score - mine >= 10) > 0""")
def competitor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.module_scores(outcomes(spark, sf_dir)).select("site", "module", "score")
    return R.score_gaps(m, _of_rivals(m))


@query(f"""WITH {_O}, x AS (SELECT site, module || ':' || id AS id FROM o WHERE found), p AS (SELECT site - d.d AS site, site AS rival, module || ':' || id AS id FROM o CROSS JOIN (VALUES (1), (2), (3)) d(d) WHERE passed),
n AS (SELECT site, count(DISTINCT rival) AS n FROM p GROUP BY site), c AS (SELECT x.site, x.id, count(*) AS n_pass FROM x JOIN p ON p.site = x.site AND p.id = x.id GROUP BY ALL)
SELECT site, id, n_pass, place FROM (SELECT c.*, row_number() OVER (PARTITION BY c.site ORDER BY n_pass DESC, id) AS place FROM c JOIN n ON n.site = c.site WHERE n_pass >= ceil(n / 2.0)) WHERE place <= 4""")
def competitor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    failed = S.findings(o).select("site", "id")
    passed = _of_rivals(o.where("passed").select("site", F.concat_ws(":", "module", "id").alias("id")))
    return R.common_checks(failed, passed).select("site", "id", "n_pass", "place")


@query(f"""WITH {_O}, a AS (SELECT DISTINCT site, effort || severity AS value FROM o WHERE found AND check_ord % 3 = 0), t AS (SELECT DISTINCT site - d.d AS site, site AS rival, value FROM a CROSS JOIN (VALUES (1), (2), (3)) d(d)),
c AS (SELECT site, value, count(*) AS n FROM t GROUP BY ALL) SELECT site, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, value) AS place FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.site = c.site AND a.value = c.value)) WHERE place <= 5""")
def competitor_only_theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = outcomes(spark, sf_dir).where("finding is not null and check_ord % 3 = 0").select("site", F.concat("finding.effort", "finding.severity").alias("value")).distinct()
    return R.only_theirs(a, _of_rivals(a)).select("site", "value", "n", "place")


@query(f"""WITH {_O}, w AS (SELECT site, sum(weight) AS value FROM o GROUP BY site), t AS (SELECT site - d.d AS site, value FROM w CROSS JOIN (VALUES (1), (2), (3)) d(d)),
m AS (SELECT site, CAST(floor(median(value) + 0.5) AS BIGINT) AS median FROM t GROUP BY site) SELECT m.site, m.median, CAST(w.value AS BIGINT) AS value FROM m JOIN w USING (site) WHERE m.median >= w.value * 1.05""")
def competitor_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = outcomes(spark, sf_dir).groupBy("site").agg(F.sum("weight").alias("value"))
    return R.medians(w, _of_rivals(w), 1.05).select("site", "median", "value")


@query(f"""WITH {_F}, p AS (SELECT site, id, check_ord % 4 AS page FROM f UNION ALL SELECT site, id, check_ord % 3 FROM f) SELECT site, CAST(page AS BIGINT) AS page, count(DISTINCT id) AS issues FROM p GROUP BY site, page""")
def issues_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct findings per page of the evidence."""
    f = S.findings(outcomes(spark, sf_dir))
    e = f.select("site", "id", F.explode(F.array(F.col("check_ord") % 4, F.col("check_ord") % 3)).alias("page"))
    return e.groupBy("site", F.col("page").cast("long").alias("page")).agg(F.countDistinct("id").alias("issues"))


_PSI = per_page("(VALUES (1, 0.95, 2100.0, 0.05, 150.0, 1500.0), (2, 0.45, 3900.0, 0.2, 650.0, 2000.0), (3, 0.7, 4100.0, 0.3, 200.0, 3100.0))", "id, score, lcp, cls, tbt, fcp")


@query(f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN lcp <= 2500 THEN 1.0 WHEN lcp <= 4000 THEN 0.5 ELSE 0.0 END::DOUBLE AS lcp, CASE WHEN cls <= 0.1 THEN 1.0 WHEN cls <= 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS cls,
  CASE WHEN tbt <= 200 THEN 1.0 WHEN tbt <= 600 THEN 0.5 ELSE 0.0 END::DOUBLE AS tbt, CASE WHEN fcp <= 1800 THEN 1.0 WHEN fcp <= 3000 THEN 0.5 ELSE 0.0 END::DOUBLE AS fcp FROM {_PSI} v(id, score, lcp, cls, tbt, fcp)""")
def perf_credit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as T

    t = rows(spark, f"SELECT CAST(id AS BIGINT) AS id, lcp, cls, tbt, fcp FROM {_PSI} AS v(id, score, lcp, cls, tbt, fcp)", sf_dir)
    return t.select("id", *[T.speed_credit(F.col(c).cast("double"), a, b).alias(c) for c, a, b in (("lcp", 2500, 4000), ("cls", 0.1, 0.25), ("tbt", 200, 600), ("fcp", 1800, 3000))])
