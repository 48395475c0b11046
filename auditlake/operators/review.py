"""Model replies as data: reading JSON out of text, checking quotes, merging rounds. No model is called here."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import catalogue as C
from ..ship import ship

MOST_CHARS, MOST_RESTARTS, MOST_VALUES = 20_000, 20, 50


def json_values(reply: str | None) -> list[str]:
    """Every top-level JSON value of a reply, in order, as JSON text; fragments that do not parse are passed over."""
    raw = re.sub(r"```(?:json)?", " ", (reply or "")[:MOST_CHARS], flags=re.I)
    decoder, out, at, restarts = json.JSONDecoder(), [], 0, 0
    while len(out) < MOST_VALUES and (m := re.compile(r"[\[{]").search(raw, at)):
        try:
            value, at = decoder.raw_decode(raw, m.start())
            out.append(json.dumps(value))
        except (ValueError, RecursionError):
            restarts += 1
            if restarts > MOST_RESTARTS:
                break
            at = m.start() + 1
    return out


def answers(replies: DataFrame, key: str = "items") -> DataFrame:
    """replies: site, round, reply. One row for each item of the lists under a key: site, round, pos, id, passed, quote, severity."""
    ship(replies.sparkSession)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(json_values)

    values = F.pandas_udf(each, "array<string>")
    item = "array<struct<id:string,passed:boolean,quote:string,severity:string>>"
    found = replies.select("site", "round", F.posexplode(values("reply")).alias("v", "json")).select("site", "round", "v", F.from_json("json", f"struct<{key}:{item}>")[key].alias("items"))
    return found.select("site", "round", "v", F.posexplode("items").alias("i", "item")).select("site", "round", (F.col("v") * 1000 + F.col("i")).alias("pos"), "item.*").where("id is not null and passed is not null")


def reviewed(found: DataFrame, rubric: DataFrame, pages: DataFrame, module: str, weight: int) -> DataFrame:
    """Outcomes of a rubric (id, title, fix): the first answer counts, a later round only fills gaps, and an answer
    counts only if its quote stands in one of the page's fields (pages: site, url, title, description, h1, body)."""
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("site", "id").orderBy("round", "pos"))).where("n = 1")
    asked = rubric.select("id", F.col("title").alias("problem"), "fix")
    j = pages.crossJoin(F.broadcast(asked)).join(first.drop("n", "round", "pos"), ["site", "id"], "left")
    fields = [T.normal_quote(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "description", "h1", "body")]
    ok = F.coalesce(T.verified(T.normal_quote(F.col("quote")), *fields), F.lit(False))
    severity = F.when(F.col("severity") == "low", "low").otherwise("medium")
    evidence = F.array(F.struct(F.col("url"), T.clip(F.col("quote"), 200).alias("quote")))
    finding = F.struct(F.concat(F.lit(f"{module}:"), "id").alias("id"), F.lit(module).alias("module"), severity.alias("severity"), F.lit("medium").alias("effort"), F.col("problem").alias("title"), "fix", evidence.alias("evidence"))
    why = F.when(F.col("passed").isNull(), "not answered").when(~ok, "no quote from the page")
    return j.select("site", "id", F.lit(weight).alias("weight"), why.alias("unchecked"), F.when(why.isNull(), F.col("passed")).alias("passed"), F.when(why.isNull() & ~F.col("passed"), finding).alias("finding"))


def outcomes(found: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, unchecked) of all questions of the rubric, outcomes with the columns of the engine's: they union with the rules'.

    found: answers (see ``answers``); pages: site, url, title, description, h1, body. A question without a usable answer is no
    outcome; it is in unchecked (site, what, why).
    """
    spark, at = pages.sparkSession, len(C.rules())
    rows = None
    for module, questions in C.AI_RUBRIC.items():
        asked = spark.createDataFrame(list(questions), "id string, title string, fix string")
        own = reviewed(found, asked, pages, module, C.AI_WEIGHT).withColumn("module", F.lit(module))
        rows = own if rows is None else rows.unionByName(own)
    order = F.create_map(*[x for k, (m, i) in enumerate((m, q[0]) for m, qs in C.AI_RUBRIC.items() for q in qs) for x in (F.lit(f"{m}:{i}"), F.lit(at + k))])
    place = F.create_map(*[x for i, m in enumerate(C.MODULES) for x in (F.lit(m), F.lit(i))])
    out = rows.where("passed is not null").select("site", "module", F.element_at(place, F.col("module")).alias("module_ord"), F.element_at(order, F.concat_ws(":", "module", "id")).alias("check_ord"), "id", "weight", "passed", F.lit(None).cast("double").alias("credit"), "finding")
    return out, rows.where("passed is null").select("site", F.concat_ws(":", "module", "id").alias("what"), F.col("unchecked").alias("why"))
