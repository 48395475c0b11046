"""Where the library's queries and their SQL register."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sql: str, sf_dir: str | None = None) -> DataFrame:
    """Rows that SQL makes alike in both engines; with sf_dir they may come from the tables pages and events."""
    if sf_dir is not None:
        for t in ("pages", "events"):
            if f"FROM {t}" in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(f"auditlake_{t}")
                sql = sql.replace(f"FROM {t}", f"FROM auditlake_{t}")
    return spark.sql(sql)


def per_page(values: str, columns: str, **woven: tuple[str, str]) -> str:
    """A relation over all pages: each page takes one of the listed kinds in turn, and its number for the kind's.

    values: a VALUES relation whose first column numbers the kinds from 1 (several rows of a kind stay together); woven:
    column -> (text, the same with {n} where the page's number goes).
    """
    names = [c.strip() for c in columns.split(",")]
    kinds = max(int(x) for x in re.findall(r"(?:VALUES |, ?\n?\s*)\((\d+),", values))
    text = ", ".join(f"replace(w.{c}, '{woven[c][0]}', replace('{woven[c][1]}', '{{n}}', CAST(p.page_id AS {{text}}))) AS {c}" if c in woven else f"w.{c}" for c in names[1:])
    cast = text.replace("{text}", "VARCHAR(20)")
    return f"(SELECT p.page_id AS {names[0]}, {cast} FROM {values} AS w({columns}) JOIN (SELECT page_id FROM pages) p ON p.page_id % {kinds} + 1 = w.{names[0]})"
