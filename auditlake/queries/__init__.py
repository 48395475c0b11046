"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import crawl_queries, intake_queries, kit_queries, page_rule_queries, rule_fixtures, rule_queries, score_queries, source_queries, state_queries, text_queries, url_queries  # noqa: F401
from . import more_queries, report_queries  # noqa: F401, E402, I001  they reuse SQL registered above
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
