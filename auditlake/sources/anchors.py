"""Anchors of pages in document order, by a tag scan that builds no tree."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..ship import ship


class _Anchors(HTMLParser):
    """Addresses of anchors; what stands in comments, scripts and styles is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href is not None:
                self.found.append(href)


def hrefs(html: str) -> list[str]:
    p = _Anchors()
    p.feed(html)
    p.close()
    return p.found


def with_hrefs(pages: DataFrame, html: str = "html", out: str = "hrefs") -> DataFrame:
    """pages, html replaced by the array of its anchors' addresses as they are written; a null page has none. No shuffle."""
    ship(pages.sparkSession)
    fields = [f for f in pages.schema.fields if f.name != html]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hrefs(h) if h else [] for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(found, pa.list_(pa.string()))], names=[*[f.name for f in fields], out])

    return pages.mapInArrow(each, T.StructType([*fields, T.StructField(out, T.ArrayType(T.StringType()))]))
