"""One vectorised pass from HTML to a struct of page facts; rules read the struct and never parse again."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: A fetch reads so many bytes of a body; longer pages are marked as cut.
MOST_BYTES = 2_000_000

_FACTS = (
    "struct<title:string,title_line:string,lang:string,metas:array<struct<name:string,property:string,itemprop:string,content:string>>,links:array<struct<rel:string,href:string,hreflang:string>>,"
    "headings:array<struct<level:int,text:string,next_tag:string,next_text:string,next_items:int>>,h1:int,h1_text:string,h1_alt:string,paragraphs:array<string>,main_paragraphs:array<string>,prose:string,"
    "anchors:array<struct<href:string,text:string,scheme:string,host:string,path:string,query:string,origin:string,in_nav:boolean>>,buttons:array<string>,images:array<struct<has_alt:boolean,inline:boolean,sized:boolean>>,"
    "forms:array<struct<lead:boolean,message:boolean>>,json_ld:array<struct<index:int,raw:string,error:string>>,schema_types:array<string>,page_types:array<string>,"
    "schema_problems:array<struct<kind:string,type:string,property:string,text:string>>,articles:array<struct<author:boolean,date:boolean>>,has_address:boolean,same_as:array<string>,entity:string,dates:array<string>,"
    "dated:boolean,script_text:string,noscript_text:string,attribute_text:string,article_tags:int,testimonials:int,prices:array<string>,buy_buttons:int,text:string,content_text:string,marketing_text:string,"
    "main_text:string,copy_text:string,error:string>"
)


@functools.cache
def facts_schema() -> T.StructType:
    return T.StructType.fromDDL(f"dom {_FACTS}")["dom"].dataType


def capped(body: Column, most: int = MOST_BYTES) -> Column:
    """A body as a fetch reads it: so many bytes, a character that the end falls into replaced by U+FFFD."""
    first = F.substring(F.encode(body, "UTF-8"), 1, most).cast("string")
    return F.when(F.octet_length(body) > most, F.make_valid_utf8(first)).otherwise(body)


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with ``dom``, read from whole texts; a page that cannot be read has only ``dom.error``. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(pages.sparkSession)
    arrow = to_arrow_type(facts_schema())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .dom import facts_of

        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                out = []
                for u, h in zip(part.column(url).to_pylist(), part.column(html).to_pylist(), strict=True):
                    try:
                        out.append(facts_of(u or "", h or ""))
                    except Exception as e:  # one bad page must not fail the job; the row says what happened
                        out.append({"error": f"{type(e).__name__}: {e}"[:200]})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, arrow)], names=[*part.schema.names, "dom"])

    return pages.mapInArrow(each, T.StructType([*pages.schema.fields, T.StructField("dom", facts_schema())]))
