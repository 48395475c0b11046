"""Ranked lexical search over a tiered index: high-impact postings first, exact results by residual bounds.

The index is cut by documents. A block holds the postings of a few megabytes of text; every posting carries its
impact, what one occurrence of the term in a query adds but for the term's weight. Within a block the postings of a
term lie in tiers, highest impacts first, and each tier knows the residual bound of each term: the largest impact in
the tiers below. So a tier read so far gives every document a lower bound (what was added) and an upper one (plus the
residuals of terms not met in it), and documents never met are bounded by the sum of residuals.

1. One pass counts documents and terms, one more builds the blocks: no shuffle, each text is held by one task.
2. ``search`` takes the items in batches of bounded size. The first tier of all blocks gives each item's most
   promising documents; only the blocks of these are read whole, and the tenth best exact score is the item's bar.
3. An item is proven in a block whose upper bounds stay under its bar. Where that proof is lacking it falls through
   to the next tier, at last to all postings, where bounds are exact. Only documents at or above the bar come back.

Nothing is approximate: a block is left out for an item only on proof. Ranks are settled by score, then id.

Defined results: null, empty and termless texts hold no term and are not counted; a document row without an id counts
in the statistics and is not ranked; repeated document rows are ranked row by row; items without an id or term have no
result, equal item rows count once and different texts of one item are ranked apart; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import Stash, in_arrow, slices
from .ngrams import split_words

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII: bytes as they count, all others blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 1 << 16
#: A row of the index is a block of some megabytes, and Parquet holds a row group in memory when it writes and when it
#: reads; left alone it looks at the size only after a hundred rows.
ROW_GROUPS = {"parquet.block.size": "8388608", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Per tier but the last: the share of a term's postings in a block down to its end, and how many at least.
TIERS = ((1 / 16, 16), (1 / 4, 64))
#: A batch of items that goes to every task: distinct terms with their item, and items.
BATCH_TERMS, BATCH_ITEMS = 100_000, 1_000
#: Blocks named to the last pass at most; beyond it that pass reads all blocks and finds the proven ones itself.
MOST_NAMED = 1 << 20


def folded(texts: pa.Array) -> pa.Array:
    """Texts with only A-Z lower-cased and every separator a blank; a null text is empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return texts
    texts = pa.concat_arrays([texts])  # a slice without the rows around it
    _, offsets, data = texts.buffers()
    body = data.to_pybytes().translate(_FOLD) if data is not None else b""
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(body)], offset=texts.offset)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with terms, occurrences of terms) of each slice, by the bytes where a term begins."""
    import numpy as np

    for batch in batches:
        for part in slices(batch, "text"):
            texts = folded(part.column("text"))
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
            inside = np.frombuffer(data, np.uint8) != 32 if data is not None else np.empty(0, bool)
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            cuts = ends[(ends > 0) & (ends < len(inside))]
            begins[cuts] = inside[cuts]
            n = np.diff(np.concatenate([[0], np.cumsum(begins)])[ends])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])


@dataclass
class Statistics:
    documents: int  # with a term or more
    terms: int  # occurrences in all of them

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def lengths(self, n):
        """The length part of the formula, by number of terms of a document."""
        import numpy as np

        if self.documents * 75 * int(n.max(initial=0)) < 1 << 63:
            return 25 + 75 * n * self.documents // max(1, self.terms)
        return np.array([25 + 75 * int(x) * self.documents // self.terms for x in n], np.int64)


@dataclass
class Index:
    blocks: DataFrame
    statistics: Statistics
    tiers: int


def _schema(id_type, tiers: int) -> StructType:
    per_tier = [StructField(f"{name}{k}", BinaryType()) for k in range(tiers) for name in ("ends", "docs", "impacts", "rest")]
    return StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), StructField("terms", ArrayType(StringType())), StructField("df", ArrayType(IntegerType())), *per_tier])


def _block(ids: pa.Array, texts: pa.Array, stats: Statistics, tiers: tuple) -> list | None:
    """The columns after ``block`` of the index row of some documents, None without terms."""
    import numpy as np

    terms, codes, bounds = split_words(folded(texts))
    n = np.diff(bounds)
    if not len(codes):
        return None
    have = np.flatnonzero(n)
    ids, n = ids.take(pa.array(have)), n[have]
    width = max(1, int(len(n) - 1).bit_length())
    pairs = np.sort(codes.astype(np.int64) << width | np.repeat(np.arange(len(n)), n))
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    tf, pairs = np.diff(starts, append=len(pairs)), pairs[starts]
    doc = pairs & ((1 << width) - 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * stats.lengths(n)[doc])
    # Terms in order, the highest impact of each first; an impact is below 2 ** 20.
    order = np.argsort((pairs >> width) << 20 | ((1 << 20) - 1 - impact), kind="stable")
    code, doc, impact = (pairs >> width)[order], doc[order], impact[order].astype(np.int32)
    df = np.bincount(code, minlength=len(terms))
    first = np.cumsum(df) - df
    rank = np.arange(len(code)) - first[code]
    out, upto = [ids, pa.array([terms], pa.list_(pa.string())), pa.array([df.astype(np.int32)], pa.list_(pa.int32()))], np.zeros(len(terms), np.int64)
    for share, least in (*tiers, (1, 0)):
        end = np.minimum(df, np.maximum(least, np.ceil(share * df).astype(np.int64)))
        here = np.flatnonzero((rank >= upto[code]) & (rank < end[code]))
        rest = np.zeros(len(terms), np.int32)
        more = np.flatnonzero(end < df)
        rest[more] = impact[first[more] + end[more]]
        out += [np.cumsum(end - upto).astype(np.int32), doc[here].astype(np.int32), impact[here], rest]
        upto = end
    return [pa.array([out[0]], pa.list_(out[0].type)), *out[1:3], *[pa.array([x.tobytes()], pa.binary()) for x in out[3:]]]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, tiers: tuple = TIERS) -> Index:
    """The index of all documents, in the shared folder: (block, ids, terms, df) and per tier ends, docs, impacts, rest."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    row = in_arrow(docs.select("text"), _counts, "documents long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms")]).first()
    stats = Statistics(*row)
    schema = _schema(docs.schema["doc_id"].dataType, len(tiers) + 1)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, made
            if held:
                ids, texts = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
                held, size = [], 0
                if (cols := _block(ids.cast(id_type), texts, stats, tiers)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), *cols], names=schema.names)
                    made += 1

        for batch in batches:
            for part in slices(batch, "text", block_bytes // 4):
                for k in range(0, part.num_rows, BLOCK_DOCS):
                    piece = part.slice(k, BLOCK_DOCS)
                    if held and (size + piece.nbytes > block_bytes or sum(len(h[0]) for h in held) + piece.num_rows > BLOCK_DOCS):
                        yield from flush()
                    held.append((piece.column("doc_id"), piece.column("text").cast(pa.string())))
                    size += piece.nbytes
        yield from flush()

    return Index(Stash(docs.sparkSession).put(in_arrow(docs, each, schema), options=ROW_GROUPS), stats, len(tiers) + 1)


class Block:
    """An index row in a task, with the places of a batch's terms in it."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: pa.Array, tiers: int):
        import numpy as np
        import pyarrow.compute as pc

        self.id = batch.column("block")[row].as_py()
        self.ids = batch.column("ids")[row].values
        self.unnamed = np.asarray(self.ids.is_null())
        self.place = pc.fill_null(pc.index_in(vocabulary, value_set=batch.column("terms")[row].values), -1).to_numpy(zero_copy_only=False)
        part = lambda name: np.frombuffer(batch.column(name)[row].as_buffer(), np.int32)
        self.tiers = [[part(f"{name}{k}") for name in ("ends", "docs", "impacts", "rest")] for k in range(tiers)]

    def bounds(self, terms, values) -> Iterator[tuple]:
        """Tier by tier: (lower bounds of all documents, the largest upper bound of any); in the last the former are exact."""
        import numpy as np

        at = self.place[terms]
        values, at = values[at >= 0], at[at >= 0]
        score, met = np.zeros(len(self.ids), np.int64), []
        for ends, docs, impacts, rest in self.tiers:
            start = np.where(at > 0, ends[at - 1], 0).astype(np.int64)
            size = ends[at] - start
            which = np.repeat(np.arange(len(at)), size)
            row = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]
            doc = docs[row]
            np.add.at(score, doc, values[which] * impacts[row])
            met.append((doc, which))
            left = values * rest[at]
            total = int(left.sum())
            upper = score + total
            if total:
                for d, w in met:
                    np.subtract.at(upper, d, left[w])
            yield np.where(self.unnamed, 0, score), int(upper.max(initial=0))

    def exact(self, terms, values):
        *_, (score, _) = self.bounds(terms, values)
        return score

    def best(self, score, bar: int, most: int) -> list[tuple[int, object]]:
        """(score, place) of the best documents at or above the bar, ties by id."""
        import numpy as np

        found = np.flatnonzero(score >= max(bar, 1))
        if len(found) > most:
            found = found[score[found] >= np.partition(score[found], -most)[-most]]
        return sorted(((int(score[i]), int(i)) for i in found), key=lambda x: (-x[0], self.ids[x[1]].as_py()))[:most]


@dataclass
class Batch:
    """Items of bounded size, as every task gets them."""

    vocabulary: list[str]
    items: list[tuple]  # numpy arrays: places in the vocabulary, how often

    def valued(self, weights: list[int]) -> list[tuple]:
        import numpy as np

        w = np.array(weights, np.int64)
        return [(t, q * w[t]) for t, q in self.items]


def _over(blocks: DataFrame, batch: Batch, tiers: int, f, schema: str) -> DataFrame:
    """f(iterator of Block) -> iterator of rows, over the blocks of each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    sent = blocks.sparkSession.sparkContext.broadcast(batch.vocabulary)
    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(sent.value, pa.string())
        rows, names = [], arrow.names
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=names)
        for row in f(Block(b, i, vocabulary, tiers) for b in batches for i in range(b.num_rows)):
            rows.append(row)
            if len(rows) >= 20_000:
                yield pack()
                rows = []
        if rows:
            yield pack()

    return in_arrow(blocks, each, schema)


def _columns(tiers: int) -> list[str]:
    return ["block", "ids", "terms", *[f"{name}{k}" for k in range(tiers) for name in ("ends", "docs", "impacts", "rest")]]


def _batches(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, Batch]]:
    """(ids, batch) of all items: hashed parts, made finer until each is a batch or a single item."""
    import numpy as np

    spark = items.sparkSession
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    fields = "terms array<string>, times array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, bounds = split_words(folded(part.column("text")))
                terms, times = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    c, q = np.unique(codes[a:b], return_counts=True)
                    terms.append([words[i] for i in c.tolist()])
                    times.append(q)
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(terms, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    from pyspark.sql.types import _parse_datatype_string

    schema = StructType([StructField("item_id", rows.schema["item_id"].dataType), *_parse_datatype_string(fields).fields])
    rows = Stash(spark).put(in_arrow(rows, each, schema).where(F.size("terms") > 0))
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "terms", "times"), F.lit(parts))
        sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).collect()
        if all(s["n"] == 1 or s["n"] <= BATCH_ITEMS and s["terms"] <= BATCH_TERMS for s in sizes):
            break
        parts *= 4
    for s in sorted(sizes, key=lambda s: s["part"]):
        found = rows.where(part == s["part"]).collect()  # within the bounds just measured
        vocabulary = sorted({t for r in found for t in r["terms"]})
        at = {t: i for i, t in enumerate(vocabulary)}
        yield [r["item_id"] for r in found], Batch(vocabulary, [(np.array([at[t] for t in r["terms"]]), np.array(r["times"], np.int64)) for r in found])


def _ranked(df: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of each item by order, with their rank; tasks keep no more than that of each item before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of every item with a score above 0, equal scores by id."""
    spark = index.blocks.sparkSession
    id_type = index.blocks.schema["ids"].dataType.elementType
    item_type = items.schema[item_id].dataType
    schema = StructType([StructField("item_id", item_type), StructField("rank", IntegerType()), StructField("doc_id", id_type), StructField("score", LongType())])
    out = None
    for ids, batch in _batches(items, item_id, text):
        found = _searched(index, batch, most, id_type)
        named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", item_type)])))
        found = found.join(named, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        if out is None:
            out = Stash(spark).folder()
        found.write.mode("append").parquet(out)
    return spark.createDataFrame([], schema) if out is None else spark.read.schema(schema).parquet(out)


def _searched(index: Index, batch: Batch, most: int, id_type) -> DataFrame:
    """(item, rank, doc_id, score) of a batch; item: its place in the batch."""
    import numpy as np

    blocks, tiers, stash = index.blocks, index.tiers, Stash(index.blocks.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        vocabulary, total = pa.array(sent.value, pa.string()), np.zeros(len(sent.value), np.int64)
        for b in batches:
            for terms, df in zip(b.column("terms"), b.column("df"), strict=True):
                at = pc.fill_null(pc.index_in(vocabulary, value_set=terms.values), -1).to_numpy(zero_copy_only=False)
                total[at >= 0] += df.values.to_numpy()[at[at >= 0]]
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(total[here])], names=["term", "df"])

    sent = blocks.sparkSession.sparkContext.broadcast(batch.vocabulary)
    df = dict(in_arrow(blocks.select("terms", "df"), frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())  # a row a term of the batch at most
    items = batch.valued([index.statistics.weight(df.get(i, 0)) for i in range(len(batch.vocabulary))])

    def promising(found: Iterator[Block]) -> Iterator[tuple]:
        """Of the first tier: an item's best documents of the task by lower bound, and what its other blocks may hold."""
        best: list[list] = [[] for _ in items]
        above: list[list] = [[] for _ in items]
        for block in found:
            for k, (terms, values) in enumerate(items):
                score, upper = next(block.bounds(terms, values))
                bar = best[k][-1][0] if len(best[k]) == most else 1
                if upper >= bar:
                    above[k].append((upper, block.id))
                if len(new := block.best(score, bar, most)):
                    best[k] = sorted(best[k] + [(s, block.id, i) for s, i in new], key=lambda x: -x[0])[:most]
        for k, rows in enumerate(best):
            bar = rows[-1][0] if len(rows) == most else 1
            yield from ((k, s, b, i, None) for s, b, i in rows)
            yield from ((k, None, b, None, u) for u, b in above[k] if u >= bar)

    first = stash.put(_over(blocks.select(_columns(1)), batch, 1, promising, "item int, low long, block long, place int, upper long"))
    chosen = _ranked(first.where(F.col("low").isNotNull()), most, F.desc("low"), "block", "place").select("item", "block").distinct().collect()  # most * items rows at most
    by_block: dict[int, list[int]] = {}
    for r in chosen:
        by_block.setdefault(r["block"], []).append(r["item"])

    def completed(found: Iterator[Block]) -> Iterator[tuple]:
        for block in found:
            for k in by_block.get(block.id, ()):
                yield from ((k, s) for s, _ in block.best(block.exact(*items[k]), 1, most))

    bars = [1] * len(items)
    if by_block:
        whole = _over(blocks.where(F.col("block").isin(sorted(by_block))).select(_columns(tiers)), batch, tiers, completed, "item int, score long")
        for r in _ranked(whole, most, F.desc("score")).where(F.col("rank") == most).collect():
            bars[r["item"]] = r["score"]

    def proven(found: Iterator[Block]) -> Iterator[tuple]:
        """Documents at or above the bar; an item falls through a block's tiers until the bounds prove it has none, or the last."""
        for block in found:
            for k, (terms, values) in enumerate(items):
                for score, upper in block.bounds(terms, values):  # noqa: B007
                    if upper < bars[k]:
                        break
                else:
                    yield from ((k, block.ids[i].as_py(), s) for s, i in block.best(score, bars[k], most))

    bar = F.element_at(F.lit(bars), F.col("item") + 1)
    open_blocks = first.where(F.col("upper") >= bar).select("block").distinct()
    schema = StructType([StructField("item", IntegerType()), StructField("doc_id", id_type), StructField("score", LongType())])
    open_blocks = stash.put(open_blocks)
    if open_blocks.limit(MOST_NAMED + 1).count() <= MOST_NAMED:
        blocks = blocks.join(F.broadcast(open_blocks), "block", "left_semi")
    return _ranked(_over(blocks.select(_columns(tiers)), batch, tiers, proven, schema), most, F.desc("score"), "doc_id")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP12_SQL = r"""
with folded as (
  select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), postings as (select r, doc_id, term, count(*) as tf from folded group by all
), docs as (select r, sum(tf)::bigint as n from postings group by r
), totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from docs
), weights as (select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, totals group by term
), wanted as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by all
), scores as (
  select item_id, r, any_value(doc_id) as doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::bigint as score
  from wanted join weights using (term) join postings using (term) join docs using (r), totals group by item_id, r
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
