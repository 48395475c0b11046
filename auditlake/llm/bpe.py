"""Byte-level BPE with the tiktoken library and a local rank file: encoding and raw-byte decoding.

Long texts are cut before encoding at places that no match of the splitting pattern can cross: a single
space or line feed between two characters that are not white space. Every match is thus encoded as in the
whole text. A stretch without such a place stays whole.

Defined results: a null text is an empty one and has no ids; repeated rows are encoded row by row; an empty
table gives an empty result; other columns are kept, and new names are made unique.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import free_name, in_arrow, slices
from .secrets import encoding

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE = 50_000
_safe = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Runs of white space (Unicode's property) so long that the library's matcher would overflow its stack.
_blank = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of text, cut at the first safe place at least size characters on; True: exactly one match.

    A very long run of white space is a match by itself up to its last character, which opens the next part
    (there it stands alone or, as a space, joins the next word); at the end of the text it is one match whole.
    """
    at = 0
    for m in _blank.finditer(text):
        if m.start() > at:
            yield from _cut(text, at, m.start(), size)
        at = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : at], True
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    while end - at > size and (m := _safe.search(text, at + size, end)):
        yield text[at : m.start()], False
        at = m.start()
    if at < end:
        yield text[at:end], False


def encode_text(text: str | None, enc) -> list[int]:
    """Ids of a whole text. Surrogates cannot come out of Parquet, so every text is valid UTF-8."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for p, single in pieces(text) for i in (enc._encode_single_piece(p) if single else enc.encode_ordinary(p))]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with their token ids as array<int>; one narrow pass."""
    name = free_name(docs, out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary).tiktoken
        for batch in batches:
            for part in slices(batch, text):
                ids = pa.array([encode_text(t, enc) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])

    return in_arrow(docs, each, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]), uses=f"ranks {vocabulary}")


def decode(rows: DataFrame, ids: str = "ids", out: str = "bytes", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the raw bytes of their ids (null ids: no bytes); bytes need not be valid UTF-8."""
    name = free_name(rows, out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary).tiktoken
        for batch in batches:
            raw = pa.array([enc.decode_bytes(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, name])

    return in_arrow(rows, each, StructType([*rows.schema.fields, StructField(name, BinaryType())]), uses=f"ranks {vocabulary}")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes in one pass and keeps digests only, so that no ids travel."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoding(vocabulary).tiktoken
        for batch in batches:
            for part in slices(batch, "text"):
                n, a, b = [], [], []
                for t in part.column("text").to_pylist():
                    ids = encode_text(t, enc)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs, each, StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]), uses=f"ranks {vocabulary}")
