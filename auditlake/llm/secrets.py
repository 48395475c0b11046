"""Secret scan: fixed patterns plus a token-efficiency test for random strings.

A random string costs many tokens: a byte-pair vocabulary has no long entries for it, so its characters per
token stay low, while words, identifiers and paths reach three to six. Candidates are runs of 16 or more printable
ASCII characters, ended by blanks and quotes; brackets, commas, semicolons, bars and backslashes end them too, save
for strings that mix all kinds of characters. Segments of vocabulary words, known digests (hex of a digest's length)
and UUIDs divide a run, and each stretch between them is tested by itself; numbers, dates and versions are left out.

Defined results: null or empty text has no spans; very long texts are scanned whole, in pieces only where a
candidate cannot reach across; repeated rows are judged row by row; an empty table gives an empty result;
other columns of the input are kept by ``scan`` untouched and its own column names are made unique.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, in_arrow, resource, slices

# The three base patterns and the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

VOCABULARY = "byte_bpe_50k.tiktoken"
MOST_CHARS_PER_TOKEN = 2.2
LEAST_LENGTH = 16
SHORT = 20


def _rank_file(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Encoding:
    """A tiktoken encoding with what is known of words under it: at most WORDS of them."""

    WORDS = 1 << 15

    def __init__(self, rank_file: str):
        import public_tokenizers
        import tiktoken

        with open(_rank_file(rank_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tiktoken = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bool] = {}

    def encode_ordinary(self, text: str) -> list[int]:
        return self.tiktoken.encode_ordinary(text)

    def is_word(self, part: str) -> bool:
        """Whether letters are in the vocabulary: up to six as one token, more at 3.5 characters a token or more."""
        if part not in self.words:
            if len(self.words) >= self.WORDS:
                self.words.clear()
            tokens = min(len(self.encode_ordinary(p)) for p in (part, part.lower(), " " + part.lower(), " " + part.capitalize()))
            self.words[part] = tokens == 1 if len(part) <= 6 else len(part) >= 3.5 * tokens
        return self.words[part]


def encoding(rank_file: str) -> Encoding:
    """The encoding of a local rank file, without special tokens; kept while tasks of this kind run in the process."""
    return resource(f"ranks {rank_file}", lambda: Encoding(rank_file))


_assign = re.compile(ASSIGN, re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run under 20 characters fails as a whole, so the bound may stand in the pattern
_hex = re.compile(r"[0-9a-f]{24,}")
_run = re.compile(r"[!#-&(-_a-~]{%d,}" % LEAST_LENGTH)
_names_run = re.compile(r"[!#-&*+./0-9:=?@A-Z^_a-z~-]{%d,}" % LEAST_LENGTH)
_range = re.compile(r"A-Z|a-z|0-9")
_uuid = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
_digest = re.compile(r"[0-9a-fA-F]+\Z")
_segment = re.compile(r"[A-Za-z0-9]+")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_names, _mark = re.compile(r"[-_./:?]"), re.compile(r"[^A-Za-z0-9]")
_edge = re.compile(r"[^A-Za-z0-9]*")
_BEFORE, _after = "!@#$%^*+_~-", re.compile(r"[!@#$%^&*+=_~-]*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    out = [("assign", *m.span()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", *m.span()) for m in _access.finditer(text)]
    return out + [("hex", *m.span()) for m in _hex.finditer(text)]


def known_harmless(s: str, enc) -> bool:
    """A segment that is a digest, a row of neighbouring characters, or an identifier: half of it or more are vocabulary words of four letters or more."""
    if len(s) in DIGEST_LENGTHS and _digest.match(s):
        return True
    if len(s) >= LEAST_LENGTH and 2 * sum(ord(y) - ord(x) == 1 for x, y in itertools.pairwise(s)) >= len(s):
        return True
    return 2 * sum(len(p) for p in _part.findall(s) if 4 <= len(p) <= 40 and p[0].isalpha() and enc.is_word(p)) >= len(s)


def stretches(run: str, enc) -> Iterator[tuple[int, int, int]]:
    """The parts of a run between its UUIDs and harmless segments: where what is harmless before it ends, and the stretch from the first letter or digit to the last with the marks of keys beside them."""
    known = [m.span() for m in _uuid.finditer(run)][::-1]
    start, last = None, 0

    def wide(a: int, b: int) -> tuple[int, int, int]:
        while a > last and run[a - 1] in _BEFORE:
            a -= 1
        return last, a, _after.match(run, b).end()

    for m in _segment.finditer(run):
        a, b = m.span()
        while known and known[-1][1] <= a:
            known.pop()
        if (known and known[-1][0] <= a) or known_harmless(m.group(), enc):
            if start is not None:
                yield wide(start, end)
            start, last = None, b
        else:
            start, end = a if start is None else start, b
    if start is not None:
        yield wide(start, end)


def few_letters(n: int) -> float:
    """How many different letters n random ones of one case have at least: four fifths of the mean.

    Long words that a vocabulary does not know repeat their syllables; random letters seldom come again.
    """
    return 0.8 * 26 * (1 - (25 / 26) ** n)


def is_random(s: str, enc, most: float) -> bool:
    """The token-efficiency test, stricter where words and numbers come close to random strings.

    Letters with few digits or none may have 0.2 characters a token less, and so may strings under SHORT. Where nearly
    all are letters of one case, few of them may come twice. Words of one case are
    read apart, so that separators do not count. Numbers, dates, versions and paths of short names are left out: few
    letters, segments of under three characters, or none of eight between the separators of names.
    """
    if len(s) < LEAST_LENGTH:
        return False
    segments = _segment.findall(s)
    size = sum(map(len, segments))
    letters = sum(c.isalpha() for c in s)
    if 20 * letters < 3 * size or size < 3 * len(segments) or all(len(_mark.sub("", x)) < 8 for x in _names.split(s)):
        return False
    mostly = 7 * letters >= 6 * size and (s.islower() or s.isupper())
    if mostly and len({x for x in s if x.isalpha()}) < few_letters(letters):
        return False
    read, most = [s], most - 0.2 * (letters == size or mostly) - 0.2 * (len(s) < SHORT)
    if letters == size and all(x.islower() or x.isupper() or x.istitle() for x in segments):
        if size < LEAST_LENGTH:
            return False
        read = segments
    tokens = sum(len(enc.encode_ordinary(x[i : i + 4096])) for x in read for i in range(0, len(x), 4096))
    return sum(map(len, read)) <= most * tokens + 1e-9


def is_dense(s: str, enc, most: float) -> bool:
    """The test for strings full of marks, which code resembles: all kinds of characters, few of them twice, no ranges."""
    lower, upper, digits = (sum(map(f, s)) for f in (str.islower, str.isupper, str.isdigit))
    marks = len(set(_mark.findall(s)))
    if len(s) < LEAST_LENGTH or min(lower, upper) < 2 or not digits or marks < 4 or len(set(s)) < 0.85 * 91 * (1 - (90 / 91) ** len(s)) or _range.search(s):
        return False
    return len(s) <= (most - 0.6) * sum(len(enc.encode_ordinary(s[i : i + 4096])) for i in range(0, len(s), 4096))


def random_spans(text: str, base: list[tuple[str, int, int]], enc, most: float) -> list[tuple[str, int, int]]:
    """Stretches that the token-efficiency test finds, with the marks beside them, where no base span covers them."""
    out = []
    for m in _run.finditer(text):
        new = []
        if len(set(_mark.findall(m.group()))) >= 4:
            for last, _, b in stretches(m.group(), enc):
                b = _edge.match(m.group(), b).end()
                if is_dense(m.group()[last:b], enc, most):
                    new.append(("random", m.start() + last, m.start() + b))
        dense = len(new)
        for n in _names_run.finditer(text, *m.span()):
            for _, a, b in stretches(n.group(), enc):
                a, b, key = n.start() + a, n.start() + b, n.group()[a:b]
                if not any(x < b and a < y for _, x, y in new[:dense]) and is_random(key, enc, most):
                    new.append(("random", a, b))
        out += [s for s in new if not any(x <= s[1] and s[2] <= y for _, x, y in base)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, text: str = "text", out: str = "secret_spans", vocabulary: str = VOCABULARY, most_chars_per_token: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """docs with one more column, array<struct<kind, start, end>>, ordered by start, then kind.

    One narrow pass: no shuffle, and only a slice of an Arrow batch is unpacked at a time.
    """
    name = free_name(docs, out)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    base = base_spans(t or "")
                    rows.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(base + random_spans(t or "", base, enc, most_chars_per_token), key=lambda x: (x[1], KINDS.index(x[0])))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, arrow)], names=[*part.schema.names, name])

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
    return in_arrow(docs, each, StructType([*docs.schema.fields, StructField(name, kind)]), uses=f"ranks {vocabulary}")


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[secret]", vocabulary: str = VOCABULARY, most_chars_per_token: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """docs with every span replaced by a mark (overlapping spans by one); nothing else changes.

    Null texts stay null. Where a text changes, the column ``length``, if docs have it, gets its new length.
    Columns and their order are those of docs.
    """
    most = most_chars_per_token

    def one(t: str | None, enc) -> str | None:
        if not t:
            return t
        base, out, at = base_spans(t), [], 0
        for _, a, b in sorted(base + random_spans(t, base, enc, most), key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                k = part.schema.get_field_index(text)
                old = part.column(k).to_pylist()
                new = [one(t, enc) for t in old]
                part = part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
                if length is not None and (n := part.schema.get_field_index(length)) >= 0:
                    sizes = [x if t == u else len(u) for x, t, u in zip(part.column(n).to_pylist(), old, new, strict=True)]
                    part = part.set_column(n, part.schema.field(n), pa.array(sizes, part.schema.field(n).type))
                yield part

    return in_arrow(docs, each, docs.schema, uses=f"ranks {vocabulary}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secret_spans")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("secret_spans")).alias("spans"),
        count("random").alias("n_random"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns by the plain patterns, for tests."""
    t, spans = text or "", []
    for m in re.finditer(ASSIGN, t, re.I | re.A):
        if len(m.group(2)) >= 6:
            spans.append(("assign", *m.span()))
    for kind, pattern, least in (("access", ACCESS, 20), ("hex", HEX, 24)):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, t) if len(m.group()) >= least]
    return (*[sum(k == s[0] for s in spans) for k in KINDS[:3]], hashlib.sha256(joined(spans).encode()).hexdigest())
