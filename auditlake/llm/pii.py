"""Personal data by fixed patterns, and by contexts learned from them: bootstrapped extraction.

1. One pass over the texts finds the fixed patterns (the seeds) and identifier-like strings beside them: six or
   more letters and digits with three digits or an at sign, which no fixed pattern covers. The words around each
   give its lexical patterns: the word before, two before, one on either side, the word after, two after.
2. A pattern is a candidate for a kind if LEAST_SUPPORT different seeds of that kind stand in it. A second pass counts
   what else stands in these patterns, so that a pattern's confidence is its share of personal data among all that it
   meets: "the _" meets every noun, "phone: _" hardly anything but numbers. Only counts of patterns leave that pass,
   chosen by a bit map of fixed size and then exactly by a join.
3. Patterns and instances form a graph, scored in rounds: a pattern's confidence is the sum of its instances' scores
   over all it meets and one unknown more, an unseen instance's score the noisy-or of its patterns of some confidence. Seeds score 1, and so
   does an unseen spelling of a seed's letters and digits.
4. Instances of LEAST_SCORE or more are personal data wherever they stand as identifier-like strings.

Edges are distinct (pattern, value, kind), summed before they are shuffled, so copies of a text add nothing to a
pattern's support and a frequent pattern or value is one sum a task. Joins on a frequent pattern are plain equi-joins,
which Spark splits.

Defined results: a null or empty text has no spans; very long texts are read whole; the fixed patterns take time in
proportion to a text's length; repeated rows are found alike and a repeated identifier counts once; ids may be null or
repeat; an empty table gives an empty result; a text's surrogates or other odd characters are characters like any
other; names of other columns cannot clash, for only the columns named in ``keep`` are returned.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StructField, StructType

from .common import Stash, in_arrow, slices
from .ngrams import _MIX, _mixed, split_words

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

LEAST_SUPPORT = 3
LEAST_SCORE = 0.8
#: Patterns under this confidence say nothing about an instance.
LEAST_CONFIDENCE = 0.5
ROUNDS = 3
MOST_CHARS = 64  # longer strings are no identifiers
MAP_BITS = 24

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a row of digits, so they are tried once
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9@]")
_token = re.compile(r"[^\x20\x09-\x0D:=]+[:=]*|[:=]+")
_numeric = re.compile(r"[0-9().+-]*[0-9][0-9().+-]*\Z")
_digits, _other = re.compile(r"[0-9]+"), re.compile(r"[^0-9a-z]+")
_edges = "\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, by at signs: each character is looked at once on either side."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _local:
            a -= 1
        m = _domain.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place of the kind, start, end) of the fixed patterns, in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _digit.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def is_plain(token: str) -> bool:
    """A token that is no number and holds neither three digits nor an at sign: never part of an identifier."""
    return "@" not in token and sum(map(len, _digits.findall(token))) < 3 and not _numeric.match(token)


def value_of(s: str) -> str:
    """Letters and digits of an identifier, however it is written."""
    return _other.sub("", s.lower())


def is_identifier(s: str) -> bool:
    return len(value_of(s)) >= 6 and ("@" in s or sum(map(len, _digits.findall(s))) >= 3) and len(s) <= MOST_CHARS


def word_form(token: str) -> str:
    """A token as a word of a context: lower case, without quotes and brackets, digits alike."""
    return _digits.sub("0", token.lower().strip(_edges))


def word_key(form: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass"))


OUTSIDE = "\n"  # no token is a line end: stands for what is before the first and after the last word
#: The patterns of a place, as indices into (two before, one before, one after, two after).
SHAPES = ((1,), (0, 1), (1, 2), (2,), (2, 3))


def pattern_keys(words: list) -> list:
    """The 64-bit key of each of SHAPES from four arrays of word keys."""
    import numpy as np

    out = []
    for i, shape in enumerate(SHAPES):
        key = np.full(len(words[0]), i + 1, np.uint64)
        for k in shape:
            key = _mixed(key * np.uint64(_MIX) + words[k])
        out.append(key)
    return out


def places(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, tuple[str, ...]]]:
    """(kind, start, end, value key, four context words) of the seeds (kind 0 and up), other identifiers (-1) and other numbers (-2) of a text."""
    if not _digit.search(text):
        return []
    tokens = [m.span() for m in _token.finditer(text)]
    starts = [a for a, _ in tokens]
    word = lambda i: word_form(text[slice(*tokens[i])]) if 0 <= i < len(tokens) else OUTSIDE
    context = lambda i, j: (word(i - 2), word(i - 1), word(j + 1), word(j + 2))
    out, covered = [], set()
    for kind, a, b in base:
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b) - 1
        covered.update(range(i, j + 1))
        out.append((kind, a, b, word_key(value_of(text[a:b])), context(i, j)))
    some = sorted({bisect.bisect_right(starts, m.start()) - 1 for m in _digit.finditer(text)} - covered)
    k = 0
    while k < len(some):
        i = j = some[k]
        a, b = tokens[i]
        if _numeric.match(text, a, b):  # numbers one blank apart are one
            while k + 1 < len(some) and some[k + 1] == j + 1 and tokens[j + 1][0] == b + 1 and text[b] == " " and _numeric.match(text, *tokens[j + 1]):
                j, b, k = j + 1, tokens[j + 1][1], k + 1
        k += 1
        if i == j and is_plain(text[a:b]):
            continue
        at = context(i, j)
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        s = text[a:b]
        out.append((-1, a, b, word_key(value_of(s)), at) if is_identifier(s) else (-2, a, b, 0, at))
    return out


def _first_pass(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(row, keep as k0.., spans, places) of each row; row: a number of its own."""
    span = StructType([StructField("kind", ByteType()), StructField("start", LongType()), StructField("end", LongType())])
    place = StructType([*span.fields, StructField("value", LongType()), StructField("patterns", ArrayType(LongType()))])
    docs = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    schema = StructType([StructField("row", LongType()), *docs.schema.fields[:-1], StructField("spans", ArrayType(span)), StructField("places", ArrayType(place))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_type

        at = TaskContext.get().partitionId() << 40
        types = [to_arrow_type(schema[c].dataType) for c in ("spans", "places")]
        names = ("kind", "start", "end", "value", "patterns")
        for batch in batches:
            for part in slices(batch, "text"):
                spans, found = [], []
                for t in part.column("text").to_pylist():
                    base = base_spans(t) if t else []
                    here = places(t, base) if t else []
                    keys = np.array([[word_key(w) for w in p[4]] for p in here], np.uint64).reshape(-1, 4)
                    keys = np.array(pattern_keys(list(keys.T))).T.view(np.int64).tolist() if here else []
                    spans.append([dict(zip(names, s, strict=False)) for s in base])
                    found.append([dict(zip(names, (*p[:3], p[3] - (1 << 64) if p[3] >> 63 else p[3], k), strict=True)) for p, k in zip(here, keys, strict=True)])
                rows = pa.array(np.arange(at, at + part.num_rows))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, *part.columns[:-1], pa.array(spans, types[0]), pa.array(found, types[1])], names=schema.names)

    return in_arrow(docs, each, schema)


def _bit_map(patterns: DataFrame) -> bytes:
    """Bits of the keys' lowest MAP_BITS bits: 2 megabytes, however many patterns there are."""
    import numpy as np

    low = f"pattern & {(1 << MAP_BITS) - 1}"
    words = patterns.groupBy(F.expr(f"({low}) div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pattern & 63 as int)))").alias("bits")).collect()  # 2 ** 18 rows at most
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in words:
        out[r["w"]] = r["bits"]
    return out.tobytes() if words else b""


def _plain_fillers(docs: DataFrame, text: str, bits: bytes) -> DataFrame:
    """(pattern, n): how often a plain token stands in each pattern whose bit is set, summed by slices of tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        marked = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        outside, low = np.uint64(word_key(OUTSIDE)), np.uint64((1 << MAP_BITS) - 1)
        for batch in batches:
            for part in slices(batch, "text"):
                words, index, bounds = split_words(pc.replace_substring_regex(part.column("text"), "([:=]+)", "\\1 "))
                if not len(index):
                    continue
                forms: dict[str, int] = {}
                keys = np.fromiter((forms[f] if (f := word_form(w)) in forms else forms.setdefault(f, word_key(f)) for w in words), np.uint64, len(words))[index]
                plain = np.fromiter(map(is_plain, words), bool, len(words))[index]
                near, at = [], np.arange(len(index))
                first, last = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
                for step in (-2, -1, 1, 2):
                    to = at + step
                    near.append(np.where((to >= first) & (to < last), keys[np.clip(to, 0, len(keys) - 1)], outside)[plain])
                hits = np.concatenate([k[marked[(k & low).astype(np.int64)]] for k in pattern_keys(near)])
                patterns, n = np.unique(hits, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns.view(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return in_arrow(docs.select(F.col(text).cast("string").alias("text")), each, "pattern long, n long")


def learn(docs: DataFrame, rows: DataFrame, text: str, stash: Stash, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, support, met, confidence) and (value, kind, score) of unseen values; rows: the first pass, as written."""
    found = rows.select(F.explode("places").alias("p")).select("p.kind", "p.value", F.explode("p.patterns").alias("pattern"))
    edges = stash.put(found.where("kind > -2").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")).drop("n"))
    supported = stash.put(edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= LEAST_SUPPORT))
    names = supported.select("pattern").distinct()
    bits = _bit_map(names)
    others = found.where("kind = -2").groupBy("pattern").agg(F.count("*").alias("n"))
    if bits:
        others = others.unionByName(_plain_fillers(docs, text, bits).groupBy("pattern").agg(F.sum("n").alias("n")))
    edges = stash.put(edges.join(names, "pattern", "left_semi"))
    met = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n")).unionByName(others.join(names, "pattern", "left_semi"))
    patterns = stash.put(supported.join(met.groupBy("pattern").agg(F.sum("n").alias("met")), "pattern"))

    unseen = edges.where("kind = -1").select("pattern", "value")
    respelled = found.where("kind = -1").select("value").distinct().join(found.where("kind >= 0").select("value", "kind").distinct(), "value").withColumn("score", F.lit(1.0))
    respelled = stash.put(respelled)
    gained, scores, confident = None, respelled, None
    for r in range(rounds):
        rated = patterns if gained is None else patterns.join(gained, ["pattern", "kind"], "left")
        more = F.lit(0.0) if gained is None else F.coalesce("gained", F.lit(0.0))
        confident = stash.put(rated.select("pattern", "kind", "support", "met", ((F.col("support") + more) / (F.col("met") + 1)).alias("confidence")))
        miss = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        voted = unseen.join(confident.where(F.col("confidence") >= LEAST_CONFIDENCE), "pattern").groupBy("value", "kind").agg((1 - miss).alias("score"))
        scores = stash.put(voted.unionByName(respelled).groupBy("value", "kind").agg(F.round(F.max("score"), 9).alias("score")))
        if r + 1 < rounds:
            gained = stash.put(unseen.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("gained")))
    return confident, scores


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: its columns ``keep`` and ``pii_spans``, array<struct<kind, start, end>> by kind, then start.

    The kinds are KINDS and, for what contexts tell, the same with ``found_`` before them.
    """
    stash = Stash(docs.sparkSession)
    rows = stash.put(_first_pass(docs, text, list(keep)))
    _, scores = learn(docs, rows, text, stash)
    # The best kind of a value, the first one listed where kinds tie.
    best = scores.where(F.col("score") >= LEAST_SCORE).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    unseen = rows.select("row", F.explode("places").alias("p")).where("p.kind = -1").select("row", "p.value", "p.start", "p.end")
    own = unseen.join(best, "value").groupBy("row").agg(F.collect_list(F.struct((F.col("kind") + len(KINDS)).cast("byte").alias("kind"), "start", "end")).alias("own"))  # those of one text
    every = F.array_sort(F.concat("spans", F.coalesce("own", F.array().cast(rows.schema["spans"].dataType))))
    names = F.array(*[F.lit(k) for k in (*KINDS, *[f"found_{k}" for k in KINDS])])
    named = F.transform(every, lambda s: F.struct(F.element_at(names, s["kind"].cast(IntegerType()) + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("row", *[f"k{i}" for i in range(len(keep))], "spans").join(own, "row", "left").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], named.alias("pii_spans"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kinds: F.size(F.filter("pii_spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id",
        *[count([k]).alias(f"n_{k}") for k in KINDS],
        F.sha2(line(F.filter("pii_spans", lambda s: s["kind"].isin(*KINDS))).cast("binary"), 256).alias("base_sha256"),
        line(F.col("pii_spans")).alias("spans"),
        count([f"found_{k}" for k in KINDS]).alias("n_found"),
    )


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """The base columns by the plain patterns, for tests."""
    t, spans = text or "", []
    tests = {
        "email": lambda m: True, "ip": lambda m: all(re.fullmatch("0*(2[0-4][0-9]|25[0-5]|1?[0-9]?[0-9])", x) for x in m.group().split(".")), "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15,
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
    }
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, t) if tests[kind](m)]
    return (*[sum(k == s[0] for s in spans) for k in KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())
