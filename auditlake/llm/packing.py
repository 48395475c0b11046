"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Packing depends on lengths alone, and there are at most ``capacity`` of them. So the cluster counts lengths,
the driver packs that bounded histogram in bulk (equal lengths are handled together), and the cluster deals
the plan out again: the k-th piece of a length takes the k-th place planned for that length.

Reduction: an item whose best company is provable gets it for good. (a) Nothing fits beside it: alone.
(b) A partner fills the sequence exactly, or no two other items fit beside it: the largest that fits.
(c) Two fit, but no pair together beats the largest single one: that one. (d) Two fit, and the largest first
with the largest second beats every other pair member by member: those two. What is left is packed best-fit
decreasing: each item goes to the fullest open sequence that takes it.

Defined results: a null text is an empty one, of one token (the end mark); only documents over capacity are
cut; rows that repeat are packed each; an empty table gives an empty result; ties of length go by doc_id,
piece, checksum.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Stash, in_arrow, resource, slices

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END = 1
#: Parts of words whose ids a worker process keeps: about 10 MB.
CACHE_PARTS = 250_000


def _load(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


# What a vocabulary must say of itself for its words to be encoded by themselves.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Punctuation and Latin letters: no match of SPLIT holds both, and both stand for themselves under NFC.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


def splits_into_words(tokenizer) -> bool:
    """Whether a text's ids are those of its words between ASCII blanks, and of the letters and punctuation of these."""
    said = json.loads(tokenizer.to_str())
    steps = (said["normalizer"] or {}).get("normalizers", [])
    parts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and said["post_processor"] is None
        and said["truncation"] is None
        and bool(said["model"].get("end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) or re.fullmatch(r"\w*[^\w]*", t["content"]) for t in said["added_tokens"])
    )


class WordEncoder:
    """Ids of texts by ids of the parts of their words, without a step of Python for each word.

    The query's vocabulary drops white space, merges within words only, keeps letters and punctuation apart and
    does not tell capitals: a word of Latin letters with ASCII punctuation after it is two parts, the letters in
    lower case; any other word is one part. A slice's distinct parts are looked up among at most ``keep`` known
    ones (those of the last slices, in flat arrays); only new ones are encoded. A vocabulary that does not say
    all this of itself encodes whole texts.
    """

    def __init__(self, name: str, keep: int = CACHE_PARTS):
        import numpy as np

        self.tokenizer, self.keep = _load(name), keep
        self.by_words = splits_into_words(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # by id: whether the token closes a word
        if self.by_words:
            suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = re.compile(f"[{LETTERS.lower()}]+")
        self.known, self.flat, self.size = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _encoded(self, parts: list[str]) -> tuple:
        """(flat ids, number of ids) of parts, each by itself."""
        import numpy as np

        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        own = [np.array(e.ids, np.uint32) for e in found]
        return np.concatenate([np.empty(0, np.uint32), *own]), np.fromiter(map(len, own), np.int64, len(own))

    def _encoded_letters(self, parts: list[str]) -> tuple:
        """The same of parts of letters, many to a text: each ends with its one token that closes a word."""
        import numpy as np

        flats, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(parts), 2_000):
            some = parts[i : i + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                size = np.diff(ends, prepend=0)
            else:
                ids, size = self._encoded(some)
            flats.append(ids), sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)

    def _parts(self, parts: pa.Array) -> tuple:
        """(flat ids, number of ids) of distinct parts; remembers them first, then those of before."""
        import numpy as np
        import pyarrow.compute as pc

        at = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        words = parts.take(pa.array(fresh)).to_pylist()
        plain = np.fromiter((self.letters.fullmatch(w) is not None for w in words), bool, len(words))
        f1, s1 = self._encoded_letters([w for w, p in zip(words, plain.tolist(), strict=True) if p])
        f2, s2 = self._encoded([w for w, p in zip(words, plain.tolist(), strict=True) if not p])
        # Everything in one table: what was known, new letters, new others.
        flat, size = np.concatenate([self.flat, f1, f2]), np.concatenate([self.size, s1, s2])
        row = at.astype(np.int64)
        row[fresh[plain]] = len(self.size) + np.arange(len(s1))
        row[fresh[~plain]] = len(self.size) + len(s1) + np.arange(len(s2))
        used = np.zeros(len(self.size), bool)
        used[at[at >= 0]] = True
        old = np.flatnonzero(~used)[: max(0, self.keep - len(parts))]
        new = np.concatenate([row, old])
        self.flat, self.size = gathered(flat, size, new), size[new]
        self.known = pa.concat_arrays([parts, self.known.take(pa.array(old))])
        n = self.size[: len(parts)]
        return self.flat[: int(n.sum())], n

    def ids(self, texts: pa.Array) -> tuple:
        """(flat ids, ends) of the texts with the end mark after each, as numpy arrays."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if not self.by_words:
            flat, size = self._encoded(texts.to_pylist())
            ends = np.cumsum(size)
            return np.insert(flat, ends, np.uint32(END)).astype("<u4"), ends + np.arange(1, len(ends) + 1)
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary
        head = pc.utf8_rtrim(own, characters=PUNCTUATION)
        split = pc.match_substring_regex(head, f"^[{LETTERS}]+$")
        one = pc.if_else(split, pc.utf8_lower(head), own).dictionary_encode()
        two = pc.if_else(split, pc.utf8_ltrim(own, characters=LETTERS), "").dictionary_encode()
        parts = pa.concat_arrays([one.dictionary, two.dictionary]).dictionary_encode()
        flat, size = self._parts(parts.dictionary)
        place = parts.indices.to_numpy()
        a, b = place[: len(one.dictionary)][one.indices.to_numpy()], place[len(one.dictionary) :][two.indices.to_numpy()]
        # Ids by distinct word, then by word and end mark.
        flat = np.append(gathered(flat, size, np.stack([a, b], 1).ravel()), np.uint32(END))
        size = np.append(size[a] + size[b], 1)
        n = len(bounds) - 1
        order = np.full(bounds[-1] + n, len(own), np.int64)
        order[np.arange(bounds[-1]) + np.repeat(np.arange(n), np.diff(bounds))] = coded.indices.to_numpy()
        ends = np.cumsum(size[order])
        return gathered(flat, size, order).astype("<u4", copy=False), ends[bounds[1:] + np.arange(n)]


def gathered(flat, size, rows):
    """The parts ``rows`` of flat, which holds parts of the sizes given, one after another."""
    import numpy as np

    n = size[rows]
    start = (np.cumsum(size) - size)[rows]
    ends = np.cumsum(n)
    # A slice is a few megabytes of text and the parts known are bounded, so places fit 32 bits.
    take = np.repeat((start - (ends - n)).astype(np.int32), n)
    take += np.arange(len(take), dtype=np.int32)
    return flat[take]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document, tokenised in one narrow pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # Its known parts serve the tasks of this kind that follow in the worker process.
        encoder = resource(f"words {vocabulary}", lambda: WordEncoder(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                ids, ends = encoder.ids(part.column("text"))
                first = np.concatenate([[0], ends[:-1]])
                many = -(-(ends - first) // capacity)
                row = np.repeat(np.arange(len(ends)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, (ends - first)[row] - start)
                raw, at = memoryview(ids).cast("B"), 4 * (first[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, each, StructType([rows.schema["doc_id"], StructField("piece", IntegerType()), *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]]), uses=f"words {vocabulary}")


def reduce_instance(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sequences by dominance; count shrinks in place. Returns (lengths of a sequence, how many such)."""
    fixed = []
    lengths = sorted(x for x in count if count[x])

    def take(items: tuple[int, ...], n: int) -> None:
        fixed.append((items, n))
        for x in items:
            count[x] -= n
        for x in set(items):
            if not count[x]:
                lengths.remove(x)

    changed = True
    while changed:
        changed = False
        for j in sorted(lengths, reverse=True):
            while count.get(j, 0):
                room = capacity - j
                left = lambda x, j=j: count[x] - (x == j)  # noqa: E731  how many there are besides the item itself
                fits = lengths[: bisect_left(lengths, room + 1)]
                while fits and not left(fits[-1]):
                    fits.pop()
                if not fits:
                    take((j,), count[j])
                    changed = True
                    break
                best = fits[-1]
                small = [x for y in fits[:4] for x in [y] * min(3, left(y))][:3]
                pairs = len(small) > 1 and small[0] + small[1] <= room
                triples = len(small) > 2 and sum(small) <= room
                company: tuple[int, ...] = ()
                if best == room or not pairs:
                    company = (best,)
                elif not triples:
                    top = 0
                    for a in fits:  # the best sum of two
                        k = bisect_left(fits, room - a + 1) - 1
                        while k >= 0 and left(fits[k]) < 1 + (fits[k] == a):
                            k -= 1
                        if k >= 0:
                            top = max(top, a + fits[k])
                    if best >= top:
                        company = (best,)
                    else:
                        k = bisect_left(fits, room - best + 1) - 1
                        while k >= 0 and left(fits[k]) < 1 + (fits[k] == best):
                            k -= 1
                        if k >= 0:
                            above = [x for y in fits[k + 1 : k + 3] for x in [y] * min(2, left(y))][:2]
                            if len(above) < 2 or sum(above) > room:
                                company = (best, fits[k])
                if not company:
                    break
                items = (j, *company)
                # In bulk: taking such items away leaves fewer rivals, so the reasoning holds for all of them.
                take(items, min(count[x] // items.count(x) for x in items))
                changed = True
    return fixed


def plan(count: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all items: (length, first rank, how many, first sequence, offset), and the number of sequences.

    Ranks of a length run from 0; the places of an entry are consecutive ranks in consecutive sequences.
    """
    count = {x: n for x, n in count.items() if n}
    rank = dict.fromkeys(count, 0)
    places, sequences = [], 0

    def put(x: int, n: int, first: int, offset: int) -> None:
        places.append((x, rank[x], n, first, offset))
        rank[x] += n

    for items, n in reduce_instance(count, capacity):
        offset = 0
        for x in items:
            put(x, n, sequences, offset)
            offset += x
        sequences += n
    open_rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(open_rooms, room)
            groups[room].append((first, n))

    for x in sorted(count, reverse=True):
        n = count[x]
        while n:
            k = bisect_left(open_rooms, x)
            if k < len(open_rooms):
                room = open_rooms[k]
                first, have = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    open_rooms.pop(k)
            else:
                room, first = capacity, sequences
                have = -(-n // (capacity // x))
                sequences += have
            each = room // x
            full = min(have, n // each)
            for t in range(each if full else 0):
                put(x, full, first, capacity - room + t * x)
            n -= full * each
            keep(room - each * x, first, full)
            if full < have and n:
                for t in range(min(n, each)):
                    put(x, 1, first + full, capacity - room + t * x)
                used = min(n, each)
                n -= used
                keep(room - used * x, first + full, 1)
                full += 1
            keep(room, first + full, have - full)
    return places, sequences


def assign(parts: DataFrame, capacity: int = CAPACITY, stash: Stash | None = None) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    stash = stash or Stash(spark)
    parts = stash.put(parts)
    # At most ``capacity`` rows come to the driver.
    count = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan(count, capacity)
    total = sum(count.values())
    salts = min(65_536, max(256, total // 50_000))

    # Rank within (length, salt), then add what lower salts of that length hold: no length meets in one task.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    below = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array(sorted(places), np.int64).reshape(-1, 5)
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            row = table[k]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_arrow(ranked, each, StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their places: sequences of at most capacity tokens without gaps."""
    return assign(pieces(docs, doc_id, text, capacity, vocabulary), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
