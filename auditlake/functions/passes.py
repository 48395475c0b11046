"""Text functions as passes over the bytes of Arrow batches, for whole tables of long texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .text import ease

#: A batch is looked at in parts of so many bytes (or one text).
PART = 1 << 18
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: Marks of more than a byte, all of which begin with one of two bytes.
_WIDE = [c.encode() for c in " …‘’‚‛′“”„‟″‐‑‒–—―−"]


def normal_quote(text: bytes) -> bytes:
    """A lower-case text in UTF-8 as ``text.normal_quote`` has it."""
    text = text.translate(_PLAIN)
    if b"\xe2" in text or b"\xc2\xa0" in text:
        for c in _WIDE:
            text = text.replace(c, b" ")
    return b" ".join(text.split())


def normal_quotes(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column of texts made plain by ``normal_quote``."""
    ship(rows.sparkSession)

    def plain(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index(column)
            texts = pa.array([None if t is None else normal_quote(t) for t in b.column(i).cast(pa.large_binary()).to_pylist()], pa.large_binary())
            yield b.set_column(i, b.schema.field(i), texts.cast(b.schema.field(i).type))

    return rows.withColumn(column, F.lower(column)).mapInArrow(plain, rows.schema)


_BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def reading_counts(text) -> tuple:
    """Words, sentences and syllables of every text of an Arrow array, by the definitions of ``text.reading_ease``."""
    import numpy as np
    import pyarrow as pa

    text = text.cast(pa.large_binary())
    at, nothing = np.zeros(len(text) + 1, np.int64), np.zeros(len(text), np.int64)
    if len(text):
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if at[-1] == at[0]:
        return nothing, nothing + 1, nothing
    raw, at = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    cuts = [0]
    while cuts[-1] < len(text):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + PART, "right")) - 1))
    parts = [(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    counted = [(*_words(r, a), _sentences(r, a)) if len(r) else (a[1:], a[1:], a[1:] + 1) for r, a in parts]
    words, syllables, sentences = (np.concatenate(x) for x in zip(*counted, strict=True))
    return words, sentences, syllables


def _per_text(flags, borders):
    """Sums of flags between the borders of texts."""
    import numpy as np

    sums = np.concatenate([[0], np.cumsum(flags)])[borders]
    return sums[1:] - sums[:-1]


def _words(raw, at):
    """Words: runs of letters and apostrophes once all else but blanks is gone. Syllables: pairs of vowels in their letters."""
    import numpy as np

    kind = np.zeros(256, np.uint8)  # 1 blank, 2 apostrophe, a letter by itself
    kind[list(b" \t\n\x0b\f\r")], kind[ord("'")] = 1, 2
    for b in range(ord("a"), ord("z") + 1):
        kind[b] = kind[b - 32] = b
    is_vowel, silent_after = np.zeros(256, bool), np.ones(256, bool)
    is_vowel[list(b"aeiouy")], silent_after[list(b"laeiouy")] = True, False

    kinds = kind[raw]
    wide = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3) | (raw == 0xEF))
    if len(wide):
        more = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.int32)
        a, b, c = more[wide], more[wide + 1], more[wide + 2]
        point = np.where(a == 0xC2, b, ((a & 15) << 12) | ((b & 63) << 6) | (c & 63))
        kinds[wide[np.isin(point, _BLANKS)]] = 1
    kept = np.flatnonzero(kinds)
    c, first = kinds[kept], np.searchsorted(kept, at)
    piece = c > 1
    start = piece.copy()
    start[1:] &= ~piece[:-1]
    own = first[:-1][first[:-1] < len(c)]  # a text's first is no part of the word before
    start[own] = piece[own]
    n_words = _per_text(start, first)

    letters = np.flatnonzero(c > 2)
    if not len(letters):
        return n_words, np.zeros_like(n_words)
    x = c[letters]
    begin = np.flatnonzero(np.diff(np.cumsum(start)[letters], prepend=0))
    length = np.diff(np.append(begin, len(x)))
    long = length > 3
    vowel = is_vowel[x]
    initial = begin[long]
    vowel[initial[x[initial] == ord("y")]] = False
    end = (begin + length - 1)[long]
    z, y, w = x[end], x[end - 1], x[end - 2]
    vowel[end[(z == ord("e")) & silent_after[y]]] = False
    vowel[end[(y == ord("e")) & ((z == ord("d")) | (z == ord("s")) & silent_after[w])] - 1] = False
    before = np.concatenate([[False], vowel[:-1]])
    before[begin] = False
    place = np.arange(len(x), dtype=np.int32)
    run = np.maximum.accumulate(np.where(vowel & ~before, place, 0))
    pairs = np.add.reduceat((vowel & ((place - run) % 2 == 0)).astype(np.int64), begin)
    syllables = np.where(long, np.maximum(pairs, 1), 1)
    return n_words, _per_text(syllables, np.searchsorted(letters[begin], first))


def _sentences(raw, at):
    """Parts with more than spaces between runs of stops that end at a blank (which goes with them) or with the text; one at least."""
    import numpy as np

    space, border = np.zeros(256, np.int64), np.zeros(len(raw) + 1, bool)
    space[list(b" \t\n\x0b\f\r")], border[at] = 1, True
    stops = np.flatnonzero((raw == ord(".")) | (raw == ord("!")) | (raw == ord("?")))
    new = np.ones(len(stops), bool)
    new[1:] = (np.diff(stops) != 1) | border[stops[1:]]
    lo, hi = stops[new], stops[np.append(new[1:], True)[: len(stops)]] + 1
    blank = np.where(border[hi], 0, space[raw[np.minimum(hi, len(raw) - 1)]])
    ends = border[hi] | (blank > 0)
    lo, hi = lo[ends], (hi + blank)[ends]
    solid = np.concatenate([[0], np.cumsum(raw != ord(" "))])
    begins, closes = np.sort(np.concatenate([at[:-1], hi])), np.sort(np.concatenate([lo, at[1:]]))
    return np.maximum(1, _per_text(solid[closes] > solid[begins], np.arange(len(at)) + np.searchsorted(lo, at)))


def reading_eases(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ease, words) of the texts that have a word."""
    ship(rows.sparkSession)

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in reading_counts(b.column(1)))], [key, "words", "sentences", "syllables"])

    counted = rows.select(key, text).mapInArrow(counts, f"{key} {dict(rows.dtypes)[key]}, words long, sentences long, syllables long")
    return counted.where("words > 0").select(key, ease(F.col("words"), F.col("sentences"), F.col("syllables")).alias("ease"), "words")
