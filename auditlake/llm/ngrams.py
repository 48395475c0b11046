"""Hashed n-gram features of texts, computed once per distinct word of a slice."""

from __future__ import annotations

import pyarrow as pa

_MIX = 0x9E3779B97F4A7C15


def _mixed(x):
    import numpy as np

    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def split_words(texts: pa.Array) -> tuple:
    """(distinct words, index of each word, bounds of the texts) of texts split at ASCII white space."""
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = words.offsets.to_numpy()
    flat = words.flatten()
    # Leading and trailing blanks make empty words; they are no words.
    keep = pc.greater(pc.binary_length(flat), 0)
    import numpy as np

    mask = keep.to_numpy(zero_copy_only=False).astype(bool)
    upto = np.concatenate([[0], np.cumsum(mask)])
    bounds = upto[bounds - bounds[0]]
    coded = flat.filter(keep).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds


def char_ngrams(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple:
    """(bucket, index of word) of every n-gram of code points of the words, ends marked."""
    import numpy as np

    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code))
    key, features, owners = np.zeros(len(code), np.uint64), [], []
    for n in range(1, max(orders) + 1):
        key = key * np.uint64(0x100000001B3) + np.uint64(n)
        m = len(code) - n + 1
        if m <= 0:
            break
        key = key[:m] ^ (code[n - 1 :] * np.uint64(_MIX))
        if n in orders:
            ok = at[:m] + n <= end[:m]
            features.append((_mixed(key[ok]) % np.uint64(buckets)).astype(np.int64))
            owners.append(word[:m][ok])
    if not features:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(features), np.concatenate(owners)


def word_keys(words: list[str]):
    """A 64-bit key of each word."""
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def pair_buckets(keys, index, bounds, buckets: int) -> tuple:
    """(bucket, index of text) of pairs of neighbouring words; a word followed by itself is one feature."""
    import numpy as np

    if len(index) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = keys[index]
    mixed = _mixed(k[:-1] * np.uint64(_MIX) + k[1:]) % np.uint64(buckets)
    mixed[index[:-1] == index[1:]] = 0
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = owner[:-1] == owner[1:]
    return mixed[same].astype(np.int64), owner[:-1][same]
