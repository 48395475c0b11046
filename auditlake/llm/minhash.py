"""MinHash near-duplicates: banding, signature verification, exact confirmation, star components.

1. One pass over the texts makes each document's shingle set and keeps its size, a digest, band keys and a
   one-byte-per-hash signature. Documents with equal sets are one class from here on, stood for by the least id.
2. Classes meet in bands. In every bucket one member, picked by the bucket's key, is the pivot, and members pair
   with it only: candidates grow with the documents, not with the square of a bucket.
3. Pairs whose signatures agree enough are confirmed on full sets, first the best pair of each class; components
   by stars. Pairs that a component already covers need no test.
4. Buckets that still hold several components are finished exactly: members outside the bucket's largest
   component meet all members of other components, in blocks of bounded size. Blocks carry signatures and set
   sizes only. First each such member's nearest one is confirmed, which joins most. Then blocks name the members
   that still have a partner worth a test, and only their full sets are dealt out again and compared; links alone
   come back. So every pair that shares a bucket is tested or connected; nothing is capped.

Sets are made again from the texts of candidates only, so they are never stored for all documents.

With 32 bands of 5 minima a pair of similarity 0.8 misses all buckets with probability 3e-6, and 160 signature
bytes of such a pair agree in fewer than 60 % with probability below 1e-9.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; repeated rows are one node of the graph, as all rows
of one doc_id are; rows with a null doc_id stay alone; ids of other types than integers are numbered first; an empty table gives an empty result; other columns are
not read by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegralType, LongType, StructField, StructType

from .common import Stash, in_arrow, slices
from .components import components
from .ngrams import _MIX, _mixed, split_words, word_keys

BANDS, ROWS = 32, 5
LEAST_AGREEMENT = 0.6
#: About how many texts of ordinary length one side of a block holds.
STRAYS, MEMBERS = 128, 512
#: Size of the filter that finds the texts of candidates: 262,144 rows, a few megabytes.
FILTER_BITS = 1 << 24


def shingle_sets(texts: pa.Array, width: int) -> list:
    """Sorted distinct 64-bit shingles of each text."""
    import numpy as np
    import pyarrow.compute as pc

    words, index, bounds = split_words(pc.ascii_lower(texts))
    keys = _mixed(word_keys(words))[index] if len(index) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(keys) - width + 1), np.uint64)
    for i in range(width):
        rolled = _mixed(rolled * np.uint64(_MIX) + keys[i : len(keys) - width + 1 + i]) if len(rolled) else rolled
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = _mixed(h * np.uint64(_MIX) + keys[i : i + 1])
            out.append(h)
        else:
            out.append(keys[:0])
    return out


def _hashes(bands: int, rows: int) -> tuple:
    import numpy as np

    rng = np.random.default_rng(20240229)
    n = bands * rows
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(s, a, b):
    """The least value of every universal hash a*x+b (mod 2^64) over a set."""
    import numpy as np

    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[None, i : i + 2048] * a[:, None] + b[:, None]).min(1), out=out)
    return out


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set, null if empty), bands, signature; docs: doc_id, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        a, b = _hashes(bands, rows)
        salt = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        last: dict[bytes, tuple] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                n, d1, d2, keys, sig = [], [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    n.append(len(s))
                    if not len(s):
                        d1.append(None), d2.append(None), keys.append(None), sig.append(None)
                        continue
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest not in last:
                        m = minima(s, a, b)
                        k = salt.copy()
                        for i in range(rows):
                            k = _mixed(k * np.uint64(_MIX) + m[i::rows])
                        if len(last) > 2_000:
                            last.clear()
                        last[digest] = (k.view(np.int64), (_mixed(m) & np.uint64(255)).astype(np.uint8).tobytes())
                    k, g = last[digest]
                    x, y = np.frombuffer(digest, np.int64).tolist()
                    d1.append(x), d2.append(y), keys.append(k), sig.append(g)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])

    return in_arrow(docs, each, StructType([docs.schema["doc_id"], *[StructField(c, LongType()) for c in ("n_shingles", "d1", "d2")], StructField("bands", ArrayType(LongType())), StructField("signature", BinaryType())]))


def _joined(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs (a, b, ...) with the values of both ends as va, vb."""
    one = table.select(F.col("rep").alias("a"), F.col(value).alias("va"))
    two = table.select(F.col("rep").alias("b"), F.col(value).alias("vb"))
    return pairs.join(one, "a").join(two, "b")


def agreeing(pairs: DataFrame, reps: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """a, b, agree of the pairs whose signatures agree in at least the share ``least``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in batches:
            if x.num_rows:
                va, vb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("va", "vb"))
                agree = (va == vb).sum(1)
                ok = agree >= least * va.shape[1]
                yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(ok)), x.column("b").filter(pa.array(ok)), pa.array(agree[ok].astype(np.int64))], names=["a", "b", "agree"])

    rows = _joined(pairs, reps, "signature").select("a", "b", "va", "vb")
    return in_arrow(rows, each, StructType([rows.schema["a"], rows.schema["b"], StructField("agree", LongType())]))


def marked(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The docs whose id may be among the reps wanted: none of these is missing, others may stay.

    The ids set bits of a filter of fixed size, at most ``bits`` / 64 rows of two numbers, which is broadcast. So
    texts are not shuffled to find the wanted ones, however many these are; where they outgrow the filter, more
    texts pass, and the joins that follow drop them.
    """
    h = lambda c: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(_h % 64 as int))")
    filled = wanted.select(h("rep").alias("_h")).groupBy(F.floor(F.col("_h") / 64).alias("_w")).agg(F.bit_or(one).alias("_bits"))
    rows = docs.withColumn("_h", h("doc_id")).withColumn("_w", F.floor(F.col("_h") / 64))
    return rows.join(F.broadcast(filled), "_w").where(F.col("_bits").bitwiseAND(one) != 0).select(*docs.columns)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, shingles (bytes of the sorted set) of the documents whose ids are wanted, and of some more, made from their texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], names=["rep", "shingles"])

    return in_arrow(marked(docs, wanted).select("doc_id", "text"), each, StructType([StructField("rep", docs.schema["doc_id"].dataType), StructField("shingles", BinaryType())]))


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets have 100 * intersection >= percent * union."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in batches:
            ok = []
            for va, vb in zip(x.column("va"), x.column("vb"), strict=True):
                s, t = np.frombuffer(va.as_buffer(), np.uint64), np.frombuffer(vb.as_buffer(), np.uint64)
                both = 0
                if len(s) and len(t) and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    at = np.searchsorted(t, s)
                    both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(keep), x.column("b").filter(keep)], names=["a", "b"])

    pairs = pairs.select("a", "b")
    one, two = (sets_of(docs, pairs.select(F.col(x).alias("rep")), width).select(F.col("rep").alias(x), F.col("shingles").alias(f"v{x}")) for x in ("a", "b"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb")
    return in_arrow(rows, each, StructType([rows.schema["a"], rows.schema["b"]])).distinct()


def linked_across(one: list, two: list | None, percent: int) -> list[tuple]:
    """Links between different components: (rep, rep). one, two: (rep, component, set); two None: within one.

    For each set of one, its overlaps with all later sets come from one pass over their elements. A component
    of the other side is linked to a set once.
    """
    import numpy as np

    other = one if two is None else two
    flat = np.concatenate([s for *_, s in other])
    size = np.array([len(s) for *_, s in other])
    owner, start = np.repeat(np.arange(len(other)), size), np.concatenate([[0], np.cumsum(size)])
    component = np.array([c for _, c, _ in other])
    out = []
    for k, (rep, c, s) in enumerate(one):
        first = start[k + 1] if two is None else 0
        if first >= len(flat):
            continue
        at = np.minimum(np.searchsorted(s, flat[first:]), len(s) - 1)
        both = np.bincount(owner[first:][s[at] == flat[first:]], minlength=len(other))
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + size - both)) & (component != c))
        out += [(rep, other[h][0]) for h in hit[np.unique(component[hit], return_index=True)[1]]]
    return out


#: place: blocks of an area have consecutive ones; own: whether the row is of the block's first side.
BLOCK_ROW = ["place", "area", "kind", "i", "j", "own", "rep", "component"]


def _in_turn(rows: DataFrame) -> DataFrame:
    """Block rows dealt to partitions by their places in turn, so that the blocks of a large area spread evenly."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.pmod("place", F.lit(n)).cast("int")).sortWithinPartitions("area", "kind", "i", "j")


def dealt(rows: DataFrame, values: DataFrame, stash: Stash, tasks: int, few: int, many: int) -> DataFrame:
    """Blocks (BLOCK_ROW and the columns of values), sorted within partitions.

    rows: area, rep, component; values: rep, size and more. An area's strays (of other components than the
    area's) meet its own members (kind 0) and each other (kind 1). Strays are cut into chunks of about ``few``,
    members of about ``many``, counting longer texts as several; a block holds two chunks. An area's blocks are
    numbered and go round all partitions.
    """
    stray = F.col("component") != F.col("area")
    rows = rows.join(values, "rep")
    weight = F.lit(1) + F.floor(F.col("size") / 4_000)
    chunks = lambda which, most: F.greatest(F.lit(1), F.ceil(F.sum(F.when(which, weight).otherwise(0)) / most)).cast("int")
    counts = stash.put(rows.groupBy("area").agg(chunks(stray, few).alias("cs"), chunks(~stray, many).alias("cm")), tasks)
    chunk = F.when(stray, F.pmod(F.xxhash64("rep"), F.col("cs"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("cm"))).cast("int")
    placed = rows.join(counts, "area").withColumn("chunk", chunk)
    c, cm, cs = F.col("chunk"), F.col("cm"), F.col("cs")
    block = lambda kind, i, j, own: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(own).alias("own"))
    strays = F.concat(
        F.transform(F.sequence(F.lit(0), cm - 1), lambda j: block(0, c, j, True)),
        F.transform(F.sequence(c, cs - 1), lambda j: block(1, c, j, True)),
        F.transform(F.filter(F.sequence(F.lit(0), c), lambda i: i < c), lambda i: block(1, i, c, False)),
    )
    owners = F.transform(F.sequence(F.lit(0), cs - 1), lambda i: block(0, i, c, False))
    placed = placed.select("*", F.explode(F.when(stray, strays).otherwise(owners)).alias("at")).select("*", "at.*")
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    number = F.when(F.col("kind") == 0, i * cm + j).otherwise(cs.cast("long") * cm + F.floor(j * (j + 1) / 2) + i)
    placed = placed.withColumn("place", F.pmod(F.xxhash64("area"), F.lit(1 << 40)) + number)
    return _in_turn(placed.select(*BLOCK_ROW, *[x for x in values.columns if x != "rep"]))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((area, kind, i, j), rows) of sorted batches."""
    import numpy as np

    held, key = [], None
    for b in batches:
        names = [b.column(c).to_pylist() for c in ("area", "kind", "i", "j")]
        keys = list(zip(*names, strict=True))
        cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        for x, y in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if x == y:
                continue
            if held and keys[x] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[x]
            # A copy: a slice would hold its whole batch.
            held.append(b.take(pa.array(np.arange(x, y))))
    if held:
        yield key, pa.Table.from_batches(held)


def _worth(key: tuple, t: pa.Table, percent: int, least: float) -> tuple | None:
    """(own rows, other rows, agreement) of a block; agreement is -1 where a pair needs no test; None: no two sides."""
    import numpy as np

    own = t.column("own").to_numpy().astype(bool)
    same = key[1] == 1 and key[2] == key[3]
    x = np.flatnonzero(own)
    y = x if same else np.flatnonzero(~own)
    if not len(x) or not len(y):
        return None
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(own), -1)
    size, component = t.column("size").to_numpy(), t.column("component").to_numpy()
    agree = np.empty((len(x), len(y)), np.int16)
    for k, r in enumerate(x.tolist()):
        agree[k] = (sig[y] == sig[r]).sum(1)
    fits = (component[x][:, None] != component[y][None, :]) & (100 * np.minimum(size[x][:, None], size[y][None, :]) >= percent * np.maximum(size[x][:, None], size[y][None, :]))
    if same:
        fits &= np.arange(len(x))[:, None] < np.arange(len(x))[None, :]
    agree[~fits | (agree < least * sig.shape[1])] = -1
    return x, y, agree


def nearest(blocks: DataFrame, percent: int, least: float = LEAST_AGREEMENT) -> DataFrame:
    """a, b: for each stray the member of another component whose signature agrees most, where a test is worth it."""
    id_type = blocks.schema["rep"].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for key, t in each_block(batches):
            if (found := _worth(key, t, percent, least)) is None:
                continue
            x, y, agree = found
            rep = t.column("rep")
            a, b, n = [x], [y[agree.argmax(1)]], [agree.max(1)]
            if key[1] == 1:  # both sides are strays
                a.append(y), b.append(x[agree.argmax(0)]), n.append(agree.max(0))
            a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
            ok = n >= 0
            if ok.any():
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(a[ok])).combine_chunks(), rep.take(pa.array(b[ok])).combine_chunks(), pa.array(n[ok].astype(np.int64))], names=["x", "y", "agree"])

    found = in_arrow(blocks, each, StructType([StructField("x", id_type), StructField("y", id_type), StructField("agree", LongType())]))
    best = found.groupBy("x").agg(F.max("agree").alias("agree"))
    # Of equally near ones the least: a join and a minimum keep the aggregates on numbers.
    return found.join(best, ["x", "agree"]).groupBy("x").agg(F.min("y").alias("y")).select(*_ordered("x", "y")).distinct()


def worth_testing(blocks: DataFrame, percent: int, least: float = LEAST_AGREEMENT) -> DataFrame:
    """The block rows (without signatures) that have a partner worth a test in their block."""
    schema = StructType([blocks.schema[c] for c in BLOCK_ROW])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for key, t in each_block(batches):
            if (found := _worth(key, t, percent, least)) is None:
                continue
            x, y, agree = found
            rows = np.union1d(x[(agree >= 0).any(1)], y[(agree >= 0).any(0)])
            if len(rows):
                yield from t.select(schema.names).take(pa.array(rows)).combine_chunks().to_batches()

    return in_arrow(blocks, each, schema)


def linked_in_blocks(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between components found on the full sets of block rows, at most one of a row to a component."""
    id_type = rows.schema["rep"].dataType
    full = rows.join(sets_of(docs, rows.select("rep"), width), "rep")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for at, t in each_block(batches):
            own, other = [], []
            for mine, rep, component, raw in zip(*[t.column(c).to_pylist() for c in ("own", "rep", "component")], t.column("shingles"), strict=True):
                (own if mine else other).append((rep, component, np.frombuffer(raw.as_buffer(), np.uint64)))
            found = linked_across(own, None if at[1] == 1 and at[2] == at[3] else other, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], t.schema.field("rep").type), pa.array([y for _, y in found], t.schema.field("rep").type)], names=["a", "b"])

    return in_arrow(_in_turn(full), each, StructType([StructField("a", id_type), StructField("b", id_type)])).distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _numbered(docs: DataFrame, **options) -> DataFrame:
    """classes() for ids that are no integers: each id gets a number, and a class the least of its ids."""
    stash = Stash(docs.sparkSession)
    ids = stash.put(docs.select("doc_id").where("doc_id is not null").distinct().select("doc_id", F.monotonically_increasing_id().alias("n")))
    found = stash.put(classes(docs.join(ids, "doc_id", "left").select(F.col("n").alias("doc_id"), "text"), **options))
    named = found.join(ids.withColumnRenamed("n", "number"), found.doc_id == F.col("number"), "left").select(ids.doc_id, "n_shingles", F.col("component_id").alias("c"))
    least = stash.put(named.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id")))
    out = named.join(least, "c", "left").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def classes(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return _numbered(docs, width=width, percent=percent, bands=bands, rows=rows)
    stash, id_type = Stash(docs.sparkSession), docs.schema["doc_id"].dataType
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stash.put(signatures(docs, width, bands, rows))
    # Tables of ids are small next to texts: few tasks write them, more as the documents grow.
    few = max(12, signed.count() // 50_000)
    firsts = stash.put(signed.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), few)
    reps = signed.join(firsts, (signed.doc_id == firsts.rep) & (signed.d1 == firsts.d1) & (signed.d2 == firsts.d2), "left_semi")
    reps = stash.put(reps.dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "bands", "signature"))
    thin = stash.put(signed.select("doc_id", "n_shingles", "d1", "d2"))
    stash.drop(signed)

    entries = reps.select("rep", F.explode("bands").alias("key"))
    # The exclusive or with the key puts a bucket's members in an order of its own and can be undone.
    shared = stash.put(entries.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("x"), F.count("*").alias("n")).where("n > 1").select("key", F.col("x").bitwiseXOR(F.col("key")).alias("pivot")), few)
    members = stash.put(entries.join(shared, "key"), few)
    stash.drop(shared)
    # Most documents are like no other: only those that share a bucket are looked at from here on.
    signs = stash.put(reps.select("rep", "size", "signature").join(members.select("rep").distinct(), "rep", "left_semi"))
    stash.drop(reps)

    tested = stash.put(members.where("rep <> pivot").select(*_ordered("rep", "pivot")).distinct(), few)
    likely = stash.put(agreeing(tested, signs))
    # One good pair of each class first; most others are then inside a component. Of pairs that will hardly fail
    # the one with the least partner is best: such pairs make stars, which have their components in few steps.
    ends = likely.select(F.col("a").alias("n"), "a", "b", "agree").unionByName(likely.select(F.col("b").alias("n"), "a", "b", "agree"))
    sure = F.when(F.col("agree") >= 0.85 * bands * rows, 0).otherwise(-F.col("agree"))
    best = ends.groupBy("n").agg(F.min(F.struct(sure.alias("sure"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    best = stash.put(best, few)
    edges = stash.put(confirmed(best, docs, width, percent))
    found = stash.put(components(edges, stash), few)

    def across(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different components."""
        one = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        two = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)

    def grown(more: DataFrame) -> DataFrame:
        """The components with further links."""
        more = stash.put(more)
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        out = found if more.isEmpty() else stash.put(components(old.unionByName(more), stash), few)
        stash.drop(more)
        return out

    def mixed() -> DataFrame:
        """area, rep, component of the buckets that hold several components; the area is the largest of them."""
        placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        parted = counts.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", F.struct("n", "component")).alias("area")).where("lo <> hi").select("key", "area")
        return stash.put(placed.join(parted, "key").select("area", "rep", "component").distinct(), few)

    rest = stash.put(across(likely.join(best, ["a", "b"], "left_anti").select("a", "b")), few)
    if not rest.isEmpty():
        found = grown(confirmed(rest, docs, width, percent))
    stash.drop(likely, tested, best, edges, rest)

    areas = mixed()
    if not areas.isEmpty():
        near = stash.put(nearest(dealt(areas, signs, stash, few, STRAYS, MEMBERS), percent), few)
        found = grown(confirmed(near, docs, width, percent))
        stash.drop(areas, near)
        areas = mixed()
    if not areas.isEmpty():
        needed = stash.put(worth_testing(dealt(areas, signs, stash, few, STRAYS, MEMBERS), percent), few)
        if not needed.isEmpty():
            found = grown(linked_in_blocks(needed, docs, width, percent))
        stash.drop(needed)

    by_digest = stash.put(firsts.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component")), few)
    stash.drop(members, signs, areas)
    out = thin.join(by_digest, ["d1", "d2"], "left").select(F.col("doc_id").cast(id_type), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).cast(id_type).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one with the least doc_id; columns as they are.

    Rows that repeat a kept doc_id all stay: they are one document to the id's owner.
    """
    gone = Stash(docs.sparkSession).put(classes(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=2)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, d.y FROM r JOIN d ON d.x = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
