"""Embedding near-duplicates by cover trees and dual traversal: exact pairs above a cosine.

Unit vectors have cosine c or more exactly if their distance is at most sqrt(2 - 2c). A cover tree nests nets of
halving radii; two nodes whose centres lie farther apart than both covering radii and that distance hold no
pair; what is left at the bottom is decided by the cosine itself.

Equal vectors of a label are one point with a weight. Points of a label go to the nearest of at most ``pivots``
centres, fitted on a bounded sample (exactness does not depend on them); a cell is cut into blocks of about
``block`` points. Pairs of cells are pruned by their covering radii, pairs of blocks that remain are traversed
together in one task with bounded memory. A task returns sums and a forest of links for its points, never all
pairs, so a dense group costs rows in proportion to its points.

Where data have no structure (all distances alike), no bound of any tree can tell pairs apart before the centres
are the points themselves: then all pairs of a block are looked at once, as nodes of radius 0, and pruned there.
The work within a label grows with the square of its points then, as for any exact join; blocks keep its memory
and its rows bounded.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing,
nor does one without a label; vectors of other lengths are compared among their own; repeated rows are further
vectors at cosine 1; rows of one vec_id are one node of the graph; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import Stash, in_arrow
from .components import components

PIVOTS, BLOCK = 64, 2_048
#: Below this radius the next level is the points; vectors of cosine 0.98 lie 0.2 apart.
LEAST_RADIUS = 0.05
#: Distances are sums of rounded products; bounds give way by this much, and the cosine itself decides.
SLACK = 1e-7


def _matrix(flat, n: int):
    """Rows of unit length in double precision."""
    import numpy as np

    x = np.asarray(flat, np.float64).reshape(n, -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distance(dots):
    import numpy as np

    return np.sqrt(np.maximum(2 - 2 * dots, 0))


class Tree:
    """Nested nets of points with halving radii, from one root to the points themselves.

    Points are in farthest-first order, any first part of which is a net, so the centres of a level are the first
    ``sizes[k]`` points and a centre stays under itself. radius[k]: distance to the farthest point below each
    centre; children[k]: (order, start) so that order[start[c]:start[c + 1]] are the centres of level k + 1 under c.
    """

    def __init__(self, x, sizes: list[int], near, radius):
        import numpy as np

        self.x, self.sizes, self.radius, self.children = x, sizes, [], []
        a = b = 0
        for upper, lower in zip(sizes, sizes[1:], strict=False):
            parent = near[a : a + lower]
            by = np.argsort(parent, kind="stable")
            self.children.append((by, np.searchsorted(parent[by], np.arange(upper + 1))))
            self.radius.append(radius[b : b + upper])
            a, b = a + lower, b + upper
        self.radius.append(np.zeros(sizes[-1]))


def nets(x, least: float = LEAST_RADIUS) -> tuple:
    """(order of the points, sizes, near, radius) for a Tree of x[order]: parents and radii level by level.

    The root's radius is that of the points; every level below has half the radius of the one above, down to
    ``least``, which is well under the distance of links; the last level is the points.
    """
    import numpy as np

    n = len(x)
    order, sizes = [0], [1]
    nearest = _distance(x @ x[0])
    nearest[0] = 0
    r = float(nearest.max())
    while r > least:
        r /= 2
        while nearest.max() > r:
            far = int(nearest.argmax())
            order.append(far)
            nearest = np.minimum(nearest, _distance(x @ x[far]))
            nearest[far] = 0
        sizes.append(len(order))
    rest = np.setdiff1d(np.arange(n), order)
    order = np.concatenate([np.array(order), rest]).astype(np.int64)
    if len(rest) or n == 1:
        sizes.append(n)
    x = x[order]
    parents = []
    for upper, lower in zip(sizes, sizes[1:], strict=False):
        new = x[upper:lower]
        found = [(new[i : i + 512] @ x[:upper].T).argmax(1) for i in range(0, len(new), 512)]
        parents.append(np.concatenate([np.arange(upper), *found]))
    node, radii = np.arange(n), []
    for upper, parent in zip(sizes[-2::-1], parents[::-1], strict=True):
        node = parent[node]
        radius = np.zeros(upper)
        np.maximum.at(radius, node, _distance((x * x[node]).sum(1)))
        radii.insert(0, radius)
    return order, sizes, np.concatenate(parents), np.concatenate(radii)


def tree_of(x) -> tuple:
    """(order, Tree) of points."""
    order, *parts = nets(x)
    return order, Tree(x[order], *parts)


def traverse(a: Tree, b: Tree, cosine: float, part: int = 200_000, dense: int = 4_096, work: Counter | None = None) -> Iterator[tuple]:
    """(points of a, points of b) of linked pairs, in parts; where b is a, each pair comes once and no point with itself.

    Node pairs go down level by level, a whole frontier at a time. The children of a pair with ``dense`` or more
    combinations are compared by a matrix product, others by single products. work: gets the number of pairs
    looked at ("nodes" above the last level, "points" there) and of those dropped by the bounds ("pruned").
    """
    import numpy as np

    same, most = a is b, float(np.sqrt(2 - 2 * cosine)) + SLACK
    last = max(len(a.children), len(b.children))

    def spans(t: Tree, k: int, nodes) -> tuple:
        """Where the nodes' children begin, and how many each has."""
        if k >= len(t.children):
            return nodes, np.ones(len(nodes), np.int64)
        start = t.children[k][1]
        return start[nodes], start[nodes + 1] - start[nodes]

    def at(t: Tree, k: int, places):
        return places if k >= len(t.children) else t.children[k][0][places]

    def fits(k: int, p, q, dot):
        """Which of the pairs of level k stay."""
        if k >= last:
            keep = dot >= cosine
        else:
            keep = _distance(dot) <= a.radius[min(k, len(a.children))][p] + b.radius[min(k, len(b.children))][q] + most
        if work is not None:
            work["points" if k >= last else "nodes"] += keep.size
            work["pruned"] += 0 if k >= last else int(keep.size - keep.sum())
        return keep

    def products(p, q):
        return np.concatenate([np.einsum("ij,ij->i", a.x[p[i : i + 20_000]], b.x[q[i : i + 20_000]]) for i in range(0, len(p), 20_000)])

    def visit(k: int, p, q) -> Iterator[tuple]:
        """p, q: pairs of level k that stay."""
        if k >= last:
            if same:
                p, q = p[p != q], q[p != q]
            if len(p):
                yield p, q
            return
        (pa_, na), (qb, nb) = spans(a, k, p), spans(b, k, q)
        many = na * nb >= dense
        for c in np.flatnonzero(many).tolist():
            step = max(1, min(256, 1_000_000 // int(nb[c])))
            for i in range(0, int(na[c]), step):
                # Within one node, pairs of later children with earlier ones came before.
                y = at(b, k, np.arange(qb[c] + (i if same and p[c] == q[c] else 0), qb[c] + nb[c]))
                x = at(a, k, np.arange(pa_[c] + i, pa_[c] + min(i + step, na[c])))
                keep = fits(k + 1, x[:, None], y[None, :], a.x[x] @ b.x[y].T)
                if same and p[c] == q[c]:  # pairs within one node come in both orders; one is enough
                    keep &= x[:, None] <= y[None, :]
                u, v = np.nonzero(keep)
                if len(u):
                    yield from visit(k + 1, x[u], y[v])
        p, q, pa_, na, qb, nb = (z[~many] for z in (p, q, pa_, na, qb, nb))
        cut = np.flatnonzero(np.diff(np.cumsum(na * nb) // part)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
            if i == j:
                continue
            n, m = (na[i:j] * nb[i:j]), nb[i:j]
            k_th = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(m, n)
            x, y = at(a, k, np.repeat(pa_[i:j], n) + k_th // wide), at(b, k, np.repeat(qb[i:j], n) + k_th % wide)
            if same:
                ok = ~(np.repeat(p[i:j] == q[i:j], n) & (x > y))
                x, y = x[ok], y[ok]
            keep = fits(k + 1, x, y, products(x, y))
            if keep.any():
                yield from visit(k + 1, x[keep], y[keep])

    root = np.zeros(1, np.int64)
    yield from visit(0, root, root)


def linked(a: Tree, b: Tree | None, wa, wb, cosine: float) -> tuple:
    """Weights of the points each is linked to and the least position it is connected to, over a's points, then
    b's; b None: within a."""
    import numpy as np

    shift = 0 if b is None else len(a.x)
    total = len(a.x) + (0 if b is None else len(b.x))
    weight = wa if b is None else np.concatenate([wa, wb])
    links, root = np.zeros(total, np.int64), np.arange(total)
    for p, q in traverse(a, a if b is None else b, cosine):
        q = q + shift
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        while True:
            x, y = root[p], root[q]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
    return links, root


def centres_of(points: DataFrame, total: int, pivots: int, sample: int = 2_048) -> list:
    """At most ``pivots`` centres for each length of vector, farthest-first on a bounded sample."""
    import numpy as np

    # A share of the points by hash: about twice ``sample`` in all and four times at most.
    share = min(1.0, 2.0 * sample / max(1, total))
    drawn = points.where(F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "dim", "v").limit(4 * sample).collect()
    drawn.sort(key=lambda r: str(r["rep"]))
    out = []
    for dim in sorted({r["dim"] for r in drawn}):
        x = np.concatenate([_matrix(r["v"], 1) for r in drawn if r["dim"] == dim])
        chosen = [0]
        nearest = _distance(x @ x[0])
        while len(chosen) < pivots and nearest.max() > 1e-6:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distance(x @ x[chosen[-1]]))
        out.append((dim, x[chosen]))
    return out


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    import numpy as np

    stash = Stash(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.col("label"), F.when(usable, F.col("v")).alias("v"))
    big = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    rows = rows.select("vec_id", "label", F.transform(F.array(big), lambda m: F.transform("v", lambda x: x / m + F.lit(0.0)))[0].alias("v"))
    rows = stash.put(rows.select("vec_id", "label", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("digest"), "v"))
    same = stash.put(rows.where("v is not null and vec_id is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    reps = rows.join(same.withColumnRenamed("rep", "vec_id"), ["vec_id", "label", "digest"]).dropDuplicates(["vec_id", "label", "digest"])
    points = stash.put(reps.select(F.col("vec_id").alias("rep"), "label", "n", F.size("v").alias("dim"), "v"))

    total = points.count()
    kinds = max(1, points.select("label", "dim").distinct().count())
    centres = centres_of(points, total, max(1, min(pivots, -(-total // (kinds * block)))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = dict(centres)
        for b in batches:
            cell, far = [], []
            for v in b.column("v").to_pylist():
                # A length that the sample missed has one cell, as wide as can be.
                dots = by[len(v)] @ _matrix(v, 1)[0] if len(v) in by else np.array([-1.0])
                k = int(dots.argmax())
                cell.append(k), far.append(float(_distance(dots[k])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[*b.schema.names, "cell", "far"])

    points_in = stash.put(in_arrow(points, placed, StructType([*points.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType())])))
    cells = stash.put(points_in.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"), F.max("far").alias("radius")).withColumn("chunks", F.ceil(F.col("m") / block).cast("int")))

    # Distances of centres: at most pivots squared rows for a length of vector.
    apart = [(int(d), int(i), int(j), float(_distance(c[i] @ c[j]))) for d, c in centres for i in range(len(c)) for j in range(i, len(c))]
    apart = vectors.sparkSession.createDataFrame(apart or [(-1, 0, 0, 0.0)], "dim int, cell int, cell2 int, apart double")
    two = cells.select("label", "dim", F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"), F.col("radius").alias("radius2"))
    near = cells.join(apart, ["dim", "cell"], "left").select("label", "dim", "cell", F.coalesce("cell2", "cell").alias("cell2"), F.coalesce("apart", F.lit(0.0)).alias("apart"), "chunks", "radius")
    near = near.join(two, ["label", "dim", "cell2"]).where(F.col("apart") <= F.col("radius") + F.col("radius2") + float(np.sqrt(2 - 2 * cosine)) + SLACK)
    pairs = near.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("*", F.explode(F.sequence(F.when(F.col("cell") == F.col("cell2"), F.col("chunk")).otherwise(0), F.col("chunks2") - 1)).alias("chunk2"))
    pairs = pairs.select("label", "dim", "cell", "chunk", "cell2", "chunk2")

    chunked = points_in.join(cells.select("label", "dim", "cell", "chunks"), ["label", "dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    # A block holds about ``block`` points: a bounded list. Its tree is built here, once for all pairs it is in.
    lists = chunked.groupBy("label", "dim", "cell", "chunk").agg(F.collect_list(F.struct("rep", "n", "v")).alias("p")).select("label", "dim", "cell", "chunk", F.col("p.rep").alias("ids"), F.col("p.n").alias("ns"), F.flatten("p.v").alias("vs"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids, ns, vs = (row.column(c)[0].values for c in ("ids", "ns", "vs"))
                x = _matrix(vs.to_numpy(zero_copy_only=False), len(ids))
                order, *parts = nets(x)
                own = [ids.take(pa.array(order)), ns.take(pa.array(order)), x[order].ravel(), *parts]
                fields = [row.schema.field(c).type for c in ("ids", "ns", "vs")] + [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("label", "dim", "cell", "chunk")], *[pa.array([v], t) for v, t in zip(own, fields, strict=True)]], names=[*row.schema.names, "sizes", "near", "radius"])

    schema = StructType([*lists.schema.fields, StructField("sizes", ArrayType(IntegerType())), StructField("near", ArrayType(IntegerType())), StructField("radius", ArrayType(DoubleType()))])
    blocks = stash.put(in_arrow(lists, grow, schema))
    what = ("ids", "ns", "vs", "sizes", "near", "radius")
    left = pairs.join(blocks, ["label", "dim", "cell", "chunk"])
    right = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), *[F.col(c).alias(f"{c}2") for c in what])
    both = left.join(right, ["label", "dim", "cell2", "chunk2"]).select(((F.col("cell") == F.col("cell2")) & (F.col("chunk") == F.col("chunk2"))).alias("same"), *what, *[f"{c}2" for c in what])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, i=i, b=b: b.column(c)[i].values.to_numpy(zero_copy_only=False)
                tree = lambda end="", get=get: Tree(get(f"vs{end}").reshape(len(get(f"ids{end}")), -1), get(f"sizes{end}").tolist(), get(f"near{end}"), get(f"radius{end}"))
                ids = get("ids")
                if b.column("same")[i].as_py():
                    links, root = linked(tree(), None, get("ns"), None, cosine)
                else:
                    links, root = linked(tree(), tree("2"), get("ns"), get("ns2"), cosine)
                    ids = np.concatenate([ids, get("ids2")])
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["rep", "links", "root"])

    id_type = points.schema["rep"].dataType
    found = stash.put(in_arrow(both, compare, StructType([StructField("rep", id_type), StructField("links", LongType()), StructField("root", id_type)])))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), stash).select(F.col("node").alias("rep"), "component")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = stash.put(same.join(sums, "rep", "left").join(joined, "rep", "left").select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    stash.drop(points, points_in, cells, blocks, found)
    keyed = rows.select("vec_id", F.when(F.col("v").isNotNull() & F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "digest")
    out = keyed.join(result, ["label", "digest"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.y FROM r JOIN p ON p.x = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
"""
