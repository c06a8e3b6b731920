"""Embedding near-dedup: cover trees with halving radii, traversed in pairs, give exact cosine-threshold links.

On unit vectors, cosine >= c is Euclidean distance <= sqrt(2 - 2c). The top of the tree is a farthest-point net of a
bounded sample (its prefixes are nested nets of shrinking radii); every vector goes to its nearest net point, and node
pairs farther apart than their covering radii allow are pruned. What is left is traversed in blocks of bounded size, each
with trees of its own. In data without clusters no bound prunes and all node pairs of a label are traversed: exact, and
quadratic in the label, as for any exact method there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.llm.common import connected_components, cut, join_spread, named

BLOCK = 2048
LEAF = 32
SAMPLE = 16384
PER_CENTER = 2048  # a label's net has a point for so many vectors, as far as its part of the sample goes
CHUNK = 512
SLACK = 1e-6  # bounds are relaxed by more than rounding can be; links are decided on the cosine alone


class Node:
    __slots__ = ("center", "radius", "children", "points")

    def __init__(self, center: int, radius: float, children: list["Node"] | None, points: np.ndarray):
        self.center, self.radius, self.children, self.points = center, radius, children, points


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def build(x: np.ndarray, points: np.ndarray, scale: float = 2.0) -> Node:
    """A tree over points of unit vectors x; children of a node cover its points within half its scale."""
    center = int(points[0])
    d = distances(x[points], x[center : center + 1])[:, 0]
    radius = float(d.max())
    if len(points) <= LEAF or radius < 1e-7:
        return Node(center, radius, None, points)
    while scale / 2 >= radius:  # levels that would hold this node alone
        scale /= 2
    children, rest = [], points
    near = d
    while len(rest):
        c = int(rest[0])
        if c != center:
            near = distances(x[rest], x[c : c + 1])[:, 0]
        inside = near <= scale / 2
        inside[0] = True
        own = rest[inside]
        children.append(build(x, own, scale / 2) if len(own) > 1 else Node(c, 0.0, None, own))
        rest = rest[~inside]
    return Node(center, radius, children, points)


def _parts(node: Node) -> list[Node]:
    if node.children is not None:
        return node.children
    return [node] if len(node.points) == 1 else [Node(int(p), 0.0, None, np.array([p])) for p in node.points]


def _stars(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest position reachable) of the bipartite graph in mask; positions are into rows then cols."""
    n = len(rows)
    left, right = np.arange(n), n + np.arange(len(cols))
    while True:
        down = np.where(mask, left[:, None], n + len(cols)).min(0)
        new_right = np.minimum(right, down)
        across = np.where(mask, new_right[None, :], n + len(cols)).min(1)
        new_left = np.minimum(left, across)
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    at = np.concatenate([rows, cols])
    return [(int(at[i]), int(at[r])) for i, r in enumerate(np.concatenate([left, right])) if at[i] != at[r]]


def dual(
    xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray, cosine: float, same: bool
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked to each row of xa and of xb, and edges that connect what is linked (rows of b count from len(xa)).

    same: b is a, and a row is not linked with itself; links are then counted for a alone.
    """
    eps = float(np.sqrt(2.0 - 2.0 * cosine))
    ca, cb, edges = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64), []
    shift = 0 if same else len(xa)
    ta = build(xa, np.arange(len(xa)))
    stack = [(ta, ta if same else build(xb, np.arange(len(xb))))]
    while stack:
        a, b = stack.pop()
        pa_, pb = _parts(a), _parts(b)
        ia, ib = np.array([p.center for p in pa_]), np.array([p.center for p in pb])
        ra, rb = np.array([p.radius for p in pa_]), np.array([p.radius for p in pb])
        one_a, one_b = np.array([len(p.points) == 1 for p in pa_]), np.array([len(p.points) == 1 for p in pb])
        cos = xa[ia] @ xb[ib].T
        d, bound = np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0)), ra[:, None] + rb[None, :]
        singles = one_a[:, None] & one_b[None, :]
        link = singles & (cos >= cosine)
        for i, j in zip(*np.nonzero(singles & (np.abs(cos - cosine) < 1e-12))):  # too close for the product's rounding
            link[i, j] = np.dot(xa[ia[i]].astype(np.longdouble), xb[ib[j]].astype(np.longdouble)) >= cosine
        if same:
            link &= ia[:, None] != ib[None, :]
        if link.any():
            rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            m = link[np.ix_(rows, cols)]
            np.add.at(ca, ia[rows], m @ wb[ib[cols]])
            if not same:
                np.add.at(cb, ib[cols], wa[ia[rows]] @ m)
            edges += _stars(m, ia[rows], ib[cols] + shift)
        for i, j in zip(*np.nonzero(~singles & (d - bound <= eps + SLACK))):
            p, q = pa_[i], pb[j]
            if d[i, j] + bound[i, j] <= eps - SLACK:  # all of p is linked with all of q
                own = same and p is q
                total = wb[q.points].sum()
                ca[p.points] += total - (wb[p.points] if own else 0)
                if not same:
                    cb[q.points] += wa[p.points].sum()
                edges += [(int(x), int(p.center)) for x in p.points if x != p.center]
                edges += [(int(x) + shift, int(p.center)) for x in q.points if not (own and x == p.center)]
            else:
                stack.append((p, q))
    return ca, cb, edges


def _net(x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-point order: each prefix is a net whose covering radius shrinks as it grows."""
    picked, d = [0], distances(x, x[:1])[:, 0]
    while len(picked) < k and d.max() > 0:
        picked.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def _unit(rows: list) -> np.ndarray:
    """Vectors of length one. Each is divided by its largest magnitude first, so that no square overflows or vanishes."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _traverse(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = (key[2], key[3]) == (key[4], key[5])
        first = ((rows["cell"] == key[2]) & (rows["block"] == key[3])).to_numpy()
        a = rows[first].sort_values("rep")
        b = a if own else rows[~first].sort_values("rep")
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "other": []}).astype("int64")
        xa, wa, ids = _unit(a["vec"].tolist()), a["weight"].to_numpy(), a["rep"].to_numpy()
        xb, wb = (xa, wa) if own else (_unit(b["vec"].tolist()), b["weight"].to_numpy())
        if not own:
            ids = np.concatenate([ids, b["rep"].to_numpy()])
        ca, cb, edges = dual(xa, wa, xb, wb, cosine, own)
        n = ca if own else np.concatenate([ca, cb])
        e = np.unique(np.array(edges, np.int64).reshape(-1, 2), axis=0)
        at = np.flatnonzero(n)
        return pd.DataFrame(
            {
                "rep": np.concatenate([ids[at], ids[e[:, 0]]]),
                "links": np.concatenate([n[at], np.zeros(len(e), np.int64)]),
                "other": np.concatenate([ids[at], ids[e[:, 1]]]),
            }
        )

    return run


def _cell_pairs(nodes: DataFrame, nets: dict, label_type: str, eps: float) -> DataFrame:
    """(label, dim, i, j, bi, bj): pairs of cells i <= j that their covering radii do not keep farther apart than eps.

    A label without a net has one cell. Net points, and so the cells of labels with a net, are at most SAMPLE; these are
    held by every task, and each cell finds its partners there.
    """
    spark, out = nodes.sparkSession, "label {}, dim int, i int, j int, bi int, bj int".format(label_type)
    alone = nodes
    if nets:
        netted = F.broadcast(spark.createDataFrame(list(nets), f"label {label_type}, dim int"))
        alone, mine = nodes.join(netted, ["label", "dim"], "left_anti"), nodes.join(netted, ["label", "dim"])
        known: dict = {}
        for r in mine.collect():  # at most SAMPLE rows
            radius, blocks = known.setdefault(
                (r["label"], r["dim"]),
                (
                    np.full(len(nets[r["label"], r["dim"]]), -np.inf),
                    np.zeros(len(nets[r["label"], r["dim"]]), np.int32),
                ),
            )
            radius[r["cell"]], blocks[r["cell"]] = r["radius"], r["blocks"]
        shared = spark.sparkContext.broadcast((nets, known))

        def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nets, known = shared.value
            for batch in batches:
                for label, dim, i in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cell"))):
                    net, (radius, blocks) = nets[label, dim], known[label, dim]
                    gap = distances(net[i : i + 1], net)[0] - radius[i] - radius
                    j = np.flatnonzero(
                        (blocks > 0) & (gap <= eps + SLACK) & (np.arange(len(net)) >= i)
                    ).astype(np.int32)
                    same = [
                        pa.array([v] * len(j), t)
                        for v, t in ((label, batch.column("label").type), (dim, pa.int32()), (i, pa.int32()))
                    ]
                    bi = pa.array(np.full(len(j), blocks[i], np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*same, pa.array(j), bi, pa.array(blocks[j])], ["label", "dim", "i", "j", "bi", "bj"]
                    )

        found = mine.select("label", "dim", "cell").mapInArrow(partners, out)
    own = alone.select(
        "label",
        "dim",
        F.col("cell").alias("i"),
        F.col("cell").alias("j"),
        F.col("blocks").alias("bi"),
        F.col("blocks").alias("bj"),
    )
    return found.unionByName(own) if nets else own


def near_vectors(
    vectors: DataFrame,
    *,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    Ids are integers (others are cast). Only rows of one non-null label and one length are compared. Vectors that are null,
    empty, zero or hold null or non-finite numbers link with nothing, as do rows with a null id. Equal vectors of a label
    are one class, so a group of copies of any size costs as much as one vector; rows that share an id are further rows of
    that id. Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), named(vec_col).alias("vec")
    )
    fine = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("vec", lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    good = rows.where(ok)
    classes = cut(
        good.groupBy("label", "vec").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")
        ).withColumn("dim", F.size("vec"))
    )

    # the top of the trees: nets of a bounded sample, for labels with more than one block
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sample = classes.join(
        counts.where(F.col("n") > BLOCK), ["label", "dim"]
    ).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("label", "dim", "n", "vec").toPandas()
    nets = {
        (label.item() if hasattr(label, "item") else label, int(dim)): _net(
            _unit(g["vec"].tolist()), int(-(-g["n"].iloc[0] // PER_CENTER))
        )
        for (label, dim), g in sample.groupby(["label", "dim"])
    } if len(sample) else {}
    shared = spark.sparkContext.broadcast(nets)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            cell, far = np.zeros(len(keys), np.int32), np.full(len(keys), 2.0)
            vecs = batch.column("vec")
            by: dict = {}
            for i, k in enumerate(keys):
                by.setdefault(k, []).append(i)
            for k, at in by.items():
                for start in range(0, len(at) if k in shared.value else 0, CHUNK):
                    part = at[start : start + CHUNK]  # distances to the net take CHUNK * SAMPLE numbers at most
                    d = distances(_unit(vecs.take(pa.array(part)).to_pylist()), shared.value[k])
                    cell[part], far[part] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"]
            )

    label_type, vec_type = classes.schema["label"].dataType.simpleString(), classes.schema["vec"].dataType.simpleString()
    placed = cut(
        classes.select("label", "vec", "rep", "weight", "dim").mapInArrow(
            assign, f"label {label_type}, vec {vec_type}, rep long, weight long, dim int, cell int, far double"
        )
    )
    cells = [F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")]
    nodes = cut(placed.groupBy("label", "dim", "cell").agg(*cells))
    pairs = _cell_pairs(nodes, nets, label_type, float(np.sqrt(2.0 - 2.0 * cosine)))
    pairs = pairs.select(
        "label", "dim", "i", "j", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("p"), "bj"
    ).select(
        "label", "dim", "i", "j", "p", F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("q")
    ).where("i < j OR p <= q")
    pairs = cut(pairs)
    sides = pairs.select("label", "dim", F.col("i").alias("cell"), F.col("p").alias("block"), "i", "p", "j", "q")
    sides = sides.unionByName(
        pairs.where("i <> j OR p <> q").select(
            "label", "dim", F.col("j").alias("cell"), F.col("q").alias("block"), "i", "p", "j", "q"
        )
    )
    blocked = placed.join(
        nodes.select("label", "dim", "cell", "blocks"), ["label", "dim", "cell"]
    ).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = blocked.select(
        "label", "dim", "cell", "block", "rep", "weight", "vec"
    ).join(sides, ["label", "dim", "cell", "block"])
    found = cut(
        dealt.groupBy("label", "dim", "i", "p", "j", "q").applyInPandas(
            _traverse(cosine), "rep long, links long, other long"
        )
    )
    comps = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))

    out = classes.select("label", "vec", "rep", "weight").join(links, "rep", "left").join(
        comps.withColumnRenamed("node", "rep"), "rep", "left"
    )
    n_links = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
    out = cut(
        out.select(
            "label", "vec", "weight", n_links.alias("n_links"), F.coalesce("component", "rep").alias("component_id")
        )
    )
    done = join_spread(good, out, ["label", "vec"], "weight").select("vec_id", "n_links", "component_id")
    rest = rows.where(~ok).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return done.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
