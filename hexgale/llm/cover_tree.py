"""Near-duplicate vectors by dual traversal of a cover tree.

Levels have halving radii. A cell of a level that holds more than ``LEAF`` vectors is split: centres that lie further apart
than the next radius are taken from a bounded sample of the cell, every vector goes to its nearest centre, and the child's
covering radius is measured over all its vectors, so bounds are exact however the centres were drawn. After each split the
pairs of cells are refined to pairs of children and pruned where the distance of the centres exceeds both covering radii
plus the threshold. Pairs of leaves go on inside a task over the leaf's own levels, down to exact cosines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexgale.llm.common import components, partitions, pick
from hexgale.session import cut_lineage

#: Vectors of a leaf, sampled vectors of a cell that centres are taken from, most centres of a cell.
LEAF, SAMPLE, CENTRES = 1024, 512, 64
#: Vectors of one cell assigned in one task group.
SALT_ROWS = 4000
#: Slack of bounds against rounding.
EPS = 1e-9


def _unpack(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chord lengths between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(x: np.ndarray, radius: float, most: int, first: list[int] | None = None) -> list[int]:
    """Greedy net: rows further than ``radius`` from all rows taken before, in order, at most ``most``."""
    taken = list(first or [])
    least = _distances(x, x[taken]).min(axis=1) if taken else np.full(len(x), np.inf)
    while len(taken) < most:
        far = np.flatnonzero(least > radius)
        if not len(far):
            break
        taken.append(int(far[0]))
        least = np.minimum(least, _distances(x, x[far[:1]])[:, 0])
    return taken


class LocalTree:
    """Nested levels of one leaf: centres of a level stay centres below; radii halve, coverings are measured."""

    def __init__(self, x: np.ndarray, radii: list[float]):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        centres: list[int] = []
        up = np.zeros(len(x), dtype=np.int64)
        for r in radii:
            centres = net(x, r, len(x), centres)
            d = _distances(x, x[centres])
            if self.levels:
                # A vector stays below its parent: only children of its parent's node are open to it.
                d = np.where(up[centres][None, :] == up[:, None], d, np.inf)
            own = d.argmin(axis=1)
            cover = np.zeros(len(centres))
            np.maximum.at(cover, own, d[np.arange(len(x)), own])
            self.levels.append((np.array(centres), own, cover))
            up = own


def dual(a: LocalTree, b: LocalTree, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that may have a partner, after pruning node pairs level by level."""
    alive = None
    for (ca, oa, ra), (cb, ob, rb) in zip(a.levels, b.levels):
        near = _distances(a.x[ca], b.x[cb]) <= ra[:, None] + rb[None, :] + tau + EPS
        if alive is not None:
            near &= alive[np.ix_(pa_[ca], pb_[cb])]
        alive, pa_, pb_ = near, oa, ob
    if alive is None:
        return np.arange(len(a.x)), np.arange(len(b.x))
    return np.flatnonzero(alive.any(axis=1)[pa_]), np.flatnonzero(alive.any(axis=0)[pb_])


def _roots(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of the connected component of each row and column of a link matrix."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        nb = np.minimum(b, np.where(link, a[:, None], top).min(axis=0, initial=top))
        na = np.minimum(a, np.where(link, nb[None, :], top).min(axis=1, initial=top))
        if np.array_equal(na, a) and np.array_equal(nb, b):
            return a, b
        a, b = na, nb


def _assign(points: DataFrame, packs: DataFrame, n_parts: int) -> DataFrame:
    """Each vector of a split cell with its nearest centre: the cell's centres come first in each salted group."""
    salted = points.select("cell", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "class_id", "vec")
    heads = packs.select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("class_id"), F.col("centres").alias("vec"))
    dealt = salted.unionByName(heads).repartition(n_parts, "cell", "salt").sortWithinPartitions("cell", "salt", "kind")

    def run(batches):
        centres = None
        for b in batches:
            cells, kinds, ids, vecs = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            at = 0
            while at < len(cells):
                if kinds[at] == 0:
                    c = np.frombuffer(vecs[at], "<f8")
                    dim = int(c[0])
                    centres = c[1:].reshape(-1, dim)
                    at += 1
                    continue
                end = at
                while end < len(cells) and kinds[end] == 1:
                    end += 1
                d = _distances(_unpack(vecs[at:end]), centres)
                best = d.argmin(axis=1)
                out.append((np.array(ids[at:end]), np.array(cells[at:end]), best, d[np.arange(end - at), best]))
                at = end
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["class_id", "parent", "child", "dist"])

    return dealt.mapInArrow(run, "class_id long, parent long, child long, dist double")


def _refine(pairs: DataFrame, children: DataFrame, tau: float) -> DataFrame:
    """Pairs of children of paired cells that the covering radii cannot rule out."""
    ca = children.select(F.col("parent").alias("a"), F.col("cell").alias("na"), F.col("centre").alias("va"), F.col("radius").alias("ra"))
    cb = children.select(F.col("parent").alias("b"), F.col("cell").alias("nb"), F.col("centre").alias("vb"), F.col("radius").alias("rb"))
    both = pairs.join(ca, "a").join(cb, "b").where((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb")))

    def run(batches):
        for x in batches:
            va, vb = x.column(2).to_pylist(), x.column(3).to_pylist()
            ra, rb = x.column(4).to_numpy(), x.column(5).to_numpy()
            d = np.array([math.sqrt(max(0.0, 2 - 2 * float(np.frombuffer(p, "<f8") @ np.frombuffer(q, "<f8")))) for p, q in zip(va, vb)])
            keep = pa.array(d <= ra + rb + tau + EPS, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], names=["a", "b"])

    return both.select("na", "nb", "va", "vb", "ra", "rb").mapInArrow(run, "a long, b long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs with equal labels and cosine >= ``cosine`` in doubles.

    Vectors that are NULL, empty, zero, of another dimension, or hold NULL or non-finite components, and rows without a
    label, link with nothing. Equal vectors of a label are one class with a count: they link with each other and share
    all other links, and are never expanded into pairs. Rows with a NULL id count as vectors (others see them among their
    links) but have no component of their own id: component_id is the class component, or NULL. Repeated ids are separate
    rows. Empty input gives an empty result; other columns are left out.

    What reaches the driver is row counts. A hot label is split like any other cell; a hot cell of near copies that no
    centre can split goes into leaves by hash. Output of a pair of leaves is at most one row per linked vector.
    """
    rows = pick(vectors, vec_id=vec_id, embedding=embedding, label=label)
    spark = rows.sparkSession
    n_parts = partitions(spark)
    tau = math.sqrt(2 - 2 * cosine)
    e = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0), F.lit(False))
    # -0.0 equals 0.0 and is made so, as classes are equal arrays.
    plain = F.transform(e, lambda v: v + F.lit(0.0))
    marked = rows.select("vec_id", "label", F.when(fine, plain).alias("e"))
    classes = marked.where("e is not null").groupBy("label", "e").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first_id"))
    classes = cut_lineage(classes.withColumn("class_id", F.monotonically_increasing_id()).withColumn("root_cell", F.xxhash64("label", F.size("e"))))

    def unit(batches):
        for b in batches:
            out = []
            for v in b.column(3):
                x = np.array(v.as_py(), dtype=np.float64)
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["class_id", "cell", "m", "vec"])

    points = cut_lineage(classes.select("class_id", F.col("root_cell").alias("cell"), "m", "e").mapInArrow(unit, "class_id long, cell long, m long, vec binary"))
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min_by("vec", "class_id").alias("centre"), F.lit(2.0).alias("radius"))
    cells = cut_lineage(cells)
    pairs = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    where_ = points.select("class_id", "cell")
    radius = 1.0
    while radius > tau / 4:  # below that all vectors of a cell are linked; hash parts will do
        big = cells.where(F.col("size") > leaf)
        if big.isEmpty():
            break
        wide = points.drop("cell").join(where_, "class_id").join(big.select("cell", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts"), F.least(F.lit(CENTRES), F.ceil(F.col("size") * 2 / leaf)).cast("int").alias("most"), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE)).alias("rate"), F.col("centre").alias("nested")), "cell")
        # A sample of about SAMPLE vectors of each split cell, whatever its size; the cell's own centre stays a centre.
        drawn = wide.where(F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("rate")) == 0).select("cell", "class_id", "vec", "salts", "most", "nested")
        drawn = drawn.unionByName(wide.groupBy("cell").agg(F.lit(-1).cast("long").alias("class_id"), F.first("nested").alias("vec"), F.first("salts").alias("salts"), F.first("most").alias("most"), F.first("nested").alias("nested")))

        packs = cut_lineage(drawn.groupBy("cell").applyInPandas(_chooser(radius), "cell long, salts int, centres binary"))
        moved = cut_lineage(_assign(wide.select("cell", "salts", "class_id", "vec"), packs, n_parts).withColumn("cell", F.xxhash64("parent", "child", F.lit(radius))))
        made = moved.groupBy("cell", "parent", "child").agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("radius"))
        made = made.join(packs.select(F.col("cell").alias("parent"), "centres"), "parent").select("cell", "parent", "size", _nth("centres", "child").alias("centre"), "radius")
        same = cells.where(F.col("size") <= leaf).select("cell", F.col("cell").alias("parent"), "size", "centre", "radius")
        children = cut_lineage(made.unionByName(same))
        pairs = cut_lineage(_refine(pairs, children, tau))
        where_ = cut_lineage(where_.join(moved.select("class_id", F.col("cell").alias("to")), "class_id", "left").select("class_id", F.coalesce("to", "cell").alias("cell")))
        cells = children.select("cell", "size", "centre", "radius")
        radius /= 2

    # Leaves of at most ``leaf`` vectors; a cell that stayed larger is dealt into several by hash.
    parts = cells.select("cell", F.ceil(F.col("size") / leaf).cast("int").alias("parts"))
    leaves = points.drop("cell").join(where_, "class_id").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(3)), F.col("parts")).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id", ignore_index=True)
        blob = pdf["class_id"].to_numpy("<i8").tobytes(), pdf["m"].to_numpy("<i8").tobytes(), b"".join(pdf["vec"])
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "ids": [blob[0]], "ms": [blob[1]], "vecs": [blob[2]]})

    packed = cut_lineage(leaves.select("cell", "part", "class_id", "m", "vec").groupBy("cell", "part").applyInPandas(pack, "cell long, part int, ids binary, ms binary, vecs binary"))
    pa_ = packed.select(F.col("cell").alias("a"), F.col("part").alias("pa"), F.col("ids").alias("ids_a"), F.col("ms").alias("ms_a"), F.col("vecs").alias("vecs_a"))
    pb_ = packed.select(F.col("cell").alias("b"), F.col("part").alias("pb"), F.col("ids").alias("ids_b"), F.col("ms").alias("ms_b"), F.col("vecs").alias("vecs_b"))
    keys = packed.select("cell", "part")
    jobs = pairs.join(keys.select(F.col("cell").alias("a"), F.col("part").alias("pa")), "a").join(keys.select(F.col("cell").alias("b"), F.col("part").alias("pb")), "b")
    jobs = jobs.where((F.col("a") != F.col("b")) | (F.col("pa") <= F.col("pb"))).repartition(n_parts)
    work = jobs.join(pa_, ["a", "pa"]).join(pb_, ["b", "pb"])
    local_radii = [0.5, 0.25, 0.125]

    def compare(batches):
        trees: dict[tuple, LocalTree] = {}

        def tree(key, vecs, n):
            if key not in trees:
                if len(trees) > 4:
                    trees.clear()
                trees[key] = LocalTree(np.frombuffer(vecs, "<f8").reshape(n, -1), local_radii)
            return trees[key]

        for x in batches:
            ids, counts, roots = [], [], []
            for a, p, b, q, ia, ma, va, ib, mb, vb in zip(*(c.to_pylist() for c in x.columns)):
                ia, ma, ib, mb = (np.frombuffer(v, "<i8") for v in (ia, ma, ib, mb))
                ta, tb = tree((a, p), va, len(ia)), tree((b, q), vb, len(ib))
                ra, rb = dual(ta, tb, tau)
                if not len(ra) or not len(rb):
                    continue
                link = ta.x[ra] @ tb.x[rb].T >= cosine
                if (a, p) == (b, q):
                    link &= ra[:, None] != rb[None, :]
                rows_, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
                if not len(rows_):
                    continue
                link, ra, rb = link[np.ix_(rows_, cols)], ra[rows_], rb[cols]
                la, lb = _roots(link, ia[ra], ib[rb])
                ids.append(ia[ra])
                counts.append(link @ mb[rb])
                roots.append(la)
                if (a, p) != (b, q):
                    ids.append(ib[rb])
                    counts.append(ma[ra] @ link)
                    roots.append(lb)
            cols_ = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ids, counts, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in cols_], names=["class_id", "links", "root"])

    found = work.select("a", "pa", "b", "pb", "ids_a", "ms_a", "vecs_a", "ids_b", "ms_b", "vecs_b").mapInArrow(compare, "class_id long, links long, root long")
    found = cut_lineage(found)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    labels = components(found, "class_id", "root")
    rooted = classes.select("class_id", "label", "e", "m", "first_id").join(labels.select(F.col("node").alias("class_id"), "root"), "class_id", "left").join(links, "class_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class_id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component_id")
    out = marked.join(named, ["label", "e"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _nth(pack: str, child: str):
    """The vector number ``child`` of a pack: its dimension as a double, then the vectors."""

    def run(packs: pd.Series, children: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(packs, children):
            x = np.frombuffer(p, "<f8")
            d = int(x[0])
            out.append(x[1 + c * d : 1 + (c + 1) * d].tobytes())
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(F.col(pack), F.col(child))


def _chooser(radius: float):
    """Centres of a cell's sample that lie further apart than ``radius``."""

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id", ignore_index=True)
        x = np.vstack([np.frombuffer(pdf["nested"][0], "<f8"), _unpack(list(pdf["vec"]))])
        taken = x[net(x, radius, int(pdf["most"][0]), [0])]
        pack = np.concatenate(([x.shape[1]], taken.ravel())).astype("<f8").tobytes()
        return pd.DataFrame({"cell": [key[0]], "salts": [pdf["salts"][0]], "centres": [pack]})

    return choose
