"""Nearest neighbours on a space partition whose cells are bounded by count, not by size.

Targets are cut level by level into a tree: a node with more than ``LEAF`` places is split along its widest side at
quantiles of its own coordinates into up to ``FAN`` children, so a dense spot gets a deeper tree and never a crowded
cell. Quantiles, counts and tight boxes come from one aggregation per level. A point walks down to the leaf whose box
is nearest; the k-th distance there bounds its search, a second walk visits only the boxes within that bound, and the
best-k lists of all visited leaves are merged. A point therefore meets the targets of a few leaves wherever it lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.session import cut_lineage

#: Most places of a leaf, children of a node as a power of two, nodes of a level up to which it is broadcast.
LEAF, FAN_BITS, SMALL = 64, 4, 20_000
FAN = 2**FAN_BITS
#: Partitions of the points per core of the cluster.
SPREAD = 3


@dataclass
class Tree:
    """``roots``: node, cnt and box per key; ``children[l]``: child nodes per node of level l; ``contents``: places per leaf."""

    roots: DataFrame
    children: list[DataFrame]
    contents: DataFrame


def known(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def _places(targets: DataFrame, target: str, ks: list[str], dims: list[str], keep: int) -> DataFrame:
    """Distinct coordinates per key with the ``keep`` smallest ids found there."""
    rows = targets.where(known(dims)).select(*ks, *[F.col(c).cast("double").alias(c) for c in dims], F.col(target).alias("_id"))
    for k in ks:
        rows = rows.where(F.col(k).isNotNull())
    if keep == 1:
        return rows.groupBy(*ks, *dims).agg(F.array(F.min("_id")).alias("_ids"))
    # One place may hold very many targets: the smallest ids of salted parts first.
    salt = F.pmod(F.xxhash64("_id"), F.lit(16))
    for parts in ([salt], []):
        place = F.row_number().over(Window.partitionBy(*ks, *dims, *parts).orderBy("_id"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
    return rows.groupBy(*ks, *dims).agg(F.sort_array(F.collect_list("_id")).alias("_ids"))


def build_tree(targets: DataFrame, target: str, dims: Sequence[str], keys: Sequence[str] = (), *, keep: int = 1, leaf: int = LEAF) -> Tree:
    """Count-bounded tree over the distinct places of targets; every leaf holds at most ``leaf`` places."""
    ks, dims = list(keys), list(dims)
    work = cut_lineage(_places(targets, target, ks, dims, keep).withColumn("_node", F.lit(1).cast("long")))
    on, levels, sizes, contents = [*ks, "_node"], [], [], None
    shares = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    while True:
        stats = work.groupBy(*on).agg(
            F.count(F.lit(1)).alias("cnt"),
            *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))],
            *[F.percentile_approx(c, shares, 256).alias(f"cut_{c}") for c in dims],
        )
        stats = cut_lineage(stats)
        box = [f"{n}_{c}" for c in dims for n in ("lo", "hi")]
        levels.append(stats.select(*on, "cnt", *box))
        large = stats.where(F.col("cnt") > leaf)
        n_large, n_nodes = stats.agg(F.count_if(F.col("cnt") > leaf), F.count(F.lit(1))).first()
        sizes.append(n_nodes)
        if not n_large:
            contents = work if contents is None else contents.unionByName(work)
            break
        extent = {c: F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in dims}
        widest = F.greatest(*extent.values()) if len(dims) > 1 else extent[dims[0]]
        axis, cuts = F.lit(None).cast("int"), F.lit(None).cast("array<double>")
        for i, c in reversed(list(enumerate(dims))):
            # Cut points below the maximum leave something on both sides; with none of them the minimum does.
            top = F.col(f"hi_{c}")
            inner = F.array_distinct(F.filter(F.col(f"cut_{c}"), lambda v: v < top))  # noqa: B023 (used at once)
            inner = F.when(F.size(inner) > 0, inner).otherwise(F.array(F.col(f"lo_{c}")))
            axis = F.when(extent[c] == widest, F.lit(i)).otherwise(axis)
            cuts = F.when(extent[c] == widest, inner).otherwise(cuts)
        splits = large.select(*on, axis.alias("_axis"), cuts.alias("_cuts"))
        if n_large <= SMALL:
            splits = F.broadcast(splits)
        moved = work.join(splits, on, "left")
        ended = moved.where("_cuts IS NULL").select(*work.columns)
        contents = ended if contents is None else contents.unionByName(ended)
        x = F.element_at(F.array(*dims), F.col("_axis") + 1)
        child = F.size(F.filter("_cuts", lambda v: v < x))
        work = cut_lineage(moved.where("_cuts IS NOT NULL").withColumn("_node", F.col("_node") * FAN + child).select(*work.columns))
    # A leaf has at most ``leaf`` places and a node at most ``FAN`` children.
    contents = contents.groupBy(*on).agg(F.collect_list(F.struct(*dims, F.col("_ids").alias("ids"))).alias("_items"))
    children = []
    for level, n_nodes in zip(levels[1:], sizes[1:]):
        one = F.struct(F.col("_node").alias("node"), "cnt", (F.col("cnt") <= leaf).alias("leaf"), *box)
        up = level.select(*ks, F.shiftright("_node", FAN_BITS).alias("_node"), one.alias("_c"))
        up = up.groupBy(*on).agg(F.collect_list("_c").alias("_children"))
        children.append(F.broadcast(up) if n_nodes <= SMALL else up)
    return Tree(levels[0], children, cut_lineage(contents))


def _sum_of_squares(terms: Sequence[Column]) -> Column:
    return sum((t * t for t in terms[1:]), terms[0] * terms[0])


def nearest(
    points: DataFrame,
    targets: DataFrame,
    *,
    point: str,
    target: str,
    coords: Sequence[str],
    keys: Sequence[str] = (),
    k: int = 1,
    within: float | None = None,
    other: bool = False,
    leaf: int = LEAF,
) -> DataFrame:
    """The k nearest targets of each point in Euclidean distance, lower id first at equal distance.

    Columns: point, distance, target, and rank (from 1) where k > 1. With ``keys`` a point only meets targets of
    its own key. ``other=True`` searches among the points of the same table for others (C9): another point at the
    same place is at distance 0. Points without coordinates, without a key or without any target keep one row of
    NULLs; ``within`` drops those and everything farther away.
    """
    found = nearest_pairs(points, targets, point=point, target=target, coords=coords, keys=keys, k=k, within=within, other=other, leaf=leaf)
    rank = [] if k == 1 else ["rank"]
    found = found.select(point, "distance", "target", *rank)
    return found if within is not None else points.select(point).join(found, point, "left")


def nearest_pairs(
    points: DataFrame, targets: DataFrame, *, point: str, target: str, coords: Sequence[str], keys: Sequence[str], k: int,
    within: float | None, other: bool, leaf: int,
) -> DataFrame:
    """(point, rank, distance, target) of points that have a neighbour; see :func:`nearest`."""
    ks, dims = list(keys), list(coords)
    need = k + 1 if other else k
    tree = build_tree(targets, target, dims, ks, keep=need, leaf=leaf)
    on, at = [*ks, "_node"], {c: F.col(f"_p_{c}") for c in dims}

    def gap(box: Column | None) -> Column:
        side = {c: (F.col(f"lo_{c}"), F.col(f"hi_{c}")) if box is None else (box[f"lo_{c}"], box[f"hi_{c}"]) for c in dims}
        return _sum_of_squares([F.greatest(lo - at[c], at[c] - hi, F.lit(0.0)) for c, (lo, hi) in side.items()])

    def far(box: Column | None) -> Column:
        side = {c: (F.col(f"lo_{c}"), F.col(f"hi_{c}")) if box is None else (box[f"lo_{c}"], box[f"hi_{c}"]) for c in dims}
        return _sum_of_squares([F.greatest(F.abs(at[c] - lo), F.abs(hi - at[c])) for c, (lo, hi) in side.items()])

    def best() -> Column:
        """The k nearest of a leaf's targets as sorted {d2, id}."""
        def of_place(i: Column) -> Column:
            d2 = _sum_of_squares([i[c] - at[c] for c in dims])
            if need == 1:
                return F.struct(d2.alias("d2"), i["ids"][0].alias("id"))
            return F.transform(i["ids"], lambda t: F.struct(d2.alias("d2"), t.alias("id")))

        every = F.transform("_items", of_place)
        every = every if need == 1 else F.flatten(every)
        if other:
            every = F.filter(every, lambda h: h["id"] != F.col(point))
        return F.array_compact(F.array(F.array_min(every))) if k == 1 else F.slice(F.sort_array(every), 1, k)

    # Coordinates are used in many expressions below, so they are computed once; points go everywhere by their key. A walk
    # takes long for the few bytes of a point, so points are dealt over all cores whatever their size.
    asked = points.select(point, *ks, *[F.col(c).cast("double").alias(f"_p_{c}") for c in dims])
    asked = cut_lineage(asked.repartition(SPREAD * points.sparkSession.sparkContext.defaultParallelism, point))
    asked = asked.where(known([f"_p_{c}" for c in dims]))
    roots = tree.roots if ks else F.broadcast(tree.roots)  # one row without keys
    walk = asked.withColumn("_node", F.lit(1).cast("long")).join(roots, on)
    bound = F.when(F.col("cnt") >= need, far(None))
    walk = walk.select(*asked.columns, "_node", bound.alias("_r2"))
    for children in tree.children:
        walk = walk.join(children, on, "left")
        # Nearest box; inside several boxes the smaller one.
        choice = F.array_min(F.transform("_children", lambda c: F.struct(gap(c).alias("gap"), far(c).alias("far"), c["node"].alias("node"), c["cnt"].alias("cnt"))))
        walk = walk.withColumn("_to", choice).select(
            *asked.columns,
            F.coalesce("_to.node", "_node").alias("_node"),
            F.least("_r2", F.when(F.col("_to.cnt") >= need, F.col("_to.far"))).alias("_r2"),
        )
    home = walk.join(tree.contents, on).withColumn("_best", best())
    limit = F.least("_r2", F.get("_best", k - 1)["d2"])
    if within is not None:
        limit = F.least(limit, F.lit(float(within) ** 2))
    # Slack for the rounding of squares: a box is visited rather once too often.
    home = home.select(*asked.columns, F.col("_node").alias("_home"), (limit * (1 + 1e-12)).alias("_r2"), "_best")
    lists = home.select(point, "_best")
    if tree.children:
        home = cut_lineage(home)
        lists, leaves = home.select(point, "_best"), None
        search = home.drop("_best").withColumn("_node", F.lit(1).cast("long"))
        for children in tree.children:
            near = F.filter("_children", lambda c: F.coalesce(gap(c) <= F.col("_r2"), F.lit(True)) & (c["node"] != F.col("_home")))
            hits = search.join(children, on).withColumn("_c", F.explode(near))
            hits = hits.select(*asked.columns, "_home", "_r2", F.col("_c.node").alias("_node"), F.col("_c.leaf").alias("_leaf"))
            hits = cut_lineage(hits) if children is not tree.children[-1] else hits
            ended = hits.where("_leaf").drop("_leaf")
            leaves = ended if leaves is None else leaves.unionByName(ended)
            search = hits.where("NOT _leaf").drop("_leaf")
        more = leaves.join(tree.contents, on).withColumn("_best", best()).where(F.size("_best") > 0)
        lists = lists.unionByName(more.select(point, "_best"))
    if k == 1:
        merged = lists.where(F.size("_best") > 0).groupBy(point).agg(F.array(F.min(F.col("_best")[0])).alias("_best"))
    else:
        # As many lists of k as leaves were visited.
        merged = lists.groupBy(point).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"))
    out = merged.select(point, F.posexplode("_best").alias("_i", "_h"))
    out = out.select(point, (F.col("_i") + 1).alias("rank"), F.sqrt("_h.d2").alias("distance"), F.col("_h.id").alias("target"))
    return out if within is None else out.where(F.col("distance") <= F.lit(float(within)))
