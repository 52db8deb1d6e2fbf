"""Order-dependent operators that never put a whole hot group into one task.

Ranks, cumulative sums, exact quantiles and row-neighbour windows need their group sorted. A plain
window or ``percentile`` does that in one task per group, which is fine for ordinary groups and fails
for a group that holds a third of all rows (or for a global ranking, where the group is the table).

Every operator here therefore splits its input by group size:

* groups of at most ``max_group`` rows take the usual Spark window or ``percentile``;
* larger groups are cut into value buckets at approximate quantiles of their own values, so that
  outliers, infinities, NaN and lopsided distributions still spread evenly. Bucket totals give the offset
  of each bucket, and only (group, bucket) pairs are sorted. Nothing is broadcast by force, and NULL keys
  are groups like any other.

Both ways are exact and give the same result. Group sizes are checked first by one count per group
(combined map-side); only whether there is any large group reaches the driver. If there is none, the
plan is the plain one. If there are some, their rows are read several times and are therefore
checkpointed when they come out of a join or an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.session import cut_lineage

#: Rows up to which a group is handled in a single task.
MAX_GROUP = 500_000
#: Cut points of a large group, as a power of two, and the accuracy of the quantile sketch they come from.
SPLIT_BITS, SKETCH = 9, 20_000

_ALL = "_all"
_N, _CUTS, _B = "_grp_n", "_grp_cuts", "_bucket"


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A global operation is a grouped one with a single constant key."""
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def finite(column: str | Column) -> Column:
    """True where a number is neither NULL nor NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys meet NULL keys; the key columns of ``left`` stay."""
    there = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    out = left.join(there, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*(f"_r_{k}" for k in keys))


#: Rows up to which a table is handed to every task.
SMALL_TABLE = 200_000


def handed_out(table: DataFrame) -> DataFrame:
    """A checkpointed table marked for broadcast if it is counted to hold at most ``SMALL_TABLE`` rows.

    A join with few keys would otherwise deal all rows of the other side to as many tasks, and adaptive execution does not
    turn to a broadcast by itself where most partitions of the small side are empty.
    """
    return F.broadcast(table) if table.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else table


def large_groups(df: DataFrame, keys: Sequence[str], max_group: int = MAX_GROUP) -> DataFrame:
    """Groups above ``max_group`` rows with their size; at most rows / max_group of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_N)).where(F.col(_N) > F.lit(max_group))


def _derived(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in plan for word in ("Aggregate", "Join", "Window"))


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a frame that several steps read, if it comes out of a join or an aggregation."""
    return cut_lineage(df) if _derived(df) else df


def split_by_size(
    df: DataFrame, keys: Sequence[str], order: str, max_group: int = MAX_GROUP
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small groups, rows of large groups with their size and range, or None without any)."""
    # Cached only until it is written, so that the check and the list share one pass over the input.
    counted = large_groups(df, keys, max_group).persist()
    try:
        if counted.isEmpty():
            return df, None
        large = cut_lineage(counted)
    finally:
        counted.unpersist()
    small = null_safe_join(df, large.select(*keys), keys, "left_anti")
    big = null_safe_join(df, large, keys)
    if _derived(df):
        big = cut_lineage(big)
    # A mergeable sketch per group: one row of cut points for each, whatever its size.
    shares = [i / 2**SPLIT_BITS for i in range(1, 2**SPLIT_BITS)]
    cuts = big.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), shares, SKETCH).alias(_CUTS))
    return small, null_safe_join(big, cut_lineage(cuts), keys)


def _bucket(order: str) -> Column:
    """Number of the group's cut points below the order value, by bisection. Equal values share a bucket."""
    x = F.col(order).cast("double")

    def step(below: Column, half: Column) -> Column:
        at = below + half
        return F.when((at < 2**SPLIT_BITS) & (F.try_element_at(_CUTS, at) < x), at).otherwise(below)

    halves = F.array(*[F.lit(2**k) for k in range(SPLIT_BITS - 1, -1, -1)])
    return F.coalesce(F.aggregate(halves, F.lit(0), step), F.lit(0)).cast("long")


def _bucket_offsets(tagged: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], descending: bool) -> DataFrame:
    """Sum of each quantity over all buckets before a bucket, one row per (large group, bucket)."""
    totals = tagged.groupBy(*keys, _B).agg(*[e.alias(f"_off_{n}") for n, e in sums.items()])
    order = F.col(_B).desc() if descending else F.col(_B).asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, _B, *[F.coalesce(F.sum(f"_off_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    extra: Mapping[str, Column] | None = None,
    descending: bool = False,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """One row per (keys, distinct order value) with ``n``, ``n_cum`` (inclusive) and ``n_all`` for each sum.

    Duplicates collapse before anything is shuffled, so a hot value costs one row per task. ``extra`` are
    further aggregates per distinct value that are carried along.
    """
    df, ks = _keyed(df, keys)
    extra = dict(extra or {})
    names = list(sums)
    points = df.groupBy(*ks, order).agg(
        *[e.alias(n) for n, e in sums.items()], *[e.alias(n) for n, e in extra.items()]
    )
    small, big = split_by_size(points, ks, order, max_group)
    by = F.col(order).desc() if descending else F.col(order).asc()

    def cumulated(part: DataFrame, groups: list[str]) -> DataFrame:
        upto = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumns({f"{n}_cum": F.sum(n).over(upto) for n in names})

    everything = Window.partitionBy(*ks)
    out_cols = [*ks, order, *names, *extra, *[f"{n}_cum" for n in names], *[f"{n}_all" for n in names]]
    small_out = cumulated(small, ks).withColumns({f"{n}_all": F.sum(n).over(everything) for n in names})
    if big is None:
        return small_out.select(*[c for c in out_cols if keys or c != _ALL])

    tagged = big.withColumn(_B, _bucket(order))
    offsets = _bucket_offsets(tagged, ks, {n: F.sum(n) for n in names}, descending)
    totals = big.groupBy(*ks).agg(*[F.sum(n).alias(f"{n}_all") for n in names])
    placed = null_safe_join(cumulated(tagged, [*ks, _B]), offsets, [*ks, _B])
    big_out = (
        null_safe_join(placed, totals, ks)
        .withColumns({f"{n}_cum": F.col(f"{n}_cum") + F.col(f"_off_{n}") for n in names})
    )
    out = small_out.select(*out_cols).unionByName(big_out.select(*out_cols))
    return out if keys else out.drop(_ALL)


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    *,
    name: str = "row_index",
    descending: bool = False,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """1-based position of each row in its group by (order, ties).

    Rows with equal ``order`` stay in one bucket; use :func:`ordinal_index` where one value may be hot.
    """
    df, ks = _keyed(df, keys)
    small, big = split_by_size(df, ks, order, max_group)
    by = [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in ties]]
    small_out = small.withColumn(name, F.row_number().over(Window.partitionBy(*ks).orderBy(*by)).cast("long"))
    if big is None:
        return small_out if keys else small_out.drop(_ALL)
    tagged = big.withColumn(_B, _bucket(order))
    offsets = _bucket_offsets(tagged, ks, {"n": F.count(F.lit(1))}, descending)
    inside = tagged.withColumn(name, F.row_number().over(Window.partitionBy(*ks, _B).orderBy(*by)).cast("long"))
    big_out = null_safe_join(inside, offsets, [*ks, _B]).withColumn(name, F.col(name) + F.col("_off_n"))
    cols = [*df.columns, name]
    out = small_out.select(*cols).unionByName(big_out.select(*cols))
    return out if keys else out.drop(_ALL)


def ordinal_index(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    *,
    name: str = "row_index",
    descending: bool = False,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Like :func:`row_index`, safe where a single value holds a large part of the rows.

    Position = rows with a smaller value + position by ``tie`` among the rows of the same value.
    """
    df, ks = _keyed(df, keys)
    small, big = split_by_size(df, ks, order, max_group)
    by = F.col(order).desc() if descending else F.col(order).asc()
    small_out = small.withColumn(
        name, F.row_number().over(Window.partitionBy(*ks).orderBy(by, F.col(tie).asc())).cast("long")
    )
    if big is None:
        return small_out if keys else small_out.drop(_ALL)
    big = big.select(*df.columns)
    before = running_totals(
        big, ks, order, {"_n": F.count(F.lit(1))}, descending=descending, max_group=max_group
    ).select(*ks, order, (F.col("_n_cum") - F.col("_n")).alias("_before"))
    within = row_index(big, [*ks, order], tie, name=name, max_group=max_group)
    big_out = null_safe_join(within, before, [*ks, order]).withColumn(name, F.col(name) + F.col("_before"))
    cols = [*df.columns, name]
    out = small_out.select(*cols).unionByName(big_out.select(*cols))
    return out if keys else out.drop(_ALL)


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    name: str = "avg_rank",
    count_name: str | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Average rank of ties (E2, E3). Rows with a missing value keep a NULL rank."""
    df, ks = _keyed(df, keys)
    count_name = count_name or f"{name}_n"
    known = df.where(F.col(value).isNotNull())
    unknown = df.where(F.col(value).isNull())
    small, big = split_by_size(known, ks, value, max_group)
    ordered = Window.partitionBy(*ks).orderBy(value)
    ties = Window.partitionBy(*ks, value)
    small_out = small.withColumn(
        name, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - F.lit(1)) / F.lit(2.0)
    ).withColumn(count_name, F.count(F.lit(1)).over(Window.partitionBy(*ks)))
    cols = [*df.columns, name, count_name]
    unranked = unknown.withColumns({name: F.lit(None).cast("double"), count_name: F.lit(None).cast("long")})
    small_out = small_out.select(*cols).unionByName(unranked.select(*cols))
    if big is None:
        return small_out if keys else small_out.drop(_ALL)
    big = big.select(*df.columns)
    ranks = running_totals(big, ks, value, {"_n": F.count(F.lit(1))}, max_group=max_group).select(
        *ks,
        value,
        (F.col("_n_cum") - F.col("_n") + (F.col("_n") + F.lit(1)) / F.lit(2.0)).alias(name),
        F.col("_n_all").alias(count_name),
    )
    out = small_out.unionByName(null_safe_join(big, ranks, [*ks, value]).select(*cols))
    return out if keys else out.drop(_ALL)


#: Size of a column's quantile sketch (its rank error is about 2 / size), how far around a wanted rank brackets reach,
#: and values of a column that may be gathered inside a bracket.
COLUMN_SKETCH, MARGIN, INSIDE = 8192, 0.001, 50_000
#: Parts a bracket is cut into when it holds too many values.
_CUT = 64


class _ColumnSelect:
    """Selection of ranks in many columns at once; see :func:`column_quantiles`."""

    def __init__(self, df: DataFrame, columns: Sequence[str], inside: int, margin: float):
        self.inside, self.margin = inside, margin
        self.values = df.select(*[F.when(finite(c), F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)])
        self.names = [f"_v{i}" for i in range(len(columns))]

    def sketched(self, counts: list[Column], inputs: dict[str, Column], shares: list[float]):
        """Summed counts, and for each input the quantiles of its sketch; sketches are merged in two steps."""
        parts = self.values.withColumn("_part", F.spark_partition_id() % 64).groupBy("_part")
        parts = parts.agg(*counts, *[F.kll_sketch_agg_double(x, F.lit(COLUMN_SKETCH)).alias(f"{n}_s") for n, x in inputs.items()])
        summed = [c for c in parts.columns if c != "_part" and not c.endswith("_s")]
        merged = [F.kll_merge_agg_double(f"{n}_s").alias(f"{n}_s") for n in inputs]
        whole = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed], *merged)
        cuts = F.array(*[F.lit(float(q)) for q in shares])
        has = {n: F.kll_sketch_get_n_double(f"{n}_s") > 0 for n in inputs}
        return whole.select(*summed, *[F.when(has[n], F.kll_sketch_get_quantile_double(f"{n}_s", cuts)).alias(f"{n}_q") for n in inputs]).first()

    def brackets(self, left: dict) -> tuple[dict, list[Column], dict[str, Column]]:
        """A tag per distinct bracket, counts of the rows below, at the ends and inside, and the values inside."""
        tags = {b: f"_k{i}" for i, b in enumerate(dict.fromkeys((v, low, high) for (v, _), (low, high, _) in left.items()))}
        counts, inputs = [], {}
        for (v, low, high), tag in tags.items():
            x, within, none = F.col(v), F.col(v).isNotNull(), F.lit(0).cast("long")
            if low is not None:
                within = within & (x > F.lit(low))
            if high is not None:
                within = within & (x < F.lit(high))
            counts += [
                (none if low is None else F.count_if(x < F.lit(low))).alias(f"{tag}_below"),
                (none if low is None else F.count_if(x == F.lit(low))).alias(f"{tag}_low"),
                F.count_if(within).alias(f"{tag}_in"),
                (none if high is None or high == low else F.count_if(x == F.lit(high))).alias(f"{tag}_high"),
            ]
            inputs[tag] = F.when(within, x)
        return tags, counts, inputs

    def narrowed(self, left: dict) -> dict:
        """Smaller brackets around the same ranks, between quantiles of the values inside."""
        tags, counts, inputs = self.brackets(left)
        seen = self.sketched(counts, inputs, [i / _CUT for i in range(1, _CUT)])
        out = {}
        for (v, rank), (low, high, _) in left.items():
            tag = tags[v, low, high]
            n = seen[f"{tag}_in"]
            at = (rank - seen[f"{tag}_below"] - seen[f"{tag}_low"]) / max(n, 1) * _CUT
            if n <= self.inside or not 0 <= at <= _CUT:
                out[v, rank] = (low, high, min(n, self.inside))
            else:
                cuts = [low, *seen[f"{tag}_q"], high]
                first, last = max(0, math.floor(at - 1)), min(_CUT, math.ceil(at + 1))
                out[v, rank] = (cuts[first], cuts[last], math.ceil(n * (last - first + 1) / _CUT))
        return out

    def gathered(self, left: dict) -> tuple[dict, dict]:
        """Values found at ranks, and brackets on the side where a rank was missed."""
        tags, counts, inputs = self.brackets(left)
        lists = [F.sort_array(F.collect_list(x)).alias(f"{t}_x") for t, x in inputs.items()]
        counts = [c for i, c in enumerate(counts) if i % 4 != 2]  # the lists tell how many lie inside
        inside = {f"{t}_in": F.size(f"{t}_x") for t in inputs}
        picks = []
        for i, ((v, rank), (low, high, _)) in enumerate(left.items()):
            tag = tags[v, low, high]
            place = (F.lit(rank) - F.col(f"{tag}_below") - F.col(f"{tag}_low")).cast("int")
            picks.append(F.when(place >= 0, F.get(f"{tag}_x", place)).alias(f"_p{i}"))
        kinds = ("below", "low", "in", "high")
        whole = self.values.agg(*counts, *lists).withColumns(inside)
        got = whole.select(*[f"{t}_{k}" for t in tags.values() for k in kinds], *picks).first()
        found, missed = {}, {}
        for i, ((v, rank), (low, high, _)) in enumerate(left.items()):
            below, at_low, n, at_high = (got[f"{tags[v, low, high]}_{k}"] for k in kinds)
            after = rank - below
            if after < 0:
                missed[v, rank] = (None, low, below)
            elif after < at_low:
                found[v, rank] = low
            elif after < at_low + n:
                found[v, rank] = got[f"_p{i}"]
            elif after < at_low + n + at_high:
                found[v, rank] = high
            else:
                missed[v, rank] = (high, None, rank + self.inside + 1)
        return found, missed


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], *, inside: int = INSIDE, margin: float = MARGIN
) -> dict[str, dict[str, float | None]]:
    """Exact linear-interpolation quantiles of several columns over all rows (B12, D13, L5); None without values.

    No explode, sort or shuffle of rows. A first pass keeps one mergeable sketch per column, all side by side.
    They give a bracket of values around each wanted rank. A second pass counts the rows below each bracket and
    at its ends, so equal values, however many, are only counted, and gathers the values strictly inside.
    Brackets that hold more than ``inside`` values are narrowed first by sketches of their own values, and a
    bracket that missed its rank gives way to the side it missed. Counts make every result exact, whatever
    sketches said. The driver receives a few numbers per column.
    """
    columns = list(dict.fromkeys(columns))
    select = _ColumnSelect(df, columns, inside, margin)
    shares = [float(q) for q in probs.values()]
    around = [min(1.0, max(0.0, q + side * margin)) for q in shares for side in (-1, 1)]
    first = select.sketched([F.count(v).alias(f"{v}_n") for v in select.names], {v: F.col(v) for v in select.names}, around)
    left, found = {}, {}
    for v in select.names:
        n = first[f"{v}_n"]
        for i, q in enumerate(shares):
            for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
                if n <= inside:
                    left[v, rank] = (None, None, n)
                else:
                    low = first[f"{v}_q"][2 * i] if around[2 * i] > 0 else None
                    high = first[f"{v}_q"][2 * i + 1] if around[2 * i + 1] < 1 else None
                    left[v, rank] = (low, high, math.ceil(4 * margin * n))
    while left:
        while wide := {k: b for k, b in left.items() if b[2] > inside}:
            left |= select.narrowed(wide)
        more, left = select.gathered(left)
        found |= more

    def between(v: str, q: float) -> float | None:
        n = first[f"{v}_n"]
        if not n:
            return None
        position = q * (n - 1)
        low, high = found[v, math.floor(position)], found[v, math.ceil(position)]
        return low + (high - low) * (position - math.floor(position))

    return {c: {name: between(v, q) for name, q in probs.items()} for c, v in zip(columns, select.names)}


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``probs``.

    Without keys these are :func:`column_quantiles` of the whole table. Large groups: count per value bucket, keep only the buckets that hold a wanted rank, then rank the
    distinct values in those buckets. No full sort and no full shuffle of a large group.
    """
    if not keys:
        found = column_quantiles(df, [value], probs)[value]
        one = df.sparkSession.range(1).select(*[F.lit(found[n]).cast("double").alias(n) for n in probs])
        return one.where(F.lit(None not in found.values()))
    ks = list(keys)
    vals = df.select(*ks, F.col(value).cast("double").alias("_v")).where(finite("_v"))
    small, big = split_by_size(vals, ks, "_v", max_group)
    names = list(probs)
    qs = [float(probs[n]) for n in names]
    small_out = small.groupBy(*ks).agg(F.percentile("_v", F.array(*[F.lit(q) for q in qs])).alias("_q")).select(
        *ks, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
    )
    if big is None:
        return small_out

    tagged = big.withColumn(_B, _bucket("_v"))
    counts = tagged.groupBy(*ks, _B).agg(F.count(F.lit(1)).alias("_c"), F.first(_N).alias(_N))
    upto = Window.partitionBy(*ks).orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))

    def position(q: float) -> Column:
        return F.lit(q) * (F.col(_N) - F.lit(1))

    def covers(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_end"))

    wanted = F.lit(False)
    for q in qs:
        wanted = wanted | covers(F.floor(position(q))) | covers(F.ceil(position(q)))
    needed = counts.where(wanted).select(*ks, _B, "_start")
    # Bounded: at most 2 buckets per quantile and large group.
    kept = null_safe_join(tagged, needed, [*ks, _B])
    distinct = kept.groupBy(*ks, _B, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_start").alias("_start"), F.first(_N).alias(_N)
    )
    inside = Window.partitionBy(*ks, _B).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    aggs = [F.first(_N).alias(_N)]
    for i, q in enumerate(qs):
        lower, upper = F.floor(position(q)), F.ceil(position(q))
        aggs += [
            F.min(F.when(F.col("_end") > lower, F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_end") > upper, F.col("_v"))).alias(f"_up{i}"),
        ]
    big_out = ranked.groupBy(*ks).agg(*aggs)
    big_out = big_out.select(
        *ks,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_up{i}") - F.col(f"_lo{i}")) * (position(q) - F.floor(position(q)))).alias(n)
            for i, (n, q) in enumerate(zip(names, qs))
        ],
    )
    return small_out.unionByName(big_out)


def scalar_quantile(df: DataFrame, value: str | Column, q: float, *, max_group: int = MAX_GROUP) -> Column:
    """Exact global quantile as a scalar-subquery column (X5, L5): no collect, no join."""
    c = F.col(value) if isinstance(value, str) else value
    return quantiles(df.select(c.alias("_x")), [], "_x", {"q": q}, max_group=max_group).scalar()


def weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probs: Mapping[str, float],
    *,
    method: str,
    tie: str | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Weighted quantiles over rows with finite value and weight > 0.

    ``method="interp"`` (D23) interpolates value over the cumulative weight share, with rows of equal value
    ordered by ``tie``; ``method="step"`` (D24) takes the first value whose cumulative weight reaches q.
    """
    if method not in ("interp", "step"):
        raise ValueError("method must be 'interp' or 'step'")
    ok = df.where(finite(value) & finite(weight) & (F.col(weight) > 0))
    sums = {"_w": F.sum(F.col(weight).cast("double"))}
    if method == "step":
        rt = running_totals(ok, keys, value, sums, max_group=max_group)
        aggs = [
            F.min(F.when(F.col("_w_cum") >= F.lit(q) * F.col("_w_all"), F.col(value))).cast("double").alias(n)
            for n, q in probs.items()
        ]
        # Rounding in the last cumulative sum must not lose q = 1.
        aggs = [F.coalesce(a, F.max(value).cast("double")).alias(n) for a, n in zip(aggs, probs)]
        return rt.groupBy(*keys).agg(*aggs)

    first = F.min_by(F.col(weight).cast("double"), F.col(tie)) if tie else F.min(F.col(weight).cast("double"))
    rt = running_totals(ok, keys, value, sums, extra={"_w1": first}, max_group=max_group)
    rt = rt.withColumn("_before", F.col("_w_cum") - F.col("_w"))
    aggs = [F.max(value).alias("_max")]
    for i, q in enumerate(probs.values()):
        target = F.lit(float(q)) * F.col("_w_all")
        aggs += [
            F.max(F.when(F.col("_w_cum") < target, F.col(value))).alias(f"_l{i}"),
            F.min(
                F.when(F.col("_w_cum") >= target, F.struct(value, "_before", "_w1", target.alias("_t")))
            ).alias(f"_h{i}"),
        ]
    picked = rt.groupBy(*keys).agg(*aggs)
    out = []
    for i, n in enumerate(probs):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        gain = high["_t"] - high["_before"]
        slope = (high[value] - low) / high["_w1"]
        inside = F.when(low.isNull() | (gain >= high["_w1"]), high[value]).otherwise(low + gain * slope)
        out.append(F.coalesce(inside, F.col("_max")).cast("double").alias(n))
    return picked.select(*keys, *out)


def chunk_series(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    back: int = 0,
    ahead: int = 0,
    length: int | None = None,
    ties: Sequence[str] = (),
    max_group: int = MAX_GROUP,
) -> tuple[DataFrame, bool]:
    """Prepare row-neighbour windows: adds ``_chunk`` and ``_home``; also tells whether any series was cut.

    Window by (keys, _chunk) ordered by ``order`` and ``ties``, then keep ``_home`` rows. A small series is one chunk.
    A large one is cut every ``max_group`` rows, and each chunk also receives the ``back`` rows before it
    and the ``ahead`` rows after it, so lags and leads up to those distances are exact. ``length`` is the
    number of rows per series where the caller knows it (a calendar axis); it saves the size check.
    """
    known_small = length is not None and length <= max_group
    small, big = (df, None) if known_small else split_by_size(df, keys, order, max_group)
    small_out = small.withColumns({"_chunk": F.lit(0).cast("long"), "_home": F.lit(True)})
    if big is None:
        return small_out, False
    indexed = row_index(big.select(*df.columns), keys, order, ties, name="_i", max_group=max_group)
    place = F.col("_i") - F.lit(1)
    chunk = F.floor(place / F.lit(max_group)).cast("long")
    offset = place % F.lit(max_group)
    homes = F.array_compact(
        F.array(
            chunk,
            F.when(F.lit(back > 0) & (offset >= F.lit(max_group - back)), chunk + F.lit(1)),
            F.when(F.lit(ahead > 0) & (offset < F.lit(ahead)) & (chunk > 0), chunk - F.lit(1)),
        )
    )
    big_out = (
        indexed.withColumn("_own", chunk)
        .withColumn("_chunk", F.explode(homes))
        .withColumn("_home", F.col("_chunk") == F.col("_own"))
    )
    cols = [*df.columns, "_chunk", "_home"]
    return small_out.select(*cols).unionByName(big_out.select(*cols)), True
