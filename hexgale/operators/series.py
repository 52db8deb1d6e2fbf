"""Regular series per cell and their link to events."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.operators.ordered import MAX_GROUP, chunk_series, finite, running_totals

MIN_VALUES = 30
HARMONICS = 3
PERIODS_PER_YEAR = 23
LOOKBACK_DAYS = 32


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys both sides have."""
    return left.select(key).intersect(right.select(key))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys one side lacks, with the side that lacks them."""
    a, b = left.select(key), right.select(key)
    return a.subtract(b).withColumn("missing_in", F.lit("right")).unionByName(
        b.subtract(a).withColumn("missing_in", F.lit("left"))
    )


def cover(main: DataFrame, supplement: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Main value, supplement where it is missing."""
    return (
        main.select(*keys, F.col(value).alias("_m"))
        .join(supplement.select(*keys, F.col(value).alias("_s")), list(keys), "full")
        .select(*keys, F.coalesce("_m", "_s").alias(value), F.col("_m").isNull().alias("from_supplement"))
    )


def dense_positions(df: DataFrame, keys: Sequence[str], position: str, n: int, value: str) -> DataFrame:
    """Every series on positions 1..n, missing values NULL; a position outside the axis fails the job."""
    outside = ~F.col(position).between(1, n)
    checked = F.when(outside, F.raise_error(F.concat(F.lit(f"position outside 1..{n}: "), F.col(position).cast("string")))).otherwise(F.col(position))
    df = df.withColumn(position, checked.cast(df.schema[position].dataType))
    axis = df.select(*keys).distinct().withColumn(position, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return axis.join(df.select(*keys, position, value), [*keys, position], "left")


def spike_clamp(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    *,
    name: str = "clamped",
    absolute: float = 0.2,
    relative: float = 0.10,
    back: float = 0.05,
    length: int | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Limit one-step drops below the median of the three values before that recover at the next step.

    Not recursive: baselines use the original values.
    """
    parts, _ = chunk_series(df, keys, position, back=3, ahead=1, length=length, max_group=max_group)
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    v = F.col(value)
    previous = [F.lag(value, k).over(w) for k in (1, 2, 3)]
    parts = parts.withColumns(
        {"_pre": F.array_sort(F.array_compact(F.array(*previous))), "_next": F.lead(value).over(w),
         "_third": F.lag(F.lit(1), 3).over(w)}
    )
    n = F.size("_pre")
    low, high = F.element_at("_pre", F.floor((n + 1) / 2).cast("int")), F.element_at("_pre", F.ceil((n + 1) / 2).cast("int"))
    base = F.when(n > 0, (low + high) / 2)
    parts = parts.withColumn("_base", base)
    floor = F.col("_base") - F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.col("_base"), F.lit(0.0)))
    spike = F.col("_third").isNotNull() & (v < floor) & (F.col("_next") >= F.col("_base") - F.lit(back))
    return (
        parts.withColumn(name, F.when(spike, floor).otherwise(v))
        .where("_home")
        .drop("_pre", "_next", "_third", "_base", "_chunk", "_home")
    )


def gap_fill(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    *,
    name: str = "filled",
    min_values: int = MIN_VALUES,
    length: int | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Linear interpolation over the position, ends held constant; short series give no rows."""
    enough = df.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") >= min_values).select(*keys)
    parts, cut = chunk_series(df.join(enough, list(keys), "left_semi"), keys, position, length=length, max_group=max_group)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    parts = parts.withColumn("_k", known)
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    parts = parts.withColumns(
        {
            "_a": F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_b": F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    if cut:
        # Values next to a cut come from neighbouring chunks: one small row per chunk.
        ends = parts.groupBy(*keys, "_chunk").agg(F.max("_k").alias("_l"), F.min("_k").alias("_f"))
        c = Window.partitionBy(*keys).orderBy("_chunk")
        ends = ends.select(
            *keys,
            "_chunk",
            F.last("_l", ignorenulls=True).over(c.rowsBetween(Window.unboundedPreceding, -1)).alias("_pl"),
            F.first("_f", ignorenulls=True).over(c.rowsBetween(1, Window.unboundedFollowing)).alias("_nf"),
        )
        parts = parts.join(ends, [*keys, "_chunk"]).withColumns(
            {"_a": F.coalesce("_a", "_pl"), "_b": F.coalesce("_b", "_nf")}
        )
    a, b, p = F.col("_a"), F.col("_b"), F.col(position)
    share = (p - a["p"]) / (b["p"] - a["p"])
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(a.isNull(), b["v"])
        .when(b.isNull(), a["v"])
        .otherwise(a["v"] + (b["v"] - a["v"]) * share)
    )
    return parts.select(*df.columns, filled.alias(name))


def harmonic_basis(position: Column, order: int = HARMONICS, period: int = PERIODS_PER_YEAR) -> list[Column]:
    """1, sines, cosines of the harmonic regression."""
    angle = [F.lit(2 * math.pi * k / period) * position for k in range(1, order + 1)]
    return [F.lit(1.0), *[F.sin(a) for a in angle], *[F.cos(a) for a in angle]]


def harmonic_inverse(n: int, order: int = HARMONICS, period: int = PERIODS_PER_YEAR) -> np.ndarray:
    """(X'X)^-1 of the design all series share: a (2*order+1)-square parameter matrix."""
    t = np.arange(1, n + 1)
    cols = [np.ones(n)]
    cols += [np.sin(2 * np.pi * k / period * t) for k in range(1, order + 1)]
    cols += [np.cos(2 * np.pi * k / period * t) for k in range(1, order + 1)]
    x = np.column_stack(cols)
    return np.linalg.inv(x.T @ x)


def harmonic_residual(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    n: int,
    *,
    name: str = "residual",
    order: int = HARMONICS,
    period: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """Residual of the harmonic least-squares fit of complete series on positions 1..n.

    X'y is one aggregate per series, multiplied by constant literals and joined back; no window and no
    per-series Python.
    """
    inverse = harmonic_inverse(n, order, period)
    basis = harmonic_basis(F.col(position), order, period)
    y = F.col(value)
    moments = df.groupBy(*keys).agg(*[F.sum(b * y).alias(f"_m{i}") for i, b in enumerate(basis)])
    size = len(basis)
    beta = moments.select(
        *keys,
        *[sum((F.lit(float(inverse[j, i])) * F.col(f"_m{i}") for i in range(size)), F.lit(0.0)).alias(f"_b{j}") for j in range(size)],
    )
    fit = sum((F.col(f"_b{j}") * b for j, b in enumerate(basis)), F.lit(0.0))
    return df.join(beta, list(keys)).withColumn(name, y - fit).drop(*[f"_b{j}" for j in range(size)])


#: Positions of an axis up to which a series is handled as one array.
LONGEST = 20_000


def series_arrays(
    df: DataFrame, keys: Sequence[str], position: str, value: str, n: int, *, absolute: float = 0.2, relative: float = 0.10, back: float = 0.05,
    min_values: int = MIN_VALUES, order: int = HARMONICS, period: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """Clamp, gap fill and harmonic residual of each series in one stage (E8, E9, E10): a row of arrays per series.

    Columns: keys and the arrays ``clamped``, ``filled`` and ``residual`` over positions 1..n; series with fewer than
    ``min_values`` values have NULL in the last two. Rows are shuffled once, by series; every step after that is an
    array function. An axis (a calendar) has at most ``LONGEST`` positions; :func:`spike_clamp`, :func:`gap_fill` and
    :func:`harmonic_residual` do the same row by row for longer ones. A position outside the axis fails the job.
    """
    if n > LONGEST:
        raise ValueError(f"an axis of {n} positions is too long for one array per series")
    # In order, with the gaps between neighbours and at the ends as NULLs.
    own = F.array_sort(F.collect_list(F.struct(F.col(position).cast("int").alias("p"), F.col(value).cast("double").alias("v"))))
    rows = df.groupBy(*keys).agg(own.alias("_o"))
    outside = (F.col("_o")[0]["p"] < 1) | (F.element_at("_o", -1)["p"] > n)
    rows = rows.withColumn("_o", F.when(outside, F.raise_error(F.lit(f"position outside 1..{n}"))).otherwise(F.col("_o")))
    nothing = F.lit(None).cast("double")
    ends = F.concat(F.transform(F.slice("_o", 2, n), lambda o: o["p"]), F.array(F.lit(n + 1)))
    dense = F.zip_with("_o", ends, lambda o, end: F.concat(F.array(o["v"]), F.array_repeat(nothing, end - o["p"] - 1)))
    rows = rows.withColumn("_y", F.concat(F.array_repeat(nothing, F.col("_o")[0]["p"] - 1), F.flatten(dense)))

    def clamp(v: Column, i: Column) -> Column:
        before = F.array_sort(F.array_compact(F.array(*[F.get("_y", i - k) for k in (1, 2, 3)])))
        known = F.size(before)
        low, high = F.get(before, F.floor((known - 1) / 2).cast("int")), F.get(before, F.ceil((known - 1) / 2).cast("int"))
        base = (low + high) / 2
        floor = base - F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(base, F.lit(0.0)))
        return F.when((i >= 3) & (v < floor) & (F.get("_y", i + 1) >= base - F.lit(back)), floor).otherwise(v)

    rows = rows.withColumn("clamped", F.transform("_y", clamp))
    points = F.transform("clamped", lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    rows = rows.withColumn("_k", F.filter(points, lambda k: k["v"].isNotNull()))

    def line(a: Column, b: Column) -> Column:
        """From a known value up to the place before the next one."""
        share = lambda i: (i - a["i"]) / (b["i"] - a["i"])
        return F.transform(F.sequence(a["i"], b["i"] - 1), lambda i: a["v"] + (b["v"] - a["v"]) * share(i))

    first, last, count = F.col("_k")[0], F.element_at("_k", -1), F.size("_k")
    lines = F.zip_with(F.slice("_k", 1, count - 1), F.slice("_k", 2, count - 1), line)
    filled = F.concat(F.array_repeat(first["v"], first["i"]), F.flatten(lines), F.array_repeat(last["v"], F.lit(n) - last["i"]))
    rows = rows.withColumn("filled", F.when(count >= max(min_values, 2), filled))
    inverse, size = harmonic_inverse(n, order, period), 2 * order + 1

    def moment(j: int) -> Column:
        parts = F.transform("filled", lambda v, i: v * harmonic_basis(i + 1, order, period)[j])
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    rows = rows.withColumn("_m", F.array(*[moment(j) for j in range(size)]))
    beta = [sum((F.lit(float(inverse[j, i])) * F.col("_m")[i] for i in range(size)), F.lit(0.0)) for j in range(size)]
    rows = rows.withColumn("_b", F.array(*beta))

    def residual(v: Column, i: Column) -> Column:
        return v - sum((F.col("_b")[j] * b for j, b in enumerate(harmonic_basis(i + 1, order, period))), F.lit(0.0))

    return rows.withColumn("residual", F.transform("filled", residual)).select(*keys, "clamped", "filled", "residual")


def series_rows(arrays: DataFrame, keys: Sequence[str], names: Sequence[str], position: str = "pos") -> DataFrame:
    """One row per position of series that have all of the named arrays."""
    # A filter on the arrays would be computed a second time below; a NULL position tells the same.
    rows = arrays.select(*keys, F.posexplode_outer(F.arrays_zip(*names)).alias("_i", "_z")).where("_i IS NOT NULL")
    return rows.select(*keys, (F.col("_i") + 1).alias(position), *[f"_z.{c}" for c in names])


def array_window_mean(events: DataFrame, arrays: DataFrame, cell: str, index: str, value: str, *, half: int = 1) -> DataFrame:
    """Mean of an array's values in the positions around each event (E11): one join by series, no row per position."""
    joined = events.join(arrays.select(cell, F.col(value).alias("_a")), cell, "left")
    low, high = F.greatest(F.col(index) - half, F.lit(1)), F.least(F.col(index) + half, F.size("_a"))
    near = F.when(low <= high, F.array_compact(F.slice("_a", low.cast("int"), (high - low + 1).cast("int"))))
    total = F.aggregate(near, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(near) > 0, total / F.size(near))
    flag = F.when(F.col("mag").isNotNull(), F.lit("step2")).otherwise(F.lit("step3"))
    return joined.withColumn("mag", mean).withColumn("step_flag", flag).drop("_a")


def layer_calendar(layers: DataFrame, layer: str) -> DataFrame:
    """Nearest layer for each day of the layers' date range, the earlier one at equal distance.

    At most one row per calendar day, so its size is bounded by the length of the record.
    """
    dates = layers.select(F.col(layer).alias("_layer")).where(F.col("_layer").isNotNull()).distinct()
    span = dates.agg(F.min("_layer").alias("s"), F.max("_layer").alias("e"))
    days = span.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("_day"))
    both = days.join(dates, F.col("_day") == F.col("_layer"), "left")
    w = Window.orderBy("_day")  # calendar days only
    both = both.withColumns(
        {
            "_p": F.last("_layer", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.first("_layer", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "_i": F.count("_layer").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    later = F.date_diff("_n", "_day") < F.date_diff("_day", "_p")
    return both.select(
        "_day",
        F.when(later, F.col("_n")).otherwise(F.col("_p")).alias("layer_date"),
        F.when(later, F.col("_i") + 1).otherwise(F.col("_i")).cast("int").alias("layer_index"),
    )


def nearest_layer(events: DataFrame, day: str, layers: DataFrame, layer: str) -> DataFrame:
    """Layer with the smallest day distance for each event (C10): an equi join on the day."""
    calendar = layer_calendar(layers, layer)
    first, last = calendar.agg(F.min("_day").alias("d")).scalar(), calendar.agg(F.max("_day").alias("d")).scalar()
    inside = F.when(F.col(day).isNotNull(), F.least(F.greatest(F.col(day), first), last))
    return events.withColumn("_day", inside).join(F.broadcast(calendar), "_day", "left").drop("_day")


def event_window_mean(
    events: DataFrame, residuals: DataFrame, cell: str, index: str, position: str, value: str, *, half: int = 1
) -> DataFrame:
    """Mean residual in the layers around the event layer (E11): positions exploded, then an equi join."""
    window = F.sequence(F.col(index) - half, F.col(index) + half)
    near = events.select("*", F.explode(window).alias(position))
    joined = near.join(residuals.select(cell, position, value), [cell, position])
    keys = events.columns
    found = joined.groupBy(*keys).agg(F.avg(value).alias("mag"))
    flag = F.when(F.col("mag").isNotNull(), F.lit("step2")).otherwise(F.lit("step3"))
    return events.join(found, keys, "left").withColumn("step_flag", flag)


def lookback_peak(
    samples: DataFrame,
    obs: DataFrame,
    *,
    sample: str,
    cell: str,
    event_day: str,
    obs_day: str,
    value: str,
    direction: str,
    days: int = LOOKBACK_DAYS,
    percentile: bool = True,
    digits: int | None = 2,
    direction_digits: int = 1,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Peak of a cell's series in the ``days`` before an event, its age, direction and percentile.

    The range condition becomes an equi join: observations fall in ``days``-long buckets and each window
    meets two of them. Observations are first reduced to the peak of each cell and day, so a window
    matches at most days + 1 rows whatever the number of observations. The percentile needs no pairs at
    all: history at or below the peak is the cumulative count of the cell at the peak value minus the
    window's own rows (T7).
    """
    known = obs.where(finite(value))
    daily = known.groupBy(cell, F.col(obs_day).alias("_od")).agg(
        F.max_by(F.struct(F.col(value).alias("v"), F.col(direction).alias("dir")), F.struct(F.col(value), -F.col(direction))).alias("_o"),
        F.count(F.lit(1)).alias("_c"),
    )
    epoch = F.lit("1970-01-01").cast("date")

    def bucket(c: Column) -> Column:
        return F.floor(F.date_diff(c, epoch) / F.lit(days)).cast("long")

    daily = daily.withColumn("_bk", bucket(F.col("_od")))
    event = F.col(event_day)
    windows = samples.select(sample, cell, event.alias("_ev")).withColumn(
        "_bk", F.explode(F.array_distinct(F.array(bucket(F.date_sub("_ev", days)), bucket(F.col("_ev")))))
    )
    hits = windows.join(daily, [cell, "_bk"]).where(F.col("_od").between(F.date_sub("_ev", days), F.col("_ev")))
    peak = hits.groupBy(sample, cell, "_ev").agg(
        F.max_by(F.struct(F.col("_o.v").alias("v"), F.col("_o.dir").alias("dir"), F.col("_od").alias("d")),
                 F.struct(F.col("_o.v"), -F.date_diff(F.col("_od"), epoch))).alias("_p"),
        F.sum("_c").alias("n_window"),
    )
    out = peak.select(
        sample,
        cell,
        F.col("_p.v").alias("max_wind_event"),
        F.date_diff("_ev", F.col("_p.d")).cast("double").alias("days_since_peak"),
        F.round("_p.dir", direction_digits).alias("struct_wind_dir_from_deg"),
        "n_window",
    )
    if percentile:
        below = running_totals(known, [cell], value, {"n": F.count(F.lit(1))}, max_group=max_group).select(
            cell, F.col(value).alias("max_wind_event"), F.col("n_cum").alias("_below"), F.col("n_all").alias("_all_n")
        )
        share = F.try_divide(F.col("_below") - F.col("n_window"), F.col("_all_n") - F.col("n_window")) * 100
        share = share if digits is None else F.round(share, digits)
        out = out.join(below, [cell, "max_wind_event"]).withColumn("wind_percentile", share).drop("_below", "_all_n")
    return samples.select(sample, cell).join(out, [sample, cell], "left")
