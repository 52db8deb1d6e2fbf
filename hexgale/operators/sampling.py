"""Presence and background samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.operators.ordered import MAX_GROUP, row_index
from hexgale.session import cut_lineage

# Share of background samples per distance bin (<= 1, <= 5, <= 20, > 20 km).
BIN_SHARES = [0.35, 0.30, 0.25, 0.10]
NEGATIVES_PER_POSITIVE = 10
NEAR_CAP = 1.5
BUFFER_KM = 1.0
BUFFER_DAYS = 32
SEED = 20251017


def positives(event_cells: DataFrame, forest: DataFrame, cell: str) -> DataFrame:
    """Event cells inside forest."""
    return event_cells.join(forest.select(cell).distinct(), cell, "left_semi")


def negative_quota(
    bin_sizes: DataFrame,
    n_negatives: Column | int,
    *,
    shares: Sequence[float] = tuple(BIN_SHARES),
    cap: float = NEAR_CAP,
) -> DataFrame:
    """Samples wanted per distance bin.

    ``bin_sizes`` has one row per bin (``dist_bin``, ``n_cells``). Whole parts first, the remainder one by
    one to the largest bins in turn, then bin 1 is capped and everything above the cap moves to bin 2.
    """
    n_bins = len(shares)
    total = F.lit(n_negatives) if isinstance(n_negatives, int) else n_negatives
    # One row per bin, also for empty ones: the table has a fixed number of rows.
    sizes = bin_sizes.groupBy().agg(
        *[F.coalesce(F.max(F.when(F.col("dist_bin") == i + 1, F.col("n_cells"))), F.lit(0)).alias(f"s{i}") for i in range(n_bins)]
    )
    share_sum = sum(shares)
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("dist_bin"), F.col(f"s{i}").alias("n_cells"), F.lit(shares[i] / share_sum).alias("share"))
            for i in range(n_bins)
        ]
    )
    table = sizes.select(F.explode(rows).alias("r")).select("r.*").withColumn("_t", total.cast("long"))
    # Shares such as 0.35 are not exact in binary, so products are rounded before the floor.
    table = table.withColumn("_base", F.floor(F.round(F.col("_t") * F.col("share"), 9)).cast("long"))
    whole = Window.partitionBy("_t")
    rest = F.col("_t") - F.sum("_base").over(whole)
    place = F.row_number().over(Window.partitionBy("_t").orderBy(F.col("n_cells").desc(), "dist_bin")) - 1
    extra = F.floor((rest - place + F.lit(n_bins - 1)) / F.lit(n_bins))
    table = table.withColumn("_want", (F.col("_base") + F.greatest(extra, F.lit(0))).cast("long"))
    first = F.max(F.when(F.col("dist_bin") == 1, F.struct("_want", "n_cells"))).over(whole)
    limit = F.floor(first["n_cells"] * F.lit(cap)).cast("long")
    over = F.greatest(first["_want"] - limit, F.lit(0))
    return table.withColumn(
        "n_target",
        F.when(F.col("dist_bin") == 1, F.col("_want") - over).when(F.col("dist_bin") == 2, F.col("_want") + over).otherwise(F.col("_want")),
    ).select("dist_bin", "n_cells", "n_target")


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) from a hash of keys: the same draw for the same row on every partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**52)) / F.lit(float(2**52))


def month_weighted_dates(positive_dates: DataFrame, day: str, calendar: DataFrame, date: str) -> DataFrame:
    """Candidate dates with cumulative probability limits from the months of the positives.

    One row per calendar date of the study period; months without positives get no weight, and all
    dates count alike if no month has any.
    """
    months = positive_dates.groupBy(F.month(day).alias("_m")).agg(F.count(F.lit(1)).alias("_w"))
    dates = calendar.select(F.col(date).alias("_d"), F.month(date).alias("_m")).join(months, "_m", "left")
    total = F.sum("_w").over(Window.partitionBy())
    dates = dates.withColumn("_w", F.when(total > 0, F.coalesce("_w", F.lit(0))).otherwise(F.lit(1)))
    upto = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    dates = dates.withColumns({"_hi": F.sum("_w").over(upto), "_all": F.sum("_w").over(Window.partitionBy())})
    return dates.where(F.col("_w") > 0).select(
        F.col("_d").alias("event_date"), ((F.col("_hi") - F.col("_w")) / F.col("_all")).alias("p_low"), (F.col("_hi") / F.col("_all")).alias("p_high")
    )


def draw_dates(rows: DataFrame, dates: DataFrame, u: str) -> DataFrame:
    """Date whose probability interval holds the uniform ``u``.

    Both sides are bucketed on [0, 1), so the lookup is an equi join. The list of dates is bounded by the
    calendar and is broadcast.
    """
    n = 1024
    first, last = F.floor(F.col("p_low") * n), F.least(F.floor(F.col("p_high") * n), F.lit(n - 1))
    table = dates.withColumn("_ub", F.explode(F.sequence(first, last)))
    return (
        rows.withColumn("_ub", F.floor(F.col(u) * n))
        .join(F.broadcast(table), "_ub")
        .where((F.col(u) >= F.col("p_low")) & (F.col(u) < F.col("p_high")))
        .drop("_ub", "p_low", "p_high")
    )


def accepted(dist_km: Column, event_date: Column, drawn: Column, *, km: float = BUFFER_KM, days: int = BUFFER_DAYS) -> Column:
    """Near an event dates within the buffer are rejected; elsewhere only the event's own date is."""
    near = F.coalesce(dist_km <= km, F.lit(False))
    apart = F.abs(F.date_diff(drawn, event_date))
    return F.when(event_date.isNull(), F.lit(True)).when(near, apart > days).otherwise(apart != 0)


def _take_per_bin(candidates: DataFrame, quota: DataFrame, by: str, order: str, ties: Sequence[str], max_group: int) -> DataFrame:
    """First ``n_target`` rows of each bin in hash order (F4). Bins are huge groups, so positions come from buckets."""
    placed = row_index(candidates, [by], order, ties, name="_pos", max_group=max_group)
    return placed.join(F.broadcast(quota), by).where(F.col("_pos") <= F.col("n_target")).drop("_pos")


def stratified_negatives(
    forest: DataFrame,
    quota: DataFrame,
    dates: DataFrame,
    *,
    cell: str,
    dist_km: str,
    own_date: str,
    oversample: float = 3.0,
    patience: int = 2,
    seed: int = SEED,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Background cells with dates: quota per distance bin, dates by month weight, rejections refilled.

    ``forest`` has the cell, ``dist_bin``, the distance and the date of an event in the cell, if any. Each
    cell is offered several times with independent draws, as often as the quota of its bin needs, and the
    accepted offers come in the order of their number, then by hash: no cell repeats while another one of its
    bin is unused. What a bin lacks comes from all forest cells, in turns with twice as many offers each.
    If ``patience`` turns with at least 64 offers per cell add nothing, there is no date left that could be
    accepted, and the number that is missing is an error.
    """
    columns = [cell, dist_km, own_date, "dist_bin"]
    need = F.col("n_target") / F.greatest(F.col("n_cells"), F.lit(1))
    copies = F.when(F.col("n_target") > 0, F.ceil(need * oversample)).otherwise(F.lit(0)).cast("int")
    offers = forest.select(*columns).join(F.broadcast(quota.withColumn("_copies", copies)), "dist_bin")
    offers = offers.where(F.col("_copies") > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies"))))

    def drawn(df: DataFrame, salt: int) -> DataFrame:
        base = df.withColumns(
            {"_u": uniform(seed + salt, F.col(cell), F.col("_k")), "_o": F.col("_k") + uniform(seed + salt + 1, F.col(cell), F.col("_k"))}
        )
        out = draw_dates(base, dates, "_u")
        return out.where(accepted(F.col(dist_km), F.col(own_date), F.col("event_date")))

    pool = drawn(offers.select(*columns, "_k"), 0)
    taken = cut_lineage(_take_per_bin(pool, quota, "dist_bin", "_o", [cell, "_k"], max_group).select(*columns, "event_date"))
    want = quota.agg(F.sum("n_target").alias("n")).first()["n"] or 0
    size, got = None, taken.count()
    turn, idle, offered = 0, 0, 1
    while got < int(want):
        size = forest.count() if size is None else size
        if size == 0 or idle >= patience:
            raise ValueError(f"{int(want) - got} of {int(want)} background samples cannot be placed")
        turn += 1
        short = int(want) - got
        copies_all = max(offered, -(-short * 3 // size))
        extra = forest.select(*columns).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies_all))))
        placed = row_index(drawn(extra, 10 * turn), [], "_o", [cell, "_k"], name="_pos", max_group=max_group)
        fill = placed.where(F.col("_pos") <= short).select(*columns, "event_date")
        taken = cut_lineage(taken.unionByName(fill))
        before, got = got, taken.count()
        idle = idle + 1 if got == before and copies_all >= 64 else 0
        offered = copies_all * 2
    return taken


def assemble(positive: DataFrame, negative: DataFrame, *, order: Sequence[str], max_group: int = MAX_GROUP) -> DataFrame:
    """Labelled samples with a running index, positives first."""
    both = positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)), allowMissingColumns=True)
    # Hash order inside each label: uniform values fill the position buckets evenly.
    place = both.withColumn("_h", uniform(SEED, *[F.col(c) for c in order]) - F.col("label"))
    return row_index(place, [], "_h", order, name="index", max_group=max_group).drop("_h")
