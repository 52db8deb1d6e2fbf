"""Exact Euclidean distance of every raster cell to the nearest positive cell (I9), by a separable transform.

Along rows the nearest positive of a cell lies in its own block of columns, or is the last one before or the first one
behind the block; a block therefore receives, per raster row, its own positives and those two. Along columns the squared
distance is the lower envelope of one parabola per raster row, swept for all columns of a block together. Work and memory
follow the raster: no search radius, no pairs of cells, and no task holds more than one block of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexgale.operators.grid import Raster

#: Cells of a block of columns.
CELLS = 2_000_000


def row_distances(inside: Sequence[Sequence[int]], before: np.ndarray, behind: np.ndarray, first: int, width: int) -> np.ndarray:
    """Columns to the nearest positive of its raster row, for each row of a block; ``inside`` lists are ascending."""
    column = np.arange(first, first + width, dtype=np.float64)
    out = np.minimum(column[None, :] - before[:, None], behind[:, None] - column[None, :])
    for i, own in enumerate(inside):
        if len(own):
            at = np.asarray(own, dtype=np.float64)
            k = np.searchsorted(at, column)
            left = np.where(k > 0, column - at[np.maximum(k - 1, 0)], np.inf)
            right = np.where(k < len(at), at[np.minimum(k, len(at) - 1)] - column, np.inf)
            out[i] = np.minimum(out[i], np.minimum(left, right))
    return out


def lower_envelope(heights: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """min over i of (wanted - places[i])**2 + heights[i], for each column of ``heights``; both axes ascend.

    Parabolas are pushed on one stack per column; all columns move together, and a parabola is popped at most once.
    """
    n, width = heights.shape
    stack = np.zeros((n, width), dtype=np.int64)
    start = np.full((n + 1, width), np.inf)
    top = np.zeros(width, dtype=np.int64)
    start[0] = -np.inf
    column = np.arange(width)
    for i in range(1, n):
        live = column
        while len(live):
            t = top[live]
            j = stack[t, live]
            meet = ((heights[i, live] + places[i] ** 2) - (heights[j, live] + places[j] ** 2)) / (2 * (places[i] - places[j]))
            pop = (meet <= start[t, live]) & (t > 0)
            keep = live[~pop]
            top[keep] += 1
            stack[top[keep], keep] = i
            start[top[keep], keep] = meet[~pop]
            live = live[pop]
            top[live] -= 1
    start[top + 1, column] = np.inf
    out = np.empty((len(wanted), width))
    at = np.zeros(width, dtype=np.int64)
    for r, y in enumerate(wanted):
        live = column[start[at + 1, column] < y]
        while len(live):
            at[live] += 1
            live = live[start[at[live] + 1, live] < y]
        j = stack[at, column]
        out[r] = (y - places[j]) ** 2 + heights[j, column]
    return out


def distance_raster(positives: DataFrame, shape: Raster, *, row: str = "row", col: str = "col", cells: int = CELLS) -> DataFrame:
    """(row, col, distance) for every cell of a raster, in units of its cell sides; NULL if there is no positive cell.

    ``positives``: cells by row and column, repeated or outside the raster ones do not matter.
    """
    inside = F.col(row).between(0, shape.rows - 1) & F.col(col).between(0, shape.cols - 1)
    hits = positives.where(inside).select(F.col(row).cast("int").alias("row"), F.col(col).cast("int").alias("col")).distinct()
    width = max(1, min(shape.cols, cells // max(1, shape.rows)))
    blocks = -(-shape.cols // width)
    own = hits.groupBy("row", F.floor(F.col("col") / width).cast("int").alias("block")).agg(F.sort_array(F.collect_list("col")).alias("cols"))
    rows = own.select("row").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    along = Window.partitionBy("row").orderBy("block")  # one entry per block of columns
    last = F.last(F.element_at("cols", -1), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    following = F.first(F.element_at("cols", 1), ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    packed = rows.join(own, ["row", "block"], "left").select("row", "block", "cols", last.cast("double").alias("before"), following.cast("double").alias("behind"))
    places = np.arange(shape.rows) * float(shape.dy)

    def sweep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * width
        n = min(width, shape.cols - first)
        pdf = pdf.sort_values("row", ignore_index=True)
        lists = [() if c is None else c for c in pdf["cols"]]
        before = pdf["before"].fillna(-np.inf).to_numpy(dtype=np.float64)
        behind = pdf["behind"].fillna(np.inf).to_numpy(dtype=np.float64)
        heights = (row_distances(lists, before, behind, first, n) * shape.dx) ** 2
        squares = lower_envelope(heights, places[pdf["row"].to_numpy()], places)
        at = np.indices(squares.shape)
        return pd.DataFrame({"row": at[0].ravel().astype("int32"), "col": (at[1].ravel() + first).astype("int32"), "distance": np.sqrt(squares).ravel()})

    found = packed.groupBy("block").applyInPandas(sweep, "row int, col int, distance double")
    # Without any positive cell there is no block: every cell has a NULL distance.
    every = hits.sparkSession.range(shape.rows * shape.cols).where(F.lit(hits.isEmpty()))
    bare = every.select(F.floor(F.col("id") / shape.cols).cast("int").alias("row"), (F.col("id") % shape.cols).cast("int").alias("col"), F.lit(None).cast("double").alias("distance"))
    return found.unionByName(bare)


def binned(distances: DataFrame, edges: Sequence[float], *, name: str = "dist_bin") -> DataFrame:
    """Number of the right-closed bin of each distance, the last bin open; cells without a distance are in the last."""
    number = F.lit(len(edges) + 1)
    for i in range(len(edges) - 1, -1, -1):
        number = F.when(F.col("distance") <= edges[i], F.lit(i + 1)).otherwise(number)
    return distances.withColumn(name, number)
