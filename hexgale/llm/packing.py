"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt evenly over shards of bounded size. A shard is packed by best fit (longest piece first) and its underfull
bins are improved by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills until bins empty.
Full bins are final; pieces of underfull ones meet those of other shards in the next round, until one shard is left or a
round frees hardly any bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.session import cut_lineage

#: Pieces packed by one task call.
SHARD = 20_000
#: Bins with the most room that the local search of a shard works on.
LOT = 256
#: Exchanges tried per shard; bounds the search, not the result: every piece has a place before it starts.
STEPS = 1500
#: Bins beside the superfluous ones that may give pieces as well.
SPARE = 16


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece: longest first, into the open bin it fills best."""
    bins = np.empty(len(lengths), dtype=np.int64)
    free: list[int] = []  # sorted room of open bins
    at: dict[int, list[int]] = {}  # bins by room
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        k = bisect_left(free, need)
        if k < len(free):
            room = free.pop(k)
            b = at[room].pop()
        else:
            room, b = capacity, count
            count += 1
        bins[i] = b
        if room > need:
            insort(free, room - need)
            at.setdefault(room - need, []).append(b)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, steps: int = STEPS) -> np.ndarray:
    """Exchange pieces between the given bins while the sum of squared fills grows; returns bins, 0 .. n-1, without gaps.

    The emptiest bins give: a piece moves into another bin's room, replaces one smaller piece there, or replaces two
    smaller ones, whichever leaves the receiver fullest. What is taken back lands in the giving bin, which shrinks. Only as
    many bins give as the lower bound says are too many; the search ends when there are none, or nothing can be exchanged.
    """
    _, bins = np.unique(bins, return_inverse=True)
    lengths = lengths.astype(np.int64)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(fill.sum()) // capacity)
    for _ in range(steps):
        excess = int((fill > 0).sum()) - least
        if excess <= 0 or not _exchange(lengths, bins, fill, capacity, excess + SPARE):
            break
    return np.unique(bins, return_inverse=True)[1]


def _exchange(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int, givers: int) -> bool:
    """Make one improving exchange in place, from one of the emptiest bins; False if there is none."""
    room = capacity - fill
    order = np.argsort(fill, kind="stable")
    for giver in order[fill[order] > 0][:givers].tolist():
        # Receivers are at least as full as the giver, so every exchange raises the sum of squared fills.
        open_ = (fill >= fill[giver]) & (room > 0)
        open_[giver] = False
        own = np.flatnonzero(open_[bins])
        for x in sorted(np.flatnonzero(bins == giver).tolist(), key=lambda i: -lengths[i]):
            size, back, to = int(lengths[x]), (), None
            fits = np.flatnonzero(open_ & (room >= size))
            gain = size - lengths[own]
            swaps = own[(gain > 0) & (gain <= room[bins[own]])]
            if len(fits):
                to = int(fits[np.argmin(room[fits])])
            elif len(swaps):
                y = int(swaps[np.argmax(fill[bins[swaps]] + size - lengths[swaps])])
                to, back = int(bins[y]), (y,)
            else:
                to, back = _two_for_one(size, lengths, bins, own, room) or (None, ())
            if to is not None:
                gained = size - int(sum(lengths[list(back)]))
                bins[x] = to
                for y in back:
                    bins[y] = giver
                fill[to] += gained
                fill[giver] -= gained
                return True
    return False


def _two_for_one(size: int, lengths: np.ndarray, bins: np.ndarray, own: np.ndarray, room: np.ndarray):
    """Two pieces of one bin that together are smaller than ``size`` by at most that bin's room, the largest such gain."""
    small = own[lengths[own] < size]
    best, found = 0, None
    order = np.argsort(bins[small], kind="stable")
    small = small[order]
    edges = np.flatnonzero(np.diff(bins[small])) + 1
    for part in np.split(small, edges):
        if len(part) < 2:
            continue
        part = part[np.argsort(lengths[part], kind="stable")]
        values, r = lengths[part], int(room[bins[part[0]]])
        # For each first piece the smallest second one that keeps the gain within the room.
        second = np.searchsorted(values, size - r - values)
        second = np.maximum(second, np.arange(len(part)) + 1)
        ok = second < len(part)
        gain = np.where(ok, size - values - values[np.minimum(second, len(part) - 1)], -1)
        gain[gain > r] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = int(gain[k]), (int(bins[part[0]]), (int(part[k]), int(part[second[k]])))
    return found


def pack_shard(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit, then local search among the bins with the most room."""
    bins = best_fit(lengths, capacity)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    under = np.argsort(fill, kind="stable")[:LOT]
    chosen = np.flatnonzero(np.isin(bins, under[fill[under] < capacity]))
    if len(chosen):
        bins[chosen] = len(fill) + local_search(lengths[chosen], bins[chosen], capacity)
    return np.unique(bins, return_inverse=True)[1]


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, length: str = "length", shard: int = SHARD) -> DataFrame:
    """Add (sequence_id, offset) to every piece; no sequence holds more than ``capacity`` tokens.

    Pieces are numbered in a checkpoint first, so equal rows, NULL ids and groups of copies spread over the shards like any
    others, and a lost executor repeats the same packing. A NULL length counts as 0; a length over ``capacity`` raises.
    Empty input gives an empty result. All other columns stay, in their order; columns named sequence_id or offset are
    replaced. No piece is dropped. Only row counts reach the driver.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut_lineage(pieces.select(*kept, F.monotonically_increasing_id().alias("__row")))
    width = F.coalesce(F.col(length), F.lit(0)).cast("long")
    if not rows.where(width > capacity).isEmpty():
        raise ValueError(f"a piece is longer than {capacity}")
    left = rows.select("__row", width.alias("__size"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("__row", "__size", "sequence_id", "offset")] + [T.StructField("__open", T.BooleanType())])
    done, n, turn = [], left.count(), 0

    def packer(base: int, last: bool):

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__row", ignore_index=True)
            lengths = pdf["__size"].to_numpy()
            bins = pack_shard(lengths, capacity)
            fill = np.bincount(bins, weights=lengths)
            order = np.argsort(bins, kind="stable")
            total = np.cumsum(lengths[order]) - lengths[order]
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            offset = np.empty(len(pdf), dtype=np.int64)
            offset[order] = total - np.repeat(total[first], np.diff(np.append(first, len(pdf))))
            return pdf[["__row", "__size"]].assign(sequence_id=base + (int(key[0]) << 20) + bins, offset=offset, __open=(fill < capacity)[bins] & (not last))

        return pack

    while n:
        shards = -(-n // shard)
        dealt = left.withColumn("__shard", F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(shards)))
        packed = cut_lineage(dealt.groupBy("__shard").applyInPandas(packer(turn << 56, shards == 1), schema))
        rest = packed.where("__open").count()
        if rest > n // 2:  # other shards' leftovers would not fill these bins either
            done.append(packed)
            break
        done.append(packed.where("not __open"))
        left, n, turn = packed.where("__open").select("__row", "__size"), rest, turn + 1
    if not done:
        return rows.select(*kept, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    return rows.join(places.select("__row", "sequence_id", "offset"), "__row").select(*kept, "sequence_id", "offset")
