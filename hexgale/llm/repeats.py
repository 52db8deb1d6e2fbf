"""Removal of long repeats by a run-length index.

A string of ``length`` bytes that starts at two places chooses the same anchor at both: the smallest k-gram hash inside it.
So the bytes around equal anchors (their contexts) are all that has to be compared, and anchors divide the work. Contexts
that occur twice as a whole need no comparison. The others, one of each kind, are indexed per lot: a Burrows-Wheeler
transform kept by its runs, with suffix positions sampled at both ends of every run. The longest match elsewhere is compared
at sampled positions only and streamed along the text from one to the next (between samples it shrinks by one per byte),
which gives the matching statistics of every position; those of ``length`` or more are the repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexgale.llm.common import partitions, pick, release, store
from hexgale.llm.fingerprints import BLOCK, _sliding_min, rolling
from hexgale.session import cut_lineage

LENGTH, GRAM = 200, 16
#: Bytes indexed together.
LOT = 1 << 21


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the anchor of every window, and the first and last window start that have chosen it."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.uint64((1 << 21) - 1)
    chosen, values = [], []
    for at in range(0, n - length + 1, BLOCK - length + 1):
        h = rolling(data[at : at + BLOCK], k)
        least = _sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), length - k + 1)
        place = (low - (least & low)).astype(np.int64)
        chosen.append(place + at)
        values.append(h[place])
    place, value = np.concatenate(chosen), np.concatenate(values)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    return value[first], first, np.append(first[1:], len(place)) - 1


def suffix_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, bytes, end of each position's part, its first 8 bytes as a number) of the joined parts.

    Prefix doubling over ranks; only positions that still tie are sorted again. A suffix ends with its part; ties are then
    broken by the number of the part, as unique terminators would.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    small = np.int32 if n < 2**30 else np.int64
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes).astype(small), sizes)
    owner = np.repeat(np.arange(len(parts), dtype=small), sizes)
    left = ends - np.arange(n, dtype=small)
    padded = np.append(data, np.zeros(8, np.uint8))
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").reshape(-1).astype(np.uint64)
    near = np.flatnonzero(left < 8)  # what follows a part's end is no byte of it
    key[near] &= ~((np.uint64(1) << (8 * (8 - left[near])).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(key)
    ordered = key[order]
    start = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, dtype=small)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n, dtype=small), 0))
    active = order[~(start & np.append(start[1:], True))].astype(small)  # group by group, so that the next sorts find them in order
    del left, near, order, ordered, start
    h, span = 8, n + len(parts) + 1
    while len(active):
        ahead = active + h
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + len(parts), owner[active])
        both = rank[active].astype(np.int64) * span + second
        del ahead, second
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        del order
        group = rank[active]
        head = np.concatenate(([True], group[1:] != group[:-1]))
        sub = np.concatenate(([True], both[1:] != both[:-1]))
        del both
        k = np.arange(len(active), dtype=small)
        rank[active] = group + np.maximum.accumulate(np.where(sub, k, 0)) - np.maximum.accumulate(np.where(head, k, 0))
        active = active[~(sub & np.append(sub[1:], True))]
        h *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, data, ends.astype(np.int64), key


def _common(a: np.ndarray, b: np.ndarray, ends: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, each within its part."""
    out = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(ends[a] - a, ends[b] - b)
    live = np.arange(len(a))
    while len(live):
        x = key[a[live] + out[live]] ^ key[b[live] + out[live]]
        same = x == 0
        rest = live[~same]
        if len(rest):
            bits = np.frexp(x[~same].astype(np.float64))[1]
            # frexp may round up to the next power of two; the highest set byte is checked against the value itself.
            top = (bits - 1) // 8
            top -= (x[~same] >> (top * 8).astype(np.uint64)) == 0
            out[rest] += 7 - top
        live = live[same]
        out[live] += 8
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


def matching_statistics(parts: list[bytes]) -> np.ndarray:
    """Longest match of each position of the joined parts with any other position, from the run-compressed index."""
    suffixes, data, ends, key = suffix_order(parts)
    n = len(suffixes)
    first = np.zeros(n, dtype=bool)
    first[np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))] = True
    # The transform: the byte before each suffix; a part's first position has none and is a run of its own.
    before = np.where(first, -1, np.append(0, data[:-1]).astype(np.int64))[suffixes]
    edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)) + 1
    heads, tails = suffixes[edge], suffixes[edge - 1]  # the sampled ends of runs
    match = _common(tails, heads, ends, key)
    reach = np.zeros((2, n), dtype=np.int64)
    reach[0, heads] = heads + match
    reach[1, tails] = tails + match
    # Streaming: a sample's match holds on, one byte shorter per step, until a later sample reaches further.
    starts = np.flatnonzero(first)
    bounded = np.maximum.accumulate(np.maximum(reach, 0), axis=1).max(axis=0)
    own = np.repeat(starts, np.diff(np.append(starts, n)))
    return np.where(bounded > own, bounded - np.arange(n), 0).clip(0)


def repeated_starts(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Runs (first, last) of window starts whose ``length`` bytes also start at another place, for each part."""
    if not parts:
        return []
    hit = matching_statistics(parts) >= length
    out, at = [], 0
    for p in parts:
        x = np.diff(np.concatenate(([0], hit[at : at + len(p)].view(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(x == 1).tolist(), (np.flatnonzero(x == -1) - 1).tolist())))
        at += len(p)
    return out



def _occurrences(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, context, m, places): what a lot of texts has of each anchor with each context; equal ones are combined here."""

    def run(batches):
        for b in batches:
            values, texts, keys, lows, highs = [], [], [], [], []
            for value in b.column(0):
                raw = value.as_py().encode()
                v, lo, hi = anchors(np.frombuffer(raw, np.uint8), length, k)
                if not len(v):
                    continue
                values.append(v)
                lows.append(lo)
                highs.append(hi)
                texts.append(np.fromiter((xxhash.xxh3_64_intdigest(raw[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist())), np.uint64, len(v)))
                key = np.empty(len(v), "V16")
                key[:] = np.void(hashlib.md5(raw).digest())
                keys.append(key)
            if not values:
                continue
            value, text, key, lo, hi = (np.concatenate(x) for x in (values, texts, keys, lows, highs))
            order = np.lexsort((text, value))
            value, text = value[order], text[order]
            rows_ = np.empty(len(order), [("key", "V16"), ("lo", "<i4"), ("hi", "<i4")])
            rows_["key"], rows_["lo"], rows_["hi"] = key[order], lo[order], hi[order]
            cut = np.flatnonzero((value[1:] != value[:-1]) | (text[1:] != text[:-1])) + 1
            begin, end = np.concatenate(([0], cut)), np.append(cut, len(value))
            blob, size = rows_.tobytes(), rows_.dtype.itemsize
            places = []
            for x, y in zip(begin.tolist(), end.tolist()):
                part = blob[x * size : y * size]
                # Copies of a text name the same place; it is kept once, the number counts them all.
                places.append(part if y - x == 1 else b"".join(dict.fromkeys(part[j : j + size] for j in range(0, len(part), size))))
            yield pa.RecordBatch.from_arrays([pa.array(value[begin].view(np.int64)), pa.array(text[begin].view(np.int64)), pa.array((end - begin).astype(np.int32)), pa.array(places, pa.binary())], names=["anchor", "context", "m", "places"])

    return rows.select("text").mapInArrow(run, "anchor long, context long, m int, places binary")


def _places(shared: DataFrame) -> DataFrame:
    """One row per place: whole = its context occurs twice; open = it must be compared; ship = it stands for its kind."""

    def run(batches):
        for b in batches:
            anchor, context, twice, mixed, lead = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            blobs = b.column(5).to_pylist()
            count = np.array([len(x) // 24 for x in blobs])
            at = np.repeat(np.arange(len(blobs)), count)
            p = np.frombuffer(b"".join(blobs), [("key", "V16"), ("lo", "<i4"), ("hi", "<i4")])
            head = np.zeros(len(p), dtype=bool)
            head[np.cumsum(count) - count] = True
            keys = [x.tobytes() for x in p["key"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(np.ascontiguousarray(p["lo"])), pa.array(np.ascontiguousarray(p["hi"])), pa.array(anchor[at]), pa.array(twice[at]), pa.array((~twice & mixed)[at]), pa.array((mixed & lead)[at] & head)],
                names=["key", "lo", "hi", "anchor", "whole", "open", "ship"],
            )

    return shared.mapInArrow(run, "key binary, lo int, hi int, anchor long, whole boolean, open boolean, ship boolean")


def _index(contexts: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi): runs of repeated window starts of the open contexts, from an index per lot of anchors."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            found = repeated_starts([x[4] for x in held], length)
            out = [(x[1], x[2] + a, x[2] + z) for x, runs in zip(held, found) if x[3] for a, z in runs]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["key", "lo", "hi"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= LOT and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flush()

    dealt = contexts.select("anchor", "key", "lo", "open", "bytes").repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "key binary, lo int, hi int")


def _cut(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, number of removed runs and the runs themselves, from runs of repeated window starts."""
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    return sum(z - a for a, z in spans), len(spans), [(a, z) for a, z in spans]


def _place_lists(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, places) of every text that shares an anchor with another place."""
    spark = rows.sparkSession
    seen = _occurrences(rows, length, gram).repartition(partitions(spark), "anchor")
    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    flagged = seen.select(
        "*",
        F.sum("m").over(by_anchor).alias("total"),
        (F.min("context").over(by_anchor) != F.max("context").over(by_anchor)).alias("mixed"),
        (F.sum("m").over(by_context) > 1).alias("twice"),
        (F.row_number().over(by_context.orderBy("places")) == 1).alias("lead"),
    ).where("total > 1")
    flagged = flagged.select("anchor", "context", "twice", "mixed", "lead", "places")
    place = F.struct("lo", "hi", "anchor", "whole", "open", "ship")
    # One text can name at most as many places as it has anchors, whatever the number of its copies.
    return store(_places(flagged).groupBy("key").agg(F.collect_set(place).alias("places")))


def _decide(docs: DataFrame, length: int, gram: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents with the key of their text, results by key of the texts that share an anchor with another place)."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = rows.sparkSession
    key = F.unhex(F.md5(F.col("text")))
    base = rows.select("doc_id", key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    base = cut_lineage(base)

    lists = _place_lists(rows, length, gram)
    release(spark)
    first = base.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    wanted = lists.join(first, "key")
    texts = rows.withColumn("key", key).alias("t").join(wanted.alias("w"), (F.col("t.doc_id").eqNullSafe(F.col("w.first_id"))) & (F.col("t.key") == F.col("w.key"))).select("w.key", "text", "places")

    def read(batches):
        """Texts without open places are finished here; of the others the text, and of shipped places the bytes, go on."""
        for b in batches:
            out = {c: [] for c in ("key", "removed", "spans_n", "sha", "spans", "text", "wholes", "ships")}
            for k, t, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode()
                wholes = [(p["lo"], p["hi"]) for p in listed if p["whole"]]
                ships = [{"anchor": p["anchor"], "lo": p["lo"], "open": p["open"], "bytes": raw[p["lo"] : p["hi"] + length]} for p in listed if p["ship"]]
                waits = any(p["open"] for p in listed)
                _finish(out, k, raw, wholes, ships, waits, length, t)
            yield _finished_batch(out)

    read_ = store(texts.mapInArrow(read, _READ))
    del texts, wanted, lists
    release(spark)
    contexts = read_.where(F.size("ships") > 0).select("key", F.explode("ships").alias("s")).select("s.anchor", "key", "s.lo", "s.open", "s.bytes")
    found = _index(contexts, length).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    waiting = read_.where("text is not null").select("key", "text", "wholes").join(found, "key", "left")

    def close(batches):
        for b in batches:
            out = {c: [] for c in ("key", "removed", "spans_n", "sha", "spans", "text", "wholes", "ships")}
            for k, t, wholes, more in zip(*(c.to_pylist() for c in b.columns)):
                runs = [(p["lo"], p["hi"]) for p in [*wholes, *(more or [])]]
                _finish(out, k, t.encode(), runs, [], False, length, t)
            yield _finished_batch(out)

    done = read_.where("text is null").unionByName(waiting.mapInArrow(close, _READ)).select("key", "removed", "spans_n", "sha", "spans")
    return base, done.dropDuplicates(["key"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): every byte covered by a repeated string is removed.

    A string of ``length`` bytes counts if it starts at any other place too, in the same or another text, overlaps included;
    all is judged on the input. Texts are UTF-8 bytes, NULL is empty, matches never cross texts. ``spans`` holds the removed
    byte ranges (start, end). NULL and repeated ids, and repeated rows (which are copies of each other) give one row each;
    an empty table gives an empty result; other columns are left out. A very long text goes block by block.

    Scale: anchors are some 2 in 186 bytes; equal ones are combined before the shuffle, so a text or passage with very
    many copies is a few rows per map task. Texts are shuffled once for those with shared anchors, and once more for
    those with contexts that had to be compared. The input is read three times and has to be a stable table.
    """
    base, done = _decide(docs, length, gram, doc_id, text)
    joined = base.join(done, "key", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans_n", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of the text; what a cut leaves of a character that it splits goes as well.

    All columns and rows stay; NULL text stays NULL. See ``remove_repeats``.
    """
    _, done = _decide(docs, length, gram, doc_id, text)
    spans = done.where("removed > 0").select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    rows = docs.drop("__spans")
    joined = rows.withColumn("__key", F.unhex(F.md5(F.col(text)))).join(spans, "__key", "left").select(*rows.columns, "__spans")
    names = rows.columns
    at = names.index(text)

    def run(batches):
        for b in batches:
            out = []
            for value, cuts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if cuts:
                    raw, kept, last = value.encode(), [], 0
                    for span in cuts:
                        kept.append(raw[last : span["start"]])
                        last = span["end"]
                    value = b"".join([*kept, raw[last:]]).decode("utf-8", "ignore")
                out.append(value)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, rows.schema)


_READ = "key binary, removed long, spans_n long, sha string, spans array<struct<start:int,end:int>>, text string, wholes array<struct<lo:int,hi:int>>, ships array<struct<anchor:bigint,lo:int,open:boolean,bytes:binary>>"


def _finish(out: dict, key: bytes, raw: bytes, wholes, ships, waits: bool, length: int, text: str) -> None:
    removed, n, spans = _cut(raw, wholes, length)
    sha = hashlib.sha256()
    at = 0
    for a, z in spans:
        sha.update(raw[at:a])
        at = z
    sha.update(raw[at:])
    out["key"].append(key)
    out["removed"].append(None if waits else removed)
    out["spans_n"].append(None if waits else n)
    out["sha"].append(None if waits else sha.hexdigest())
    out["spans"].append(None if waits else [{"start": a, "end": z} for a, z in spans])
    out["text"].append(text if waits else None)
    out["wholes"].append([{"lo": a, "hi": z} for a, z in wholes] if waits else [])
    out["ships"].append(ships)


def _finished_batch(out: dict) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    run = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    ship = pa.list_(pa.struct([("anchor", pa.int64()), ("lo", pa.int32()), ("open", pa.bool_()), ("bytes", pa.binary())]))
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), span, pa.string(), run, ship]
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, kinds)], names=list(out))
