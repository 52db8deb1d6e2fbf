"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; in every window of ``window`` neighbouring hashes the smallest is chosen, the
rightmost of equal ones. Two texts that share ``window + k - 1`` code points in a row share a chosen hash (the guarantee),
and positions are kept, so a match can be located.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.llm.common import partitions, pick

#: Production parameters: a shared run of 39 code points is always seen.
K, WINDOW = 16, 24
#: Code points hashed at a time; longer texts go block by block with an overlap.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x2545F4914F6CDD1D
_UP = _powers(_BASE, BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k symbols: a polynomial taken as a difference of prefix sums, then mixed."""
    n = len(codes)
    x = (codes.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(31)
    x *= _MIX
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(x * _UP[:n], out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * _DOWN[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= _ODD
    return h ^ (h >> np.uint64(29))


def _sliding_min(key: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = window - width
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions. Shorter than k symbols: one hash of all of them; no symbol: nothing."""
    n = len(codes)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    k = min(k, n)
    hashes, places = [], []
    low, overlap = np.uint64((1 << 21) - 1), k + window - 2
    for at in range(0, max(1, n - overlap), BLOCK - overlap):
        h = rolling(codes[at : at + BLOCK], k)
        # Equal hashes: the rightmost wins, as its stored place counts down. 43 bits of the hash decide.
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        least = _sliding_min(key, min(window, len(key)))
        place = np.unique((low - (least & low)).astype(np.int64))
        hashes.append(h[place])
        places.append(place + at)
    where, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], where


def digest(hashes: np.ndarray) -> str:
    """Hex digest of the chosen hashes in text order; equal texts have equal digests."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, hashes array<long>, positions array<long>, fingerprint string) of every whole text.

    A map without a shuffle; memory is one batch of texts. NULL text counts as empty and has no hashes. NULL and repeated
    ids, repeated rows and empty tables pass through row by row; other columns are left out.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    longs = T.ArrayType(T.LongType())
    fields = [rows.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("hashes", longs), T.StructField("positions", longs), T.StructField("fingerprint", T.StringType())]

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                codes = code_points(value.as_py() or "")
                h, p = winnow(codes, k, window)
                out.append((len(codes), h.view(np.int64), p, digest(h)))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """Add ``__range``: rows in ascending doc_id (NULL first) cut into about n ranges by approximate quantiles."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    cuts = np.array(sorted(set(cuts or [])))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        at = np.searchsorted(cuts, ids.fillna(0).to_numpy(), side="right")
        return pd.Series(np.where(known, at, -1), dtype="int32")

    return rows.withColumn("__range", place("doc_id"))


def next_edit_likeness(docs: DataFrame, k: int = K, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compare every document with an edited copy and with its successor in ascending doc_id (after the last: the first).

    The edit replaces the last floor(n/4) code points by the first as many, or all, of the successor. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ranges of doc_id whose cuts are approximate quantiles (their number reaches the driver,
    not their rows). Only the first row of a range is sent to the range before as well. Inside a range rows are sorted and
    streamed, so memory is one batch. NULL ids come first; equal ids are ordered by text, equal rows one after another.
    NULL text counts as empty. A single document is its own successor. Other columns are left out.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    spark = rows.sparkSession
    ranged = _ranges(rows, 4 * partitions(spark))
    # The first row of each range, by id and then text, closes the range before; the very first closes the last.
    firsts = ranged.groupBy("__range").agg(F.min("doc_id").alias("first_id")).orderBy("__range").collect()
    id_type = rows.schema["doc_id"].dataType
    if not firsts:
        closing = ranged.withColumn("__closing", F.lit(True)).limit(0)
    else:
        order = [r["__range"] for r in firsts]
        sends = [(r["__range"], r["first_id"], order[i - 1]) for i, r in enumerate(firsts)]
        schema = T.StructType([T.StructField("__range", T.IntegerType()), T.StructField("first_id", id_type), T.StructField("to", T.IntegerType())])
        keys = F.broadcast(spark.createDataFrame(sends, schema))
        # One row of each range: the smallest text of the smallest id. min() runs before the shuffle.
        heads = ranged.join(keys, "__range").where("doc_id <=> first_id").groupBy("to", "first_id").agg(F.min("text").alias("text"))
        closing = heads.select(F.col("first_id").alias("doc_id"), "text", F.col("to").alias("__range"), F.lit(True).alias("__closing"))
    both = ranged.withColumn("__closing", F.lit(False)).unionByName(closing)
    dealt = both.repartition(max(1, min(len(firsts), partitions(spark))), "__range").sortWithinPartitions("__range", "__closing", "doc_id", "text")
    fields = [rows.schema["doc_id"]] + [T.StructField(n, t) for n, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))]
    names = [f.name for f in fields]

    def compare(one, other):
        row, body, own = one
        _, after, following = other
        cut = len(body) - len(body) // 4
        edited = np.concatenate((body[:cut], after[: len(body) // 4]))
        hashes = winnow(edited, k, window)[0]
        sha = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        mine = np.unique(own)
        return row, len(body), sha, digest(own), digest(hashes), likeness(mine, np.unique(hashes)), likeness(mine, np.unique(following))

    def run(batches):
        held = None
        for batch in batches:
            out = []
            ids, closing = batch.column(0), batch.column(3)
            for i, value in enumerate(batch.column(1)):
                codes = code_points(value.as_py())
                now = (ids[i].as_py(), codes, winnow(codes, k, window)[0])
                if held is not None:
                    out.append(compare(held, now))
                held = None if closing[i].as_py() else now
            columns = list(zip(*out)) or [()] * len(fields)
            kinds = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    return dealt.select("doc_id", "text", "__range", "__closing").mapInArrow(run, T.StructType(fields))
