"""Nearest vectors by multi-index hashing of learned binary codes.

A bounded sample of vectors gives a rotation (principal axes, then alternating between signs and the closest rotation) whose
signs are the code of a vector. The code is split into substrings of 16 bits and every row is indexed once per substring:
rows of a substring are sorted by its value, so a bucket is a stretch of rows, and stretches are dealt into blocks by the
leading bits of the value. A query looks for all codes within a Hamming radius r: with m substrings and r = m * s + a, such
a code differs by at most s bits in one of the first a + 1 substrings or by at most s - 1 in one of the others, so the query
goes to the blocks, and there to the buckets, that lie within those distances; codes within r are then compared by cosine of
the original vectors in doubles.

Radii follow the query. The sample tells how far codes lie apart for a cosine. A query starts from its best cosines within
the sample; a first search with the median distance for that cosine finds better ones, and a second with a high quantile
(``REACH``) of the distance for those retrieves the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgale.llm.common import partitions, pick, store
from hexgale.session import cut_lineage

#: Most vectors the rotation is learned from and radii are fitted on; vectors whose pairs tell distances.
SAMPLE, PAIRED = 8192, 1024
#: Bits of a substring, most bits of a code.
PIECE, BITS = 16, 64
#: Indexed rows of a block, queries that visit a block together, rows compared at a time.
BLOCK, QUERIES, STEP = 16_384, 16_384, 2048
#: Share of pairs of a cosine that the radius for it covers, in the first and in the second search.
REACH = (0.5, 0.99)
#: Closeness at which scores are computed again pair by pair before they are ranked.
EPS = 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Model:
    """Rotation to codes, the sample, and the radius for a cosine."""

    def __init__(self, x: np.ndarray, rounds: int = 40, bits: int = BITS):
        self.sample = _units(x)
        self.mean = self.sample.mean(axis=0)
        y = self.sample - self.mean
        bits = min(bits, x.shape[1])
        axes = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :bits]
        z = y @ axes
        turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ vt).T
        self.axes, self.bits = axes @ turn, bits
        self.pieces = [min(PIECE, bits - i) for i in range(0, bits, PIECE)]
        u, code = self.sample[:PAIRED], self.codes(self.sample[:PAIRED])
        a, b = np.triu_indices(len(u), 1)
        cos, apart = (u @ u.T)[a, b], np.bitwise_count(code[a] ^ code[b])
        order = np.argsort(-cos, kind="stable")
        cos, apart = cos[order], apart[order]
        # For every cosine the pairs just above it, 200 to 2000 of them.
        self.grid = np.linspace(-1.0, 1.0, 201)
        self.radius = np.full((2, len(self.grid)), bits, dtype=np.int64)
        if len(cos) >= 200:
            for i, c in enumerate(self.grid):
                k = max(200, int(np.searchsorted(-cos, -c, side="right")))
                self.radius[:, i] = np.ceil(np.quantile(apart[max(0, k - 2000) : k], REACH))

    def codes(self, units: np.ndarray) -> np.ndarray:
        on = (units - self.mean) @ self.axes > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def radii(self, cosine: np.ndarray, search: int) -> np.ndarray:
        """Radius for each cosine bound; a bound of -1 or none reaches everything."""
        at = np.clip(np.floor((np.nan_to_num(cosine, nan=-1.0, neginf=-1.0) + 1.0) * 100).astype(int), 0, 200)
        return np.where(cosine > -1.0, self.radius[search][at], self.bits)

    def substrings(self, code: np.ndarray) -> list[np.ndarray]:
        at = np.cumsum([0, *self.pieces[:-1]])
        return [((code >> np.uint64(a)) & np.uint64((1 << p) - 1)).astype(np.int64) for a, p in zip(at, self.pieces)]


def thresholds(radius: np.ndarray, pieces: int) -> np.ndarray:
    """Most differing bits to be looked for in each substring (columns); -1 where a substring need not be searched."""
    s, a = np.divmod(radius, pieces)
    return np.where(np.arange(pieces)[None, :] <= a[:, None], s[:, None], s[:, None] - 1)


def _valid(e: Column) -> Column:
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, e): one valid vector of doubles per id."""
    e = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    return rows.where(_valid(F.col("e")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("e").alias("e"))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class_id, e, ids): distinct vectors with their ``keep`` smallest ids."""
    # Many equal vectors: the smallest ids of each salted part first, then of all parts.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")
    for group in ([part], []):
        place = F.row_number().over(Window.partitionBy("e", *group).orderBy("vec_id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= keep).drop("place")
    return rows.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class_id", F.xxhash64("e"))


def _search(queries: DataFrame, blocks: DataFrame, index: DataFrame, model: Model, keep: int, n_parts: int) -> DataFrame:
    """(query, class_id, ids, score): for each query the best classes that each visited block offers.

    ``queries``: query, own, code, vec, radius. ``blocks``: piece, head, shift, parts. ``index``: piece, head, part, value,
    class_id, ids, code, vec.
    """
    pieces = len(model.pieces)
    at = np.cumsum([0, *model.pieces[:-1]]).tolist()
    code, piece = F.col("code"), F.col("piece")
    sub = F.element_at(F.array(*(F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << p) - 1)) for a, p in zip(at, model.pieces))), piece + 1)
    s, a = F.floor(F.col("radius") / pieces), F.col("radius") % pieces
    most = F.when(piece <= a, s).otherwise(s - 1)
    asked = queries.withColumn("lot", F.pmod(F.xxhash64("query"), F.col("lots")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    # Blocks whose leading bits lie near enough; there are few blocks, each of very many rows.
    sent = asked.withColumn("sub", sub).withColumn("most", most).join(F.broadcast(blocks), "piece")  # at most 2**10 blocks a substring
    sent = sent.where(F.expr("bit_count(shiftright(sub, shift) ^ head)") <= F.col("most"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lots = sent.select("piece", "head", "part", "lot").distinct()
    rows = index.join(lots, ["piece", "head", "part"])
    empty = F.lit(None)
    asking = sent.select("piece", "head", "part", "lot", F.lit(0).alias("kind"), F.col("sub").alias("value"), F.col("query").alias("id"), F.array().cast("array<bigint>").alias("ids"), "code", "vec", "radius", F.col("most").cast("int").alias("most"))
    held = rows.select("piece", "head", "part", "lot", F.lit(1).alias("kind"), "value", F.col("class_id").alias("id"), "ids", "code", "vec", empty.cast("int").alias("radius"), empty.cast("int").alias("most"))
    dealt = asking.unionByName(held).repartition(n_parts, "piece", "head", "part", "lot").sortWithinPartitions("piece", "head", "part", "lot", "kind", "value")

    def flush(asked: dict) -> pa.RecordBatch:
        flat = [(q, *hit) for q, best in zip(asked["id"].tolist(), asked["best"]) for hit in best]
        columns = list(zip(*flat)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.list_(pa.int64())), pa.array(list(columns[3]), pa.float64())], names=["query", "class_id", "ids", "score"])

    def compare(asked: dict, b: pa.RecordBatch) -> None:
        value, code_ = b.column(5).to_numpy(), b.column(8).to_numpy().view(np.uint64)
        vec, ids, class_id = _matrix(b.column(9)), b.column(7), b.column(6).to_numpy()
        units = _units(vec)
        buckets, member = np.unique(value, return_inverse=True)
        for lo in range(0, len(asked["id"]), 512):
            q = slice(lo, lo + 512)
            near = np.bitwise_count(asked["value"][q, None] ^ buckets[None, :]) <= asked["most"][q, None]
            rows_ = np.flatnonzero(near.any(axis=0)[member])
            if not len(rows_):
                continue
            found = near[:, member[rows_]] & (np.bitwise_count(asked["code"][q, None] ^ code_[None, rows_]) <= asked["radius"][q, None])
            score = np.where(found, asked["unit"][q] @ units[rows_].T, -2.0)
            least = np.maximum(asked["worst"][q], -1.5)
            if score.shape[1] > keep:
                least = np.maximum(least, np.partition(score, -keep, axis=1)[:, -keep])
            hit_q, hit_r = np.nonzero(score >= least[:, None] - EPS)
            if not len(hit_q):
                continue
            exact = np.concatenate([cosines(asked["vec"][lo + hit_q[i : i + 65536]], vec[rows_[hit_r[i : i + 65536]]]) for i in range(0, len(hit_q), 65536)])
            bounds = np.flatnonzero(np.concatenate(([True], hit_q[1:] != hit_q[:-1], [True])))
            for s_, e_ in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                at_q = lo + int(hit_q[s_])
                new = [(int(class_id[rows_[r]]), ids[int(rows_[r])].as_py(), c) for r, c in _leading(hit_r[s_:e_], exact[s_:e_], ids, rows_, keep)]
                best = sorted([*asked["best"][at_q], *new], key=lambda h: (-h[2], h[1][0]))[:keep]
                asked["best"][at_q] = best
                if len(best) == keep:
                    asked["worst"][at_q] = best[-1][2]

    def run(batches):
        asked, key, gathered = None, None, []
        for whole in batches:
            keys = list(zip(*(whole.column(i).to_pylist() for i in range(5))))
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo] and hi - lo < STEP:
                    hi += 1
                b = whole.slice(lo, hi - lo)
                lo = hi
                here, kind = keys[lo - 1][:4], keys[lo - 1][4]
                if here != key:
                    if asked is not None:
                        yield flush(asked)
                    key, asked, gathered = here, None, []
                if kind == 0:
                    gathered.append(b)
                elif gathered or asked is not None:
                    if asked is None:
                        t = pa.Table.from_batches(gathered).combine_chunks()
                        vec = _matrix(t.column(9).combine_chunks())
                        n = t.num_rows
                        asked = {"id": t.column(6).to_numpy(), "value": t.column(5).to_numpy(), "code": t.column(8).to_numpy().view(np.uint64), "radius": t.column(10).to_numpy(), "most": t.column(11).to_numpy(), "vec": vec, "unit": _units(vec), "best": [[] for _ in range(n)], "worst": np.full(n, -2.0)}
                        gathered = []
                    compare(asked, b)
        if asked is not None:
            yield flush(asked)

    return dealt.mapInArrow(run, "query long, class_id long, ids array<bigint>, score double")


def _leading(rows: np.ndarray, score: np.ndarray, ids, of: np.ndarray, keep: int) -> list[tuple[int, float]]:
    """The ``keep`` best of one query's rows, ties to the smaller first id."""
    if len(rows) > keep:
        least = np.partition(score, len(score) - keep)[len(score) - keep]
        rows, score = rows[score >= least], score[score >= least]
        if len(rows) > keep:
            first = np.array([ids[int(of[r])][0].as_py() for r in rows])
            order = np.lexsort((first, -score))[:keep]
            rows, score = rows[order], score[order]
    return list(zip(rows.tolist(), score.tolist()))


def nearest_vectors(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row whose id is divisible by ``every``.

    Nearness is the cosine of the original vectors in doubles, ties to the smaller id; candidates are all rows but the
    query's own, all of them where there are fewer than k. Recall depends on ``REACH`` and is measured in the tests.

    Vectors that are NULL, empty, zero, of another dimension than most of the sample, or hold NULL or non-finite
    components, and rows with a NULL id take no part. Rows that repeat an id count as one vector, the smallest of theirs.
    Equal vectors are one indexed class with its k + 1 smallest ids, which is all that a result can show of them. Empty
    input gives an empty result; other columns are left out.

    The driver receives the sample (at most ``sample`` vectors) and one number per block of the index; the model is sent to
    tasks with them. A block of many rows (near copies share buckets) is dealt into parts by hash, and queries visit blocks
    in lots, so a task holds at most a lot of queries and one step of rows.
    """
    rows = pick(vectors, vec_id=vec_id, embedding=embedding)
    spark = rows.sparkSession
    n_parts = partitions(spark)
    keep = k + 1
    vectors_ = store(_rows(rows))
    classes = cut_lineage(_classes(vectors_, keep))
    total = classes.count()
    out = "query_id long, rank int, vec_id long, score double"
    # The vectors with the smallest hashes: a sample that does not depend on how rows are dealt.
    drawn = [r["e"] for r in classes.orderBy("class_id", "ids").limit(sample).select("e").collect()]
    if not drawn:
        return spark.createDataFrame([], out)
    lengths = np.array([len(e) for e in drawn])
    dims = int(np.bincount(lengths).argmax())
    model = Model(np.array([e for e in drawn if len(e) == dims], dtype=np.float64))
    told = spark.sparkContext.broadcast(model)

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            # A power of two changes no digit of the cosine and keeps squares in range.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
            code = told.value.codes(_units(x)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.int64()), pa.array([v.astype("<f8").tobytes() for v in x], pa.binary())], names=["class_id", "ids", "code", "vec"])

    fit = classes.where(F.size("e") == dims).select("class_id", "ids", "e")
    coded = store(fit.mapInArrow(encode, "class_id long, ids array<bigint>, code long, vec binary"))
    # Leading bits such that a block has about ``block`` rows if values are spread; larger blocks go into parts.
    heads = int(np.clip(np.ceil(np.log2(max(1.0, total / block))), 0, 10))
    at = np.cumsum([0, *model.pieces[:-1]]).tolist()
    subs = F.array(*(F.struct(F.lit(i).alias("piece"), F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << p) - 1)).alias("value"), F.lit(max(0, p - heads)).alias("shift")) for i, (a, p) in enumerate(zip(at, model.pieces))))
    entries = coded.withColumn("at", F.explode(subs)).select("class_id", "ids", "code", "vec", "at.*").withColumn("head", F.expr("shiftright(value, shift)"))
    blocks = entries.groupBy("piece", "head", "shift").agg(F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / block).cast("int")).drop("size")
    blocks = cut_lineage(blocks)
    index = entries.join(F.broadcast(blocks.select("piece", "head", "parts")), ["piece", "head"]).withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(5)), F.col("parts")).cast("int")).drop("parts", "shift")

    asking = vectors_.where((F.col("vec_id") % every == 0) & (F.size("e") == dims))
    asking = asking.select(F.col("vec_id").alias("class_id"), F.array().cast("array<bigint>").alias("ids"), "e").mapInArrow(encode, "class_id long, ids array<bigint>, code long, vec binary")
    asking = asking.select(F.col("class_id").alias("query"), "code", "vec")

    def start(batches):
        m = told.value
        for b in batches:
            if not b.num_rows:
                continue
            units = _units(_matrix(b.column(2)))
            bound = []
            for lo in range(0, len(units), 512):
                cos = units[lo : lo + 512] @ m.sample.T
                # The query itself may be in the sample: one more, and one less to rank.
                bound.append(np.partition(cos, -keep, axis=1)[:, -keep] if cos.shape[1] >= keep else np.full(len(cos), -1.0))
            known = np.concatenate(bound)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(m.radii(known, 0), pa.int32()), pa.array(known)], names=["query", "code", "vec", "radius", "bound"])

    first = store(asking.mapInArrow(start, "query long, code long, vec binary, radius int, bound double"))
    lots = F.lit(max(1, -(-first.count() // QUERIES)))
    one = store(_search(first.withColumn("lots", lots), blocks, index, model, keep, n_parts))

    bound = one.select("query", "class_id", "score", F.explode("ids").alias("id")).where("id <> query").distinct()
    bound = bound.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") == k).select("query", F.col("score").alias("found"))

    def widen(batches):
        for b in batches:
            radius = told.value.radii(b.column(4).to_numpy(), 1)
            more = radius > b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(radius, pa.int32())], names=["query", "code", "vec", "radius"]).filter(pa.array(more))

    again = first.join(bound, "query", "left").select("query", "code", "vec", "radius", F.greatest("bound", "found").alias("bound")).mapInArrow(widen, "query long, code long, vec binary, radius int")
    two = _search(again.withColumn("lots", lots), blocks, index, model, keep, n_parts)
    hits = one.unionByName(two).select("query", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
