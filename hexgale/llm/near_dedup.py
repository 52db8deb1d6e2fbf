"""Near-duplicate documents: chosen-path set similarity join on minwise tokens, links confirmed on full shingle sets.

Documents with equal shingle sets form one class first. A class is embedded as ``TOKENS`` minwise tokens. In each of
``TREES`` independent trees a class walks down ``BRANCH`` chosen token positions at the root; a node is the path of chosen
tokens. Nodes with one class end, small nodes are compared exhaustively, larger ones branch again, each node choosing its
own positions. A pair of similarity 0.8 misses a tree with probability q = (0.2 + 0.8 q)^2 < 0.063, all four with 2e-5.

Only links between different components matter for the result, so a node first yields a spanning forest of its likeliest
pairs; after these are confirmed and merged, every pair of the node that still lies in two components is looked at. Groups
of thousands of near copies thus cost about one comparison per member, not one per pair, and nothing is left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexgale.llm.common import Memo, components, partitions, pick, release
from hexgale.session import cut_lineage

TOKENS, TREES, BRANCH, DEPTH = 128, 4, 2, 3
#: Classes of a node that are compared exhaustively; larger nodes branch, or at the last level meet PIVOTS members each.
SMALL, PIVOTS = 48, 4
#: Likeliest partners that a member outside a node's largest component meets before all of them are looked at.
NEAREST = 2
#: Members confirmed against one pivot in one task group.
SALT_ROWS = 400
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1 << 30, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_PLACES = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MEMO = Memo(400_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.translate(UPPER) if not text.isascii() else text.lower())
    got = _MEMO.look(words)
    if None in got:
        young = _MEMO.young
        for i, w in enumerate(words):
            if got[i] is None:
                got[i] = young[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.array(got, dtype=np.uint64)


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; fewer words make one shingle, no word none."""
    h = word_hashes(text)
    if not len(h):
        return h
    used = min(n, len(h))
    x = np.full(len(h) - used + 1, used, dtype=np.uint64)
    for j in range(used):  # words are random numbers, so a sum with a factor per place tells sequences apart
        x += h[j : j + len(x)] * _PLACES[j]
    return np.unique(_mix(x))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """TOKENS minwise values of 32 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    return np.array([(low * a + b).min() for a, b in zip(_MULTIPLY, _ADD)], dtype=np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets, in whole numbers."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _path_hash(parent: int, tree: int, position: int, token: int) -> int:
    x = (parent * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9 + position * 0x94D049BB133111EB + token * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & (2**64 - 1)
    return (x ^ (x >> 32)) - (1 << 63)


def _children(parent: int, tree: int, tokens: np.ndarray):
    """The nodes below ``parent`` that a class enters: the node, not the class, chooses the positions."""
    seed = _path_hash(parent, tree, 77, 0)
    first = seed % TOKENS
    step = (seed >> 8) % (TOKENS - 1) + 1
    for j in range(BRANCH):
        position = (first + j * step) % TOKENS
        yield _path_hash(parent, tree, position, int(tokens[position]))


_NODE = "node long, tree int, class_id long, n int, sketch binary"


def agreement(percent: int) -> int:
    """Tokens that have to agree: the similarity less five standard deviations of its estimate."""
    p = percent / 100
    return int(TOKENS * (p - 5 * (p * (1 - p) / TOKENS) ** 0.5))


def _roots(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            node, tree, row, sketches = [], [], [], []
            for i, sig in enumerate(b.column(2)):
                tokens = np.frombuffer(sig.as_py(), "<u4")
                sketch = (tokens & 255).astype(np.uint8).tobytes()
                for t in range(TREES):
                    for c in _children(0, t, tokens):
                        node.append(c)
                        tree.append(t)
                        row.append(i)
                        sketches.append(sketch)
            yield _node_batch(b, node, tree, row, sketches)

    return classes.select("class_id", "n", "sig").mapInArrow(run, _NODE)


def _branch(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            node, tree, row, sketches = [], [], [], []
            for i, (sig, t, p) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                tokens = np.frombuffer(sig, "<u4")
                sketch = (tokens & 255).astype(np.uint8).tobytes()
                for c in _children(p, t, tokens):
                    node.append(c)
                    tree.append(t)
                    row.append(i)
                    sketches.append(sketch)
            yield _node_batch(b, node, tree, row, sketches)

    return nodes.select("class_id", "tree", "node").join(classes, "class_id").select("class_id", "n", "sig", "tree", "node").mapInArrow(run, _NODE)


def _node_batch(b, node, tree, row, sketches):
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tree, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(sketches, pa.binary())], names=["node", "tree", "class_id", "n", "sketch"])


def _groups(batches, key: int):
    """Runs of rows with equal key from sorted batches, as record batches that may split a long run."""
    for b in batches:
        values = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield values[lo], b.slice(lo, hi - lo)


def _likely(sketch: np.ndarray, n: np.ndarray, others: np.ndarray, other_n: np.ndarray, percent: int) -> np.ndarray:
    """Agreeing tokens of each row with one other, 0 where the pair cannot be similar."""
    agree = (sketch == others).sum(axis=1)
    low, high = np.minimum(n, other_n), np.maximum(n, other_n)
    return np.where((agree >= agreement(percent)) & (100 * low >= percent * high), agree, 0)


def _forest(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b): in each node a spanning forest of the likeliest pairs, or of pairs with the first members."""

    def run(batches):
        held: dict = {"key": None}

        def flush():
            if held["key"] is None or held["rows"] < 2:
                return
            ids, n, sk = (np.concatenate(held[c]) for c in ("ids", "n", "sk"))
            pairs = []
            if len(ids) <= SMALL:
                for i in range(1, len(ids)):
                    got = _likely(sk[:i], n[:i], sk[i], n[i], percent)
                    pairs += [(int(got[j]), i, int(j)) for j in np.flatnonzero(got)]
                pairs.sort(reverse=True)
                root = list(range(len(ids)))

                def find(x):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for _, i, j in pairs:
                    a, b = find(i), find(j)
                    if a != b:
                        root[a] = b
                        yield int(ids[i]), int(ids[j])

        for key, part in _groups(batches, 0):
            ids, n = part.column(1).to_numpy(), part.column(2).to_numpy()
            sk = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, TOKENS)
            out: list[tuple[int, int]] = []
            if key != held["key"]:
                out += flush()
                held = {"key": key, "rows": 0, "ids": [], "n": [], "sk": []}
            if held["rows"] + len(ids) <= SMALL:
                held["ids"].append(ids)
                held["n"].append(n)
                held["sk"].append(sk)
                held["rows"] += len(ids)
            else:
                # A large node: its first members are the pivots, each later row pairs with the likeliest of them.
                if "pivots" not in held:
                    ids, n, sk = (np.concatenate([*held[c], x]) for c, x in (("ids", ids), ("n", n), ("sk", sk)))
                    held |= {"pivots": (ids[:PIVOTS], n[:PIVOTS], sk[:PIVOTS]), "rows": 0, "ids": [], "n": [], "sk": []}
                    held["big"] = True
                pid, pn, psk = held["pivots"]
                got = np.stack([_likely(sk, n, psk[j], pn[j], percent) * (ids != pid[j]) for j in range(len(pid))])
                best = got.argmax(axis=0)
                out += [(int(ids[i]), int(pid[best[i]])) for i in np.flatnonzero(got.max(axis=0))]
                held["rows"] = SMALL + 1  # later parts of this node come here as well
                held["ids"], held["n"], held["sk"] = [ids[:0]], [n[:0]], [sk[:0]]
            if out:
                yield _pair_batch(out)
        out = list(flush())
        if out:
            yield _pair_batch(out)

    sorted_ = members.select("node", "class_id", "n", "sketch").repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node", F.xxhash64("class_id"))
    return sorted_.mapInArrow(run, "a long, b long")


def _pair_batch(pairs):
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])


def _across(members: DataFrame, labels: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Likely pairs (a, b) of a node that lie in two components: every such pair has an end outside the node's largest one.

    For each member outside it the ``nearest`` likeliest partners, or all with None. The members outside are held, those
    of the largest component stream past them; what comes out is one list per member and node.
    """
    up = labels.select(F.col("node").alias("class_id"), "root")
    rows = members.join(up, "class_id", "left").select("node", "class_id", "n", "sketch", F.coalesce("root", "class_id").alias("root"))
    sizes = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("node").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("node", "main")
    marked = rows.join(main, "node").select("node", "class_id", "n", "sketch", "root", (F.col("root") == F.col("main")).alias("inner"))
    dealt = marked.repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node", "inner")

    def run(batches):
        rest: list[np.ndarray] | None = None
        best: list[list[tuple[int, int]]] = []
        now = None

        def meet(part: list[np.ndarray]) -> None:
            """All of the held members against the rows of a part."""
            for i, (u, n, root, sk) in enumerate(zip(*rest)):
                agree = _likely(part[3], part[1], sk, n, percent) * (part[2] != root)
                at = np.flatnonzero(agree)
                if nearest is not None and len(at) > nearest:
                    at = at[np.argsort(-agree[at], kind="stable")[:nearest]]
                best[i] += [(int(agree[k]), int(part[0][k])) for k in at]
                if nearest is not None:
                    best[i] = sorted(best[i], reverse=True)[:nearest]

        def flush():
            found = [(int(u), [v for _, v in b]) for u, b in zip(rest[0], best) if b] if rest is not None else []
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], names=["a", "others"])

        met = False
        for key, part in _groups(batches, 0):
            cols = [part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(4).to_numpy(), np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, TOKENS)]
            inner = part.column(5).to_numpy(zero_copy_only=False)
            if key != now:
                if rest is not None and not met:
                    meet(rest)
                yield flush()
                now, rest, best, met = key, None, [], False
            out = [c[~inner] for c in cols]
            if len(out[0]):
                rest = out if rest is None else [np.concatenate((x, y)) for x, y in zip(rest, out)]
                best += [[] for _ in range(len(out[0]))]
            if inner.any() and rest is not None:
                if not met:
                    meet(rest)
                    met = True
                meet([c[inner] for c in cols])
        if rest is not None and not met:
            meet(rest)
        yield flush()

    lists = dealt.mapInArrow(run, "a long, others array<long>").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    got = lists.select("a", F.explode("others").alias("b"))
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar. Members stream past their pivot; large groups are salted."""
    n_parts = partitions(pairs.sparkSession)
    pairs = pairs.distinct()
    # The end with more pairs leads the group, so that few groups carry their leader's text.
    uses = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("uses"))
    ua, ub = uses.select(F.col("class_id").alias("a"), F.col("uses").alias("ua")), uses.select(F.col("class_id").alias("b"), F.col("uses").alias("ub"))
    led = pairs.join(ua, "a").join(ub, "b").select(F.when(F.col("ua") >= F.col("ub"), F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(F.col("ua") >= F.col("ub"), F.col("b")).otherwise(F.col("a")).alias("other"))
    sizes = led.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    led = cut_lineage(led.join(sizes, "lead").select("lead", "other", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int").alias("salt"), "salts"))
    texts = texts.select(F.col("class_id").alias("other"), "text")
    heads = led.select("lead", "salts").distinct().select(F.col("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("other", F.col("lead"))
    rows = led.select("lead", "salt", "other").unionByName(heads.select("lead", "salt", "other")).join(texts, "other")
    dealt = rows.select("lead", "salt", "other", "text", (F.col("other") != F.col("lead")).alias("member")).repartition(n_parts, "lead", "salt").sortWithinPartitions("lead", "salt", "member")

    def run(batches):
        now, head = None, None
        for x in batches:
            out = []
            for lead, other, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2)):
                s = shingle_set(text.as_py(), shingle)
                if lead == other:
                    now, head = lead, s
                elif now == lead and similar(head, s, percent):
                    out.append((lead, other))
            yield _pair_batch(out)

    return dealt.select("lead", "other", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept marks the smallest id of each component.

    Linked are sets with 100 * intersection >= percent * union. NULL text, text without words: an empty set, linked with
    nothing. Fewer words than a shingle: all of them are the one shingle. Rows with a NULL id are linked with nothing and
    have a NULL component and kept = true. Rows that repeat an id are separate texts under one id; each has the component
    of its own text. Empty input gives an empty result; other columns are left out. Texts of candidates alone are shuffled;
    groups of copies are combined before each shuffle; no pair list of a group is ever built.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    id_field = rows.schema["doc_id"]
    spark = rows.sparkSession

    def describe(batches):
        for b in batches:
            n, keys, sigs = [], [], []
            for value in b.column(1):
                s = shingle_set(value.as_py() or "", shingle)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(minwise(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    fields = [id_field, T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    described = cut_lineage(rows.mapInArrow(describe, T.StructType(fields)))
    whole = described.where("doc_id is not null and set_key is not null")
    classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").cast("int").alias("n"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes.withColumn("class_id", F.monotonically_increasing_id()))

    level, members = _roots(classes), None
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = cut_lineage(level.join(sizes, "node"))
        ready = shared if depth == DEPTH else shared.where(F.col("size") <= SMALL)
        ready = ready.select("node", "class_id", "n", "sketch", (F.col("size") > SMALL).alias("large"))
        members = ready if members is None else members.unionByName(ready)
        big = shared.where(F.col("size") > SMALL)
        if depth == DEPTH or big.isEmpty():
            break
        level = _branch(big, classes)

    release(spark)  # shuffled nodes
    first = cut_lineage(_forest(members, percent).distinct())
    # Texts of the classes that have a likely partner anywhere: the ends of the forests, and members of large nodes, which
    # have met the pivots only.
    ends = first.select(F.explode(F.array("a", "b")).alias("class_id")).unionByName(members.where("large").select("class_id"))
    need = ends.distinct().join(classes.select("class_id", "first_id", "set_key"), "class_id")

    def same(batches):
        for b in batches:
            ok = [hashlib.blake2b(shingle_set(t.as_py(), shingle).tobytes(), digest_size=16).digest() == k.as_py() for t, k in zip(b.column(1), b.column(2))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["class_id", "text"])

    found = rows.join(need, rows["doc_id"] == need["first_id"]).select("class_id", "text", "set_key").where("text is not null")
    texts = cut_lineage(found.mapInArrow(same, "class_id long, text string").dropDuplicates(["class_id"]))
    release(spark)
    links = cut_lineage(_confirm(first, texts, shingle, percent))
    release(spark)
    labels = components(links)
    for nearest in (NEAREST, None):
        across = cut_lineage(_across(members, labels, percent, nearest).distinct())
        if across.isEmpty():
            break
        links = links.unionByName(cut_lineage(_confirm(across, texts, shingle, percent)))
        release(spark)
        labels = components(links)

    up = labels.select(F.col("node").alias("class_id"), "root")
    rooted = classes.select("class_id", "set_key", "first_id").join(up, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("set_key", "component_id")
    out = described.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
