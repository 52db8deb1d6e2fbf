"""Merkle manifest of a dataset: one tree per group, one tree over the groups' roots, a proof for every row.

Leaves are numbered without sorting a group in one task (range partitions plus the counts before them). Levels are built
six at a time: 64 consecutive nodes meet in one small row and yield the levels above them. Proofs come from pointer
jumping: every node first holds its own siblings; in each round a node whose level is a multiple of twice the step takes
over the segment of its ancestor ``step`` levels up, so distances double and a leaf has its whole path after
log2(depth) joins. Only nodes that a later round can ask for are carried on. An ancestor far up would be the key of very
many rows, so its segment is dealt to groups of at most 16 nodes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgale.llm.common import partitions, pick, store

#: Levels built by one grouping (2**BUILT nodes a row); rows that share an ancestor's row in a join are 2**NEAR.
BUILT, NEAR = 6, 4

#: Parts of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and the siblings of its path give."""
    return F.aggregate(proof, leaf, lambda d, s: digest(s["before"], d, s["after"]))


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a path, leaf upwards, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def _depth(n: Column) -> Column:
    """Levels above n leaves: the least d with 2**d >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _ordinals(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Add ``idx``, the row's place in its group from 0, and ``n``, the rows of the group."""
    n_parts = partitions(rows.sparkSession)
    sort = [F.col(group), *order]
    placed = store(rows.repartitionByRange(n_parts, *sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # A group has at most as many rows here as there are partitions.
    counts = counts.selectExpr(
        f"`{group}`", "__part", "__first",
        f"coalesce(sum(__rows) OVER (PARTITION BY `{group}` ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before",
        f"sum(__rows) OVER (PARTITION BY `{group}`) AS n",
    )
    return placed.join(counts, [group, "__part"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def _pairs(nodes: Column) -> Column:
    """The level above: digests of every two consecutive nodes, of the last alone where their number is odd."""
    places = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(places, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _segment(level: Column, i: Column) -> Column:
    """The siblings of node i of a level: one entry, both sides empty where the node is alone."""
    odd = i % 2 == 1
    before = F.when(odd, F.get(level, i - 1)).otherwise("")
    after = F.when(odd, "").otherwise(F.coalesce(F.get(level, i + 1), F.lit("")))
    return F.array(F.struct(before.alias("before"), after.alias("after")))


def _build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(leaves with the siblings of their level, nodes of the levels between, roots, greatest depth) of trees of leaves.

    ``leaves``: tree, idx, n, digest, item.
    """
    deepest = leaves.agg(F.max(_depth(F.col("n")))).first()[0] or 0
    depth = _depth(F.col("n"))
    at, between, roots, nodes, bottom = 0, None, None, leaves, None
    while True:
        taken = F.greatest(F.lit(0), F.least(F.lit(BUILT), depth - at))
        own = F.transform("nodes", lambda x: x["digest"])
        levels = F.when(taken > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(taken, F.lit(1))), F.array(own), lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))))).otherwise(F.array(own))
        item = ["item"] if at == 0 else []
        chunks = nodes.groupBy("tree", "n", F.shiftright("idx", BUILT).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *item))).alias("nodes"))
        chunks = store(chunks.withColumn("levels", levels).withColumn("taken", taken))
        if at == 0:
            one = chunks.select("tree", "n", F.col("levels")[0].alias("level_"), "taken", F.posexplode("nodes").alias("i", "node"))
            empty = F.slice(_segment(F.col("level_"), F.col("i")), 1, F.when(F.col("taken") > 0, 1).otherwise(0))
            bottom = one.select("tree", "n", F.col("node.idx").alias("idx"), F.col("node.digest").alias("digest"), F.col("node.item").alias("item"), empty.alias("seg"))
        inner = chunks.where("taken > 0").select("tree", "n", "chunk", F.posexplode(F.expr("slice(levels, 1, taken)")).alias("j", "level_"))
        inner = inner.where(F.col("j") + at > 0).select("tree", "n", "chunk", "j", "level_", F.explode(F.sequence(F.lit(0), F.size("level_") - 1)).alias("i"))
        inner = inner.select("tree", "n", (F.col("j") + at).alias("level"), (F.expr(f"shiftleft(chunk, {BUILT} - j)") + F.col("i")).alias("idx"), _segment(F.col("level_"), F.col("i")).alias("seg"))
        between = inner if between is None else between.unionByName(inner)
        tops = chunks.select("tree", "n", F.col("chunk").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        ended = tops.where(depth <= at + BUILT).drop("idx")
        roots = ended if roots is None else roots.unionByName(ended)
        at += BUILT
        if deepest <= at:
            return bottom, between, roots, deepest
        nodes = tops.where(depth > at)


def _near(ancestors: DataFrame, low: Column | int, step: int) -> DataFrame:
    """Ancestors ``step`` levels above ``low``, one row for each group of at most 2**NEAR nodes below them."""
    shift = min(step, NEAR)
    if step == shift:
        return ancestors.withColumn("near", F.col("idx"))
    low = low if isinstance(low, Column) else F.lit(low)
    spread = step - shift
    groups = F.ceil(F.col("n") / F.pow(F.lit(2.0), low + shift)).cast("long")
    first = F.shiftleft("idx", spread)
    last = F.least(F.shiftleft(F.col("idx") + 1, spread), groups) - 1
    return ancestors.withColumn("near", F.explode(F.sequence(first, last)))


def _jump(leaves: DataFrame, between: DataFrame, deepest: int) -> DataFrame:
    """Leaves with the siblings of all levels of their tree in ``seg``."""
    step = 1
    while step < deepest:
        shift = min(step, NEAR)
        ahead = between.where(F.col("level") % (2 * step) == step)
        mine = _near(ahead.where(F.col("level") == step), 0, step).select("tree", "near", F.col("seg").alias("more"))
        joined = F.concat("seg", F.coalesce("more", F.array().cast("array<struct<before:string,after:string>>")))
        leaves = leaves.withColumn("near", F.shiftright("idx", shift)).join(mine, ["tree", "near"], "left").withColumn("seg", joined).drop("near", "more")
        theirs = _near(ahead, F.col("level") - step, step).select("tree", (F.col("level") - step).alias("level"), "near", F.col("seg").alias("more"))
        stay = between.where(F.col("level") % (2 * step) == 0).withColumn("near", F.shiftright("idx", shift))
        between = store(stay.join(theirs, ["tree", "level", "near"], "left").withColumn("seg", joined).select("tree", "n", "level", "idx", "seg"))
        step *= 2
    return leaves


def merkle_proofs(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "lang", count: str = "n_chars") -> DataFrame:
    """(doc_id, leaf, tampered_leaf, subroot, root, proof): every row's leaf, its tree's root, the dataset's root, its path.

    A leaf is the digest of ``fields``, each as ``field`` writes it. Leaves of a group ascend by ``doc_id`` (NULL first;
    equal ids by leaf, so the order of input rows does not matter), every two consecutive nodes make one of the next
    level, a last odd one alone. Roots of the groups, NULL first, then by bytes, are the leaves of the dataset's tree.
    ``proof`` lists the siblings from the leaf to the root, {before, after}, both empty where a node is alone;
    ``fold(leaf, proof)`` is the root. ``tampered_leaf`` is the leaf with ``count`` one higher in rows for which
    ``tampered`` holds (a NULL count stays), NULL in others; it is no part of any tree.

    NULL in any field, empty and very long texts are fields like others; repeated rows are leaves of their own; an empty
    table gives an empty result; a single row is its own root; other columns are left out. The driver receives the
    greatest depths and the root.
    """
    names = list(dict.fromkeys([*fields, doc_id, group, count]))
    rows = docs.select(*names)
    leaf = digest(*(field(F.col(c)) for c in fields))
    bumped = digest(*(field((F.col(c).cast("decimal(20,0)") + 1).cast("decimal(20,0)") if c == count else F.col(c)) for c in fields))
    wrong = F.when(F.coalesce(tampered, F.lit(False)), bumped) if tampered is not None else F.lit(None).cast("string")
    # The empty key stands for NULL and comes first; others keep their order behind a common sign.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), leaf.alias("digest"), F.struct(F.col(doc_id).alias("id"), wrong.alias("wrong")).alias("item")).withColumn("row", F.monotonically_increasing_id())
    leaves = _ordinals(leaves, "tree", [F.col("item.id"), F.col("digest"), F.col("row")]).drop("row")
    bottom, between, roots, deepest = _build(leaves)
    paths = _jump(bottom, between, deepest)

    groups = roots.select("tree", F.col("digest"), F.col("n").alias("rows"))
    tops = groups.select(F.lit("all").alias("tree"), "digest", F.struct("tree", "rows").alias("item"))
    top_bottom, top_between, top_roots, top_deepest = _build(_ordinals(tops, "tree", [F.col("item.tree")]))
    whole = top_roots.first()
    top_paths = _jump(top_bottom, top_between, top_deepest)
    # A group's path goes to its leaves like that of a far ancestor: one row per 2**NEAR leaves.
    near = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("item.rows") - 1, NEAR)))
    upper = top_paths.select(F.col("item.tree").alias("tree"), F.col("digest").alias("subroot"), F.col("seg").alias("more"), near.alias("near"))
    joined = paths.withColumn("near", F.shiftright("idx", NEAR)).join(upper, ["tree", "near"])
    root = F.lit(whole["digest"] if whole else None).cast("string")
    return joined.select(F.col("item.id").alias(doc_id), F.col("digest").alias("leaf"), F.col("item.wrong").alias("tampered_leaf"), "subroot", root.alias("root"), F.concat("seg", "more").alias("proof"))


def tamper_check(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): which rows still fold to the root after tampering.

    Rows whose unsigned crc32 of the decimal doc_id is divisible by ``every`` get one character more in n_chars before
    their leaf is folded with the untampered siblings. A NULL doc_id is never tampered with.
    """
    rows = pick(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    proofs = merkle_proofs(rows, F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0)
    folded = fold(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
