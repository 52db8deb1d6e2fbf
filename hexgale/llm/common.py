"""Helpers shared by the text operators: column selection, row order, tokenizer files, connected components."""

from __future__ import annotations

import gc
import importlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgale import session
from hexgale.session import cut_lineage  # noqa: F401  (operators and tests take it from here)


#: Seconds until Python's end of a dropped frame has told Java.
FINALIZER_S = 1.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    return importlib.import_module("public_tokenizers").path(name)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator uses; whatever else the frame carries is left out."""
    return df.select(*(df[source].alias(target) for target, source in columns.items()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def store(df: DataFrame) -> DataFrame:
    """Write a frame as a compressed table in the shared checkpoint folder and read it again.

    Like a checkpoint it cuts the lineage and survives lost executors; for rows with texts it takes half the room. The
    tables are called ``llm-<random>`` and may be deleted when the result of the operator has been written.
    """
    return session.store(df, "llm")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that nothing refers to any more, now rather than at some later
    collection of garbage on the driver.

    The Java side of a frame is let go by a thread of the Python side that wakes once a second; a collection before that
    would find all of them still in use.
    """
    gc.collect()
    time.sleep(FINALIZER_S)
    spark.sparkContext._jvm.System.gc()


class Memo:
    """A bounded memo in two ages: when the young one is full it becomes the old one; what is used again moves back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def look(self, keys: list) -> list:
        """What is known of the keys, None for the rest."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        got = list(map(self.young.get, keys))
        if self.old and None in got:
            old, young = self.old.get, self.young
            for i, key in enumerate(keys):
                if got[i] is None and (value := old(key)) is not None:
                    got[i] = young[key] = value
        return got


def _compress(parent: DataFrame) -> DataFrame:
    """Follow ``node -> root`` until every root is its own root; a chain of length n takes log2(n) rounds.

    Rounds are stored, not checkpointed: a checkpoint keeps the size its plan was estimated at, a join's estimate is the
    product of its sides', so the number's digits double with each round until the driver does nothing but multiply them.
    """
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = store(
            parent.join(up, "root", "left").select(
                "node",
                F.coalesce("above", "root").alias("root"),
                (F.coalesce("above", "root") != F.col("root")).alias("moved"),
            )
        )
        parent = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: one row (node, root) per node that has an edge.

    ``root`` is the smallest node of the component. Each round every node takes its smallest neighbour as parent, chains
    are shortened by pointer jumping, and edges are contracted to the roots, so at least half of the roots that still have
    edges vanish per round. Minima are combined before each shuffle, so a node with very many edges is no hot spot; joins
    are left to adaptive skew splitting. NULL ends and self loops are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live = store(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        down = live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        both = down.unionByName(live.select(F.col("a").alias("node"), F.col("b").alias("other")))
        parent = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
        parent = _compress(parent)
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = store(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        ra = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = live.join(ra, "a").join(rb, "b").where("ra <> rb")
        live = store(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if live.isEmpty():
            return labels


def with_component(rows: DataFrame, node: str, labels: DataFrame, out: str = "component_id") -> DataFrame:
    """Add the component of ``node``; rows without an edge are their own component."""
    got = labels.select(F.col("node").alias(node), F.col("root").alias("__root"))
    return rows.join(got, node, "left").withColumn(out, F.coalesce("__root", node)).drop("__root")


