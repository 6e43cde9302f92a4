"""Whole groups from sorted Arrow batches, and connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, group starts and the end) of at least ``rows`` rows each, from batches sorted by ``keys``;
    no group is cut. Holds one group and ``rows`` rows at most."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        cut = int(starts[-2])
        if cut:
            yield table.slice(0, cut), starts[:-1]
            held, n = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        col = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= col[1:] != col[:-1]
    return np.concatenate((np.flatnonzero(new), [table.num_rows]))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, of n nodes joined by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, was):
            break
    return root


def star_edges(node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all but the least; ``root`` is what ``local_roots`` gives.
    Groups that share most of their members thus share most of their edges."""
    least = node.copy()
    np.minimum.at(least, root, node)
    to = least[root]
    moved = np.flatnonzero(to != node)
    return node[moved], to[moved]


def block_pairs(df: DataFrame, size: Column, spread: Column, block: int) -> DataFrame:
    """Adds _own, the block of a row of a group of ``size`` rows, and _bi <= _bj, the pairs of blocks in
    which it takes part: pairs of rows meet in just one pair of blocks, each of about 2 x ``block`` rows."""
    dealt = df.withColumn("_nb", F.ceil(size / F.lit(float(block))).cast("int")).withColumn("_own", F.pmod(spread, F.col("_nb")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return other.withColumn("_bi", F.least("_own", "_other")).withColumn("_bj", F.greatest("_own", "_other")).drop("_nb", "_other")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes that an edge joins to another one; root is the component's smallest node.

    Edges lead from a node to a smaller one. Each round ties a node's smaller neighbours to the least of them, so
    that stars which overlap collapse to about one edge a node, and then sends each edge on to its end's least
    neighbour. It ends with one star per component: until then each round leads some edge to a smaller node, so there
    is no limit of rounds (their number grows with the logarithm of a component's size). Each round's table is
    written to the shared folder; only a mark of changes reaches the driver. Edges with a null end or equal ends
    are ignored.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    pairs = materialise(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        least = pairs.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("low")).withColumn("moved", F.col("v") > F.col("low"))
        tied = F.explode(F.array(*(F.struct(F.col(end).alias("u"), F.col("low").alias("v"), "moved") for end in ("u", "v")))).alias("e")
        pulled = materialise(least.select(tied).select("e.*").filter("u > v").groupBy("u", "v").agg(F.max("moved").alias("moved")), "pulled")
        up = pulled.groupBy("u").agg(F.min("v").alias("up")).withColumnRenamed("u", "v")
        sent = pulled.join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        pairs = materialise(sent, "sent")
        if not pairs.agg(F.max("moved")).first()[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
