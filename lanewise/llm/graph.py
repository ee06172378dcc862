"""Connected components of an undirected edge table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import materialise, release


def _to_minimum(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over (a, b): neighbours of a node are linked to its least neighbour.

    ``larger`` moves the neighbours above the node, else those below and the node itself.
    The minimum is pre-aggregated before the shuffle, so a hub costs one row per task.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    if larger:
        low = low.select("a", F.least("a", "m").alias("m"))
        moved = edges.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


#: Edges (16 bytes each) that one task may hold; more take rounds over the cluster.
ONE_TASK = 1 << 20


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of the edges (a, b).

    Roots hook onto smaller roots and paths are halved until every edge lies in one tree.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]


def _in_one_task(batches):
    import pyarrow as pa

    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, least = least_nodes(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def components(edges: DataFrame, tag: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): ``component`` is the least node of each connected component.

    ``edges`` has long columns a and b.  Nodes without edges do not appear.  Up to ``one_task``
    distinct edges, which are counted first, are joined up in one executor's task.  More take
    alternating large-star and small-star rounds, each written to the shared folder.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag
    )
    if now.count() <= one_task:
        found = materialise(now.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), tag)
        release(now)
        return found
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        after = materialise(_to_minimum(_to_minimum(both, True), False), tag)
        release(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
