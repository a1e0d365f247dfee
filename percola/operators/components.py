"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.session import Staged, ship


def _merged(batches):
    """(node, least node reachable) of all arcs: labels fall to the least of their neighbours and jump along labels until none changes."""
    parts = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if not parts:
        return
    arcs = np.concatenate(parts, 1)
    nodes, ends = np.unique(arcs, return_inverse=True)
    u, v = ends.reshape(arcs.shape)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, label[u], label[v])
        np.minimum.at(new, label[v], label[u])
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "v"])


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", staged: Staged | None = None, max_rounds: int = 60, one_task: int = 0
) -> DataFrame:
    """(node, component) for every endpoint: component is the smallest node reachable.

    Alternating large-star and small-star rounds, each a pair of aggregations whose
    minimum is pre-aggregated before the shuffle; a node with very many neighbours
    only ever contributes one partial minimum per task. Every round is a written
    table, so lineage stays short and lost executors cost one round. Null endpoints
    are ignored; self-loops make a node its own component; empty in, empty out. With at most `one_task`
    distinct arcs between integers, a single task merges them at once.
    """
    spark: SparkSession = edges.sparkSession
    staged = staged or Staged(spark)
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select(F.col("v").alias("node")))
    # every arc points from a larger node to a smaller one
    arcs = raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    arcs = staged.put(arcs, "arcs")
    if one_task and arcs.count() <= one_task:
        ship(spark)
        kind = arcs.schema["u"].dataType.simpleString()
        found = arcs.coalesce(1).mapInArrow(_merged, f"node {kind}, v {kind}")
        return nodes.distinct().join(found, "node", "left").select("node", F.coalesce("v", "node").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = arcs.union(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # written, so that the join below sees two plain exchanges and can split a node with very many arcs
        least = staged.put(least, "least")
        # large star: neighbours above a node point to the least of its neighbourhood
        large = (
            arcs.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = staged.put(large, "large-star")
        # small star: neighbours below a node, and the node, point to the least of them
        low = staged.put(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = staged.put(small, "small-star")
        now = small.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        staged.drop(arcs, large, least, low)
        arcs = small
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.distinct().join(arcs.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
