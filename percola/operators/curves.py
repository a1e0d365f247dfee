"""Robustness curves: summaries, areas, thresholds, node scores, and curves on a grid of removal counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from percola.functions.scalar import sem
from percola.operators import kernels
from percola.operators.components import connected_components
from percola.operators.graph import ONE_TASK
from percola.session import Staged, ship

KEY = ["label", "protocol", "m"]
REPLICATE = [*KEY, "stochastic_id"]
THRESHOLDS = (0.5, 0.25, 0.1, 0.05)
#: Nodes whose ranks are broadcast for a forest: 16 bytes each, some 100 in a task. Edges of a piece merged with a forest at once.
MOST_RANKED, FOREST_PIECE = 5_000_000, 2_000_000


def threshold_name(t: float) -> str:
    return "p_lcc_" + f"{t:g}".replace(".", "_")


def curve_summary(curves: DataFrame) -> DataFrame:
    """Mean, sample deviation and standard error over replicates, for each key and removal count; a null m is a key."""
    cols: list[Column] = [F.min("p").alias("p")]
    for c in ("s1_over_n", "s2_over_n"):
        cols += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"), sem(c).alias(f"sem_{c}")]
    return curves.groupBy(*KEY, "removed").agg(*cols, F.count("*").alias("n"))


def curve_metrics(curves: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A row for each replicate: trapezoid areas over p, interpolated first crossings, the peak of S2 and its first place.

    One window by replicate and one aggregation with the same keys, so rows move once. A threshold that is
    never reached is null.
    """
    w = Window.partitionBy(*REPLICATE).orderBy("removed")
    c = curves.withColumn("_p", F.lag("p").over(w)).withColumn("_a", F.lag("s1_over_n").over(w)).withColumn("_b", F.lag("s2_over_n").over(w))
    step = F.col("p") - F.col("_p")
    aggs = [
        F.coalesce(F.sum(step * (F.col("s1_over_n") + F.col("_a")) / 2), F.lit(0.0)).alias("auc_s1"),
        F.coalesce(F.sum(step * (F.col("s2_over_n") + F.col("_b")) / 2), F.lit(0.0)).alias("auc_s2"),
    ]
    for t in thresholds:
        y, y0, x, x0 = F.col("s1_over_n"), F.col("_a"), F.col("p"), F.col("_p")
        at = F.when(x0.isNull() | (y0 == y), x).otherwise(x0 + (t - y0) * (x - x0) / (y - y0))
        aggs.append(F.min_by(F.when(y <= t, at), F.when(y <= t, F.col("removed"))).alias(threshold_name(t)))
    aggs += [F.max("s2_over_n").alias("max_s2_over_n"), F.max_by("p", F.struct("s2_over_n", -F.col("removed"))).alias("p_at_max_s2")]
    return c.groupBy(*REPLICATE).agg(*aggs)


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of every metric over replicates, standard errors of the areas, and n."""
    names = [c for c in metrics.columns if c not in REPLICATE]
    cols: list[Column] = []
    for c in names:
        cols += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
        if c.startswith("auc_"):
            cols.append(sem(c).alias(f"sem_{c}"))
    return metrics.groupBy(*KEY).agg(*cols, F.count("*").alias("n"))


def subsample(curves: DataFrame, step: int, last: Column) -> DataFrame:
    """Rows at multiples of step, and always the last."""
    return curves.where((F.col("removed") % step == 0) | (F.col("removed") == last))


def node_scores(orders: DataFrame, n_nodes: int | Column) -> DataFrame:
    """Mean and sample deviation of removal rank and fraction for each key and node, from orders(keys, stochastic_id, node, rank)."""
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    return orders.groupBy(*KEY, "node").agg(
        F.avg("rank").alias("mean_removal_rank"), F.stddev_samp("rank").alias("sd_removal_rank"),
        (F.avg("rank") / n).alias("mean_removal_fraction"), (F.stddev_samp("rank") / n).alias("sd_removal_fraction"),
        F.count("*").alias("n_replicates"),
    )


def node_scores_wide(scores: DataFrame, protocols: list[str], m_values: list[int], swept: str = "local_sensing") -> DataFrame:
    """A row for each node: a column for each protocol; for the swept one, up to 5 columns by m, or the mean over m."""
    value = F.col("mean_removal_fraction")
    cols = [F.max(F.when(F.col("protocol") == p, value)).alias(p) for p in protocols if p != swept]
    if swept in protocols:
        own = F.col("protocol") == swept
        if len(m_values) <= 5:
            cols += [F.max(F.when(own & (F.col("m") == m), value)).alias(f"{swept}_m{m:03d}") for m in m_values]
        else:
            cols.append(F.avg(F.when(own, value)).alias(f"{swept}_mavg"))
    return scores.groupBy("node").agg(*cols)


def in_order(df: DataFrame) -> DataFrame:
    """Result rows by label, protocol, m (none first) and what else tells them apart."""
    keys = [c for c in (*REPLICATE, "removed", "node") if c in df.columns]
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in keys])


def series(df: DataFrame, value: str, key: str = "node") -> DataFrame:
    """Rows from the greatest value down, ties by key: what a plot of it shows from left to right."""
    return df.orderBy(F.desc(value), key)


def average_over_m(frame: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def _grid_of_forest(edges: DataFrame, ranks: DataFrame, n: int, grid: list[int]) -> DataFrame:
    spark = edges.sparkSession
    ship(spark)
    table = ranks.select(F.col("node").cast("long"), F.col("rank").cast("int")).toArrow()
    ids, rank = table.column(0).to_numpy(), table.column(1).to_numpy()
    if len(ids) != n or not np.array_equal(np.sort(rank), np.arange(1, n + 1)):
        raise ValueError("ranks must be 1 to n_nodes, each once")
    by = np.argsort(ids)
    sent = spark.sparkContext.broadcast((ids[by], rank[by] - 1))

    def absorbed(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ends, by place in the order, of a forest of all pieces that lasts longest."""
        a, b, held, rows = np.zeros(0, np.int32), np.zeros(0, np.int32), [], 0
        for piece in itertools.chain(pieces, [None]):
            if piece is not None:
                held.append(piece)
                rows += len(piece[0])
            if held and (piece is None or rows >= FOREST_PIECE):
                a, b = (np.concatenate([x, *[p[i] for p in held]]) for i, x in enumerate((a, b)))
                taken = kernels.lasting_forest(n, a, b, np.minimum(a, b))
                a, b, held, rows = a[taken], b[taken], [], 0
        return a, b

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, place = sent.value

        def placed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                ends = [batch.column(i).to_numpy() for i in (0, 1)]
                at = [np.minimum(np.searchsorted(nodes, e), max(0, n - 1)) for e in ends]
                # as a join: edges of other nodes are left out
                ok = (nodes[at[0]] == ends[0]) & (nodes[at[1]] == ends[1]) & (ends[0] != ends[1]) if n else np.zeros(len(ends[0]), bool)
                yield place[at[0][ok]], place[at[1][ok]]

        a, b = absorbed(placed())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = absorbed((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)
        s1, s2 = kernels.removal_curve(kernels.Csr.of(np.stack([a, b], 1), range(n)), np.arange(n))
        at = np.array(grid, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(s1[at]), pa.array(s2[at])], ["removed", "s1", "s2"])

    ends = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    # few and large parts, so that forests are small beside the edges
    parts = ends.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(forest, "a int, b int")
    one = parts.repartition(1).mapInArrow(sizes, "removed long, s1 long, s2 long")
    return one.withColumn("s1_over_n", F.col("s1") / n).withColumn("s2_over_n", F.col("s2") / n)


def curve_on_grid(edges: DataFrame, ranks: DataFrame, n_nodes: int, grid: list[int], staged: Staged | None = None, most_nodes: int = MOST_RANKED) -> DataFrame:
    """(removed, s1, s2, s1_over_n, s2_over_n) after the first k nodes of ranks(node, rank) are gone, for each k of grid.

    An edge outlives k removals if both ranks are above k. Up to `most_nodes` nodes, whose ranks are 1 to n_nodes, tasks keep of
    their edges a forest that lasts longest, which joins the same nodes at every k, and one task merges the forests. Beyond,
    all grid points are one component search: a node at grid point g is the number g * (n + 1) + rank.
    """
    spark = edges.sparkSession
    if n_nodes <= most_nodes and {ranks.schema[c].dataType.typeName() for c in ("node", "rank")} <= {"long", "integer"}:
        return _grid_of_forest(edges, ranks, n_nodes, grid)
    staged = staged or Staged(spark)
    a, b = ranks.select(F.col("node").alias("src"), F.col("rank").alias("ra")), ranks.select(F.col("node").alias("dst"), F.col("rank").alias("rb"))
    ranked = edges.join(a, "src").join(b, "dst").select("ra", "rb")
    points = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(k).alias("k")) for g, k in enumerate(grid)]))
    alive = ranked.withColumn("x", points).where(F.least("ra", "rb") > F.col("x.k"))
    base = F.col("x.g").cast("long") * (n_nodes + 1)
    found = connected_components(alive.select((base + F.col("ra")).alias("src"), (base + F.col("rb")).alias("dst")), staged=staged, one_task=ONE_TASK)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).withColumn("g", F.floor(F.col("component") / (n_nodes + 1)).cast("int"))
    top = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("size")))
    two = sizes.withColumn("t", top).where("t <= 2").groupBy("g").agg(F.max(F.when(F.col("t") == 1, F.col("size"))).alias("s1"), F.max(F.when(F.col("t") == 2, F.col("size"))).alias("s2"))
    all_points = spark.createDataFrame([(g, k) for g, k in enumerate(grid)], "g int, removed long")
    left = F.lit(n_nodes) - F.col("removed")
    # nodes without an edge left are components of one
    s1 = F.coalesce("s1", F.when(left > 0, 1).otherwise(0)).cast("long")
    lone = left > F.coalesce("s1", F.lit(1))
    s2 = F.coalesce("s2", F.when(lone, 1).otherwise(0)).cast("long")
    out = all_points.join(F.broadcast(two), "g", "left").select("removed", s1.alias("s1"), s2.alias("s2"))
    return out.withColumn("s1_over_n", F.col("s1") / n_nodes).withColumn("s2_over_n", F.col("s2") / n_nodes)
