"""PageRank of directed graphs, classical and by quantum walk."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from percola.operators import kernels
from percola.session import Staged, ship

#: Nodes of a graph whose walk runs in one task: its state has a number for each ordered pair.
MOST_WALK_NODES = 3000


def arcs_of(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-arcs."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def arc_nodes(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def transition(arcs: DataFrame) -> DataFrame:
    """(src, dst, w): a share of src for each of its out-links; rows of nodes without any are left out."""
    out = arcs.groupBy("src").agg(F.count("*").alias("d"))
    return arcs.join(out, "src").select("src", "dst", (1.0 / F.col("d")).alias("w"))


def google_matrix(arcs: DataFrame, alpha: float = 0.85, nodes: DataFrame | None = None) -> DataFrame:
    """(i, j, g) for every pair of nodes: for small graphs only, as PageRank never needs it."""
    nodes = (arc_nodes(arcs) if nodes is None else nodes).select("node")
    n = nodes.count()
    if n > MOST_WALK_NODES:
        raise ValueError(f"{n} nodes; at most {MOST_WALK_NODES} make a full matrix")
    w = transition(arcs).select(F.col("dst").alias("i"), F.col("src").alias("j"), "w")
    dangling = nodes.join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("j"), F.lit(True).alias("none"))
    pairs = nodes.select(F.col("node").alias("i")).crossJoin(nodes.select(F.col("node").alias("j")))
    link = F.when(F.col("none"), F.lit(1.0 / n)).otherwise(F.coalesce("w", F.lit(0.0)))
    return pairs.join(w, ["i", "j"], "left").join(dangling, "j", "left").select("i", "j", (alpha * link + (1 - alpha) / n).alias("g"))


def pagerank(
    arcs: DataFrame, alpha: float = 0.85, iterations: int | None = None, tolerance: float = 1e-12, most: int = 10_000,
    nodes: DataFrame | None = None, staged: Staged | None = None, test_every: int = 4,
) -> DataFrame:
    """(node, rank): uniform start; nodes without out-links share theirs with all; divided by their sum.

    Links are written once in buckets of their source, so that they never move again. A step joins the ranks to them
    and sums what arrives, together with a zero for every node, in one aggregation; its narrow result is written, so
    a step is computed once. What nodes without links hold is a one-row sum over the written ranks. Without a number
    of iterations, every test_every steps the largest change is held against the tolerance. Steps keep the
    sum at 1 but for rounding, so that one division at the end is enough.
    """
    staged = staged or Staged(arcs.sparkSession)
    arcs = staged.put(arcs.select("src", "dst"), "arcs")
    nodes = staged.put((arc_nodes(arcs) if nodes is None else nodes).select("node").distinct(), "nodes")
    n = nodes.count()
    links = staged.put_bucketed(transition(arcs), "links", "src")
    lone = nodes.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("lone", F.lit(1.0))
    rank = nodes.join(lone, "node", "left").select("node", F.coalesce("lone", F.lit(0.0)).alias("lone"), F.lit(1.0 / max(1, n)).alias("rank"))
    rank = staged.put(rank, "rank")
    for step in range(1, (most if iterations is None else iterations) + 1):
        sent = rank.select(F.col("node").alias("src"), "rank").join(links, "src").select(F.col("dst").alias("node"), F.lit(0.0).alias("lone"), (F.col("rank") * F.col("w")).alias("x"))
        every = sent.union(rank.select("node", "lone", F.lit(0.0).alias("x"))).groupBy("node").agg(F.max("lone").alias("lone"), F.sum("x").alias("x"))
        held = rank.agg(F.coalesce(F.sum(F.col("rank") * F.col("lone")), F.lit(0.0)).alias("held"))
        new = every.crossJoin(F.broadcast(held)).select("node", "lone", (alpha * (F.col("x") + F.col("held") / n) + (1 - alpha) / n).alias("rank"))
        before, rank = rank, staged.put(new, "rank")
        if iterations is None and step % test_every == 0:
            change = rank.alias("a").join(before.alias("b"), "node").agg(F.max(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
            if change is None or change < tolerance:
                break
        staged.drop(before)
    return rank.crossJoin(F.broadcast(rank.agg(F.sum("rank").alias("total")))).select("node", (F.col("rank") / F.col("total")).alias("rank"))


def quantum_init(g: DataFrame) -> DataFrame:
    """(j, k, a): amplitudes sqrt(g(k, j) / n)."""
    n = g.select("i").distinct().count()
    return g.select("j", F.col("i").alias("k"), F.sqrt(F.col("g") / n).alias("a"))


def quantum_step(state: DataFrame, g: DataFrame) -> DataFrame:
    """One reflection about the rows of sqrt(g), with the registers swapped."""
    s = state.join(g.select("j", F.col("i").alias("k"), F.sqrt("g").alias("r")), ["j", "k"])
    c = s.groupBy("j").agg(F.sum(F.col("r") * F.col("a")).alias("c"))
    return s.join(c, "j").select(F.col("k").alias("j"), F.col("j").alias("k"), (2 * F.col("r") * F.col("c") - F.col("a")).alias("a"))


def quantum_average(g: DataFrame, steps: int, staged: Staged | None = None) -> DataFrame:
    """(node, iq_mean, iq_var): mean and population variance of sum over j of a(j, node)^2 over steps 0..steps-1."""
    staged = staged or Staged(g.sparkSession)
    g = staged.put(g, "google")
    state = staged.put(quantum_init(g), "state")
    series = None
    for t in range(steps):
        now = state.groupBy("k").agg(F.sum(F.col("a") * F.col("a")).alias("iq")).select(F.col("k").alias("node"), "iq")
        series = now if series is None else series.union(now)
        if t + 1 < steps:
            state = staged.put(quantum_step(state, g), "state")
    return series.groupBy("node").agg(F.avg("iq").alias("iq_mean"), F.var_pop("iq").alias("iq_var"))


def walk_pagerank(arcs: DataFrame, alphas: list[float], steps: int | None = None, key: str = "graph") -> DataFrame:
    """(graph, alpha, node, classical, quantum, quantum_var, steps) for each graph of arcs(graph, src, dst) and alpha: a task each.

    A column `steps` of arcs gives each graph its number of steps; else `steps` does, and without either walks go on until they settle.
    """
    spark = arcs.sparkSession
    ship(spark)
    kind = arcs.schema[key].dataType.simpleString()

    def part(name, table):
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        if len(nodes) > MOST_WALK_NODES:
            raise ValueError(f"{len(nodes)} nodes; a walk takes at most {MOST_WALK_NODES}")
        alpha = table.column("alpha")[0].as_py()
        a, b = ends[: len(src)], ends[len(src) :]
        fixed = table.column("steps")[0].as_py()
        matrix = kernels.google_matrix(len(nodes), a, b, alpha)
        mean, var, used = kernels.quantum_walk(matrix, fixed)
        n = len(nodes)
        return pa.table({key: pa.array([name[0].as_py()] * n, table.schema.field(key).type), "alpha": pa.array([alpha] * n), "node": pa.array(nodes.astype(np.int64)), "classical": pa.array(kernels.power_iteration(matrix)), "quantum": pa.array(mean), "quantum_var": pa.array(var), "steps": pa.array([used] * n, pa.int64())})

    many = F.col("steps") if "steps" in arcs.columns else F.lit(steps)
    work = arcs.select(key, F.col("src").cast("long"), F.col("dst").cast("long"), many.cast("long").alias("steps"), F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    return work.groupBy(key, "alpha").applyInArrow(part, f"`{key}` {kind}, alpha double, node long, classical double, quantum double, quantum_var double, steps long")


def damping_sweep(arcs: DataFrame, alphas: list[float] | None = None, reference: float = 0.85, key: str = "graph") -> DataFrame:
    """(graph, alpha, fidelity_quantum, fidelity_classical, diff_quantum, diff_classical) against the reference alpha.

    The reference walk of a graph settles once; the other alphas take as many steps.
    """
    from percola.operators.statistics import fidelity, largest_difference

    alphas = [float(a) for a in np.linspace(0.01, 0.98, 30)] if alphas is None else alphas
    staged = Staged(arcs.sparkSession)
    settled = staged.put(walk_pagerank(arcs, [reference], key=key), "reference")
    others = sorted({*alphas} - {reference})
    if others:
        timed = arcs.select(key, "src", "dst").join(settled.groupBy(key).agg(F.max("steps").alias("steps")), key)
        every = staged.put(settled.unionByName(walk_pagerank(timed, others, key=key)), "walks")
    else:
        every = settled
    ref = settled.select(key, "node", F.col("classical").alias("c0"), F.col("quantum").alias("q0"))
    return every.where(F.col("alpha").isin(alphas)).join(ref, [key, "node"]).groupBy(key, "alpha").agg(
        fidelity("quantum", "q0").alias("fidelity_quantum"), fidelity("classical", "c0").alias("fidelity_classical"),
        largest_difference("quantum", "q0").alias("diff_quantum"), largest_difference("classical", "c0").alias("diff_classical"),
    )


