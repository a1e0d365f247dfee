"""Directed random and recursive graphs, and small fixed graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.operators import kernels
from percola.operators.graph import components
from percola.session import Staged


def erdos_renyi(spark: SparkSession, n: int = 128, p: float = 0.05, seed: int = 0, tries: int = 20) -> DataFrame:
    """Arcs of a directed G(n, p): each pair by a hash of (seed, src, dst). Later seeds are tried until it is weakly connected."""
    staged = Staged(spark)
    ids = spark.range(n)
    for t in range(tries):
        uniform = F.pmod(F.xxhash64(F.lit(seed + t), "src", "dst"), F.lit(1 << 53)) / float(1 << 53)
        arcs = staged.put(ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where((F.col("src") != F.col("dst")) & (uniform < p)), "arcs")
        if components(arcs, ids.withColumnRenamed("id", "node"), staged).select("component").distinct().count() == 1:
            return arcs
    raise RuntimeError(f"no weakly connected G({n}, {p}) in {tries} tries")


def scale_free(spark: SparkSession, n: int = 128, seed: int = 0, alpha: float = 0.41, beta: float = 0.54, shift: float = 0.2) -> DataFrame:
    """Arcs of a directed scale-free graph without repeats or loops.

    Grown from a 3-cycle: with chance alpha a new node points to an old one by in-degree, with beta an old one
    by out-degree points to one by in-degree, else an old one by out-degree points to a new one.
    """
    rng = np.random.default_rng(seed)
    heads, tails, size = [1, 2, 0], [0, 1, 2], 3

    def drawn(ends: list[int], extra: float) -> int:
        total = len(ends) + extra * size
        return int(rng.integers(size)) if rng.random() * total < extra * size else ends[int(rng.integers(len(ends)))]

    while size < n:
        u = rng.random()
        if u < alpha:
            v, w = size, drawn(heads, shift)
            size += 1
        elif u < alpha + beta:
            v, w = drawn(tails, 0.0), drawn(heads, shift)
        else:
            v, w = drawn(tails, 0.0), size
            size += 1
        tails.append(v)
        heads.append(w)
    arcs = sorted({(a, b) for a, b in zip(tails, heads, strict=True) if a != b})
    return spark.createDataFrame(arcs, "src long, dst long")


def hierarchical(spark: SparkSession, level: int) -> DataFrame:
    return spark.createDataFrame(kernels.hierarchical(level)[1], "src long, dst long")


def small_graphs() -> dict[str, tuple[int, list[tuple[int, int]]]]:
    """(N, edges) of graphs for checks: path, cycle, triangles with isolates, barbell, star, complete, and four random ones."""
    rng = np.random.default_rng(7)
    # pairs in ascending order draw one number each, so that the graphs are always the same
    random = {f"random_{n}": (n, [(u, w) for u in range(1, n + 1) for w in range(u + 1, n + 1) if rng.random() < p]) for n, p in ((20, 0.1), (30, 0.15), (40, 0.08), (25, 0.3))}
    clique = lambda at, k: [(at + i, at + j) for i in range(k) for j in range(i + 1, k)]
    return {
        "path": (10, [(i, i + 1) for i in range(1, 10)]),
        "cycle": (10, [(i, i % 10 + 1) for i in range(1, 11)]),
        "triangles": (9, clique(1, 3) + clique(4, 3)),
        "barbell": (10, clique(1, 5) + clique(6, 5) + [(5, 6)]),
        "star": (12, [(1, i) for i in range(2, 13)]),
        "complete": (8, clique(1, 8)),
        **random,
    }
