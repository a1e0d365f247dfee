"""Undirected graphs as edge and node tables: cleaning, degrees, sub-graphs, components, neighbourhood scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percola.operators import kernels
from percola.operators.components import connected_components
from percola.operators.ranking import positions
from percola.operators.robustness import MOST_ELEMENTS, Sent, gather_graph
from percola.session import Staged

#: Arcs between integers that one task merges at once (16 bytes each); more go in distributed rounds.
ONE_TASK = 1_000_000


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) with src < dst: mirrored, repeated and self edges collapse or go; null ends go."""
    return edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def self_loop_count(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.agg(F.count_if(F.col(src) == F.col(dst)).alias("n_self_loops"), F.count_if(F.col(src) != F.col(dst)).alias("n_other"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct nodes with an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions, from one scan."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select(both.alias("e")).select("e.node", "e.other")


def degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); with a node table, isolated nodes have 0."""
    out = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    if nodes is None:
        return out
    return nodes.select("node").join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_out_degree(arcs: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of a directed graph."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return arcs.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def induced_subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in kept(node)."""
    k = kept.select("node").distinct()
    return edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def remove_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges with no end in removed(node)."""
    r = removed.select("node").distinct()
    return edges.join(r.withColumnRenamed("node", "src"), "src", "left_anti").join(r.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def neighbours_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct neighbours of seeds(node); a seed is one if it has a seed as neighbour."""
    return symmetric(edges).join(seeds.select("node").distinct(), "node", "left_semi").select(F.col("other").alias("node")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, staged: Staged | None = None) -> DataFrame:
    """(node, component): component is the least node reachable; with a node table, isolated nodes are their own."""
    found = connected_components(edges, staged=staged, one_task=ONE_TASK)
    if nodes is None:
        return found
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count("*").alias("size"))


def top_two(sizes: DataFrame, n: int | Column) -> DataFrame:
    """(s1, s2, s1_over_n, s2_over_n) from component sizes: the two largest of the multiset, 0 where there are none."""
    two = sizes.orderBy(F.desc("size")).limit(2).agg(F.sort_array(F.collect_list("size"), asc=False).alias("t"))
    at = lambda i: F.coalesce(F.try_element_at("t", F.lit(i)), F.lit(0))
    n = F.lit(n) if isinstance(n, int) else n
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return two.select(at(1).alias("s1"), at(2).alias("s2"), share(at(1)).alias("s1_over_n"), share(at(2)).alias("s2_over_n"))


def largest_component(edges: DataFrame, nodes: DataFrame | None = None, staged: Staged | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the component with the most nodes; of several, the one with the least node."""
    staged = staged or Staged(edges.sparkSession)
    found = staged.put(components(edges, nodes, staged), "components")
    best = component_sizes(found).orderBy(F.desc("size"), "component").limit(1)
    kept = found.join(F.broadcast(best.select("component")), "component").select("node")
    return kept, induced_subgraph(edges, kept)


def relabel(nodes: DataFrame, edges: DataFrame | None = None, staged: Staged | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(mapping(new_id, original), edges in new ids): ids 1..N in ascending order, of numbers if node is one, else of bytes."""
    staged = staged or Staged(nodes.sparkSession)
    mapping = positions(nodes.select(F.col("node").alias("original")).distinct(), [F.col("original")], "new_id", staged).select("new_id", "original")
    if edges is None:
        return mapping, None
    mapping = staged.put(mapping, "mapping")
    a, b = mapping.select(F.col("original").alias("src"), F.col("new_id").alias("_a")), mapping.select(F.col("original").alias("dst"), F.col("new_id").alias("_b"))
    out = edges.join(a, "src").join(b, "dst").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))
    return mapping, out


def round_trip_check(nodes: DataFrame, edges: DataFrame, staged: Staged | None = None) -> DataFrame:
    """(n_nodes, n_components, contiguous): a written graph must have 1..N as nodes and one component."""
    found = components(edges, nodes, staged)
    return found.agg(
        F.count("*").alias("n_nodes"), F.count_distinct("component").alias("n_components"),
        ((F.min("node") == 1) & (F.max("node") == F.count("*"))).alias("contiguous"),
    )


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, n_common) of edges with common neighbours: wedges are opened at their end of lesser degree.

    Each edge points from its end of lesser (degree, node) to the other; a triangle is found once, from its
    least node, so a hub's neighbourhood is never paired with itself.
    """
    d = degree(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), d.select(F.col("node").alias("dst"), F.col("degree").alias("_b"))
    e = edges.join(a, "src").join(b, "dst")
    forward = F.struct("_a", "src") < F.struct("_b", "dst")
    out = e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    left, right = out.select("u", F.col("v").alias("x")), out.select("u", F.col("v").alias("y"))
    wedges = left.join(right, "u").where("x < y")
    closed = wedges.join(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    pair = lambda p, q: F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst"))
    three = closed.select(F.explode(F.array(pair("u", "x"), pair("u", "y"), pair("x", "y"))).alias("e"))
    return three.groupBy("e.src", "e.dst").agg(F.count("*").alias("n_common"))


def edge_neighbourhoods(edges: DataFrame, most: int = MOST_ELEMENTS) -> DataFrame:
    """(src, dst, n_common, n_union, similarity): neighbourhoods of an edge's ends without the ends; null similarity if both are empty.

    Tasks that hold the graph's arcs look lists up in one another, and no wedge is ever a row. Beyond `most` edges, or where
    nodes aren't integers, wedges are joined instead.
    """
    kinds = {edges.schema[c].dataType.typeName() for c in ("src", "dst")}
    if kinds <= {"long", "integer"}:
        staged = Staged(edges.sparkSession)
        edges = staged.put(edges.select("src", "dst"), "edges")
        if edges.count() <= most:
            return _looked_up(edges, staged)
    d = degree(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), d.select(F.col("node").alias("dst"), F.col("degree").alias("_b"))
    e = edges.join(common_neighbours(edges), ["src", "dst"], "left").join(a, "src").join(b, "dst")
    common = F.coalesce("n_common", F.lit(0))
    union = F.col("_a") - 1 + F.col("_b") - 1 - common
    return e.select("src", "dst", common.alias("n_common"), union.alias("n_union"), F.when(union > 0, common / union).alias("similarity"))


def _looked_up(edges: DataFrame, staged: Staged) -> DataFrame:
    spark = edges.sparkSession
    g = gather_graph(edges)
    staged.drop(edges)  # the arcs hold all of it
    sent = Sent(spark, g)
    tasks = max(1, min(g.n, spark.sparkContext.defaultParallelism * 8))
    # spans of nodes with about as many arcs
    cuts = np.unique(np.append(np.searchsorted(g.start, np.linspace(0, len(g.to), tasks, endpoint=False)), [0, g.n])).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = sent.graph()
        degree = graph.degrees()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for u, x, common in kernels.common_neighbours(graph, cuts[i], cuts[i + 1]):
                    ends = [pa.array(graph.nodes[f(u, x)]) for f in (np.minimum, np.maximum)]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(common), pa.array(degree[u] + degree[x] - 2 - common)], ["src", "dst", "n_common", "n_union"])

    n = max(1, len(cuts) - 1)
    found = spark.range(0, len(cuts) - 1, 1, n).mapInArrow(count, "src long, dst long, n_common long, n_union long")
    kept = [F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("src", "dst")]
    return found.select(*kept, "n_common", "n_union", F.when(F.col("n_union") > 0, F.col("n_common") / F.col("n_union")).alias("similarity"))


def dissimilarity_score(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree, score): mean over neighbours of 1 - similarity (0 for an empty union), times the square root of the degree."""
    s = edge_neighbourhoods(edges).withColumn("d", F.coalesce(1 - F.col("similarity"), F.lit(0.0)))
    ends = s.select(F.explode(F.array("src", "dst")).alias("node"), "d")
    out = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("d").alias("total"))
    out = out.select("node", "degree", (F.col("total") / F.col("degree") * F.sqrt("degree")).alias("score"))
    if nodes is None:
        return out
    return nodes.select("node").join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("score", F.lit(0.0)).alias("score"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of degrees over both directions of every edge."""
    d = degree(edges)
    arcs = symmetric(edges).join(d, "node").withColumnRenamed("degree", "a").join(d.select(F.col("node").alias("other"), F.col("degree").alias("b")), "other")
    return arcs.agg(F.corr("a", "b").alias("assortativity"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Sum over communities of inner / m - (degrees / 2m)^2, from labels(node, community)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("i")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("i")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.count("*").alias("d"), F.sum("x.i").alias("inner"))
    return per.agg(F.sum("d").alias("dd"), F.sum("inner").alias("l"), F.sum(F.col("d") * F.col("d")).alias("d2")).select(
        (F.col("l") / (F.col("dd") / 2) - F.col("d2") / (F.col("dd") * F.col("dd"))).alias("modularity")
    )
