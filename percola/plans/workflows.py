"""Raw tables to a prepared network, local sub-networks, and the tables that compare scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percola.functions.scalar import haversine_km, root_prefix
from percola.operators import graph
from percola.operators.ranking import average_rank
from percola.operators.statistics import coordinate_check, rank_disagreement
from percola.session import Staged


@dataclass
class Prepared:
    """edges in ids 1..N; mapping(new_id, original_id, lat, lon); a row of counts."""

    edges: DataFrame
    mapping: DataFrame
    stats: DataFrame


def lcc_share(edges: DataFrame, nodes: DataFrame | None = None, staged: Staged | None = None) -> DataFrame:
    """(n_nodes, n_edges, lcc_nodes, lcc_edges, pct_nodes_dropped, pct_edges_dropped)"""
    staged = staged or Staged(edges.sparkSession)
    edges = staged.put(edges, "edges")
    kept, inner = graph.largest_component(edges, nodes, staged)
    n = (nodes if nodes is not None else graph.endpoints(edges)).agg(F.count("*").alias("n_nodes"))
    counts = [n, edges.agg(F.count("*").alias("n_edges")), kept.agg(F.count("*").alias("lcc_nodes")), inner.agg(F.count("*").alias("lcc_edges"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))
    dropped = lambda kept_, all_: F.when(F.col(all_) > 0, 100.0 * (F.col(all_) - F.col(kept_)) / F.col(all_)).otherwise(0.0)
    return out.withColumn("pct_nodes_dropped", dropped("lcc_nodes", "n_nodes")).withColumn("pct_edges_dropped", dropped("lcc_edges", "n_edges"))


def prepare_network(raw: DataFrame, attributes: DataFrame) -> Prepared:
    """Clean raw(src, dst), keep its largest component, number its nodes 1..N, and count what was dropped.

    attributes(original_id, lat, lon) are optional per node: a node without them keeps nulls and counts as an orphan.
    """
    staged = Staged(raw.sparkSession)
    edges = staged.put(graph.canonical_edges(raw), "edges")
    kept, inner = graph.largest_component(edges, None, staged)
    mapping, numbered = graph.relabel(staged.put(kept, "kept"), inner, staged)
    full = staged.put(mapping.select("new_id", F.col("original").alias("original_id")).join(attributes.dropDuplicates(["original_id"]), "original_id", "left").select("new_id", "original_id", "lat", "lon"), "mapping")
    stats = lcc_share(edges, None, staged).crossJoin(F.broadcast(graph.self_loop_count(raw).select("n_self_loops"))).crossJoin(F.broadcast(coordinate_check(full).select("n_missing", "n_out_of_range")))
    return Prepared(staged.put(numbered, "numbered"), full, stats)


def within(lat: float, lon: float, radius_km: float = 40.0) -> Column:
    return haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= radius_km


def in_country(code: str) -> Column:
    """By the prefix of original_id; buffer zones are left out."""
    return (root_prefix(F.col("original_id")) == F.upper(F.lit(code))) & ~F.startswith("original_id", F.lit("BUFFER"))


def extract_local(edges: DataFrame, mapping: DataFrame, keep: Column) -> Prepared:
    """The largest component of the sub-network of nodes that `keep` selects, numbered anew; original ids are kept."""
    staged = Staged(edges.sparkSession)
    chosen = staged.put(mapping.where(keep), "chosen")
    nodes = chosen.select(F.col("new_id").alias("node"))
    inner = staged.put(graph.induced_subgraph(edges, nodes), "inner")
    kept, local = graph.largest_component(inner, nodes, staged)
    new, numbered = graph.relabel(staged.put(kept, "kept"), local, staged)
    back = new.select(F.col("new_id").alias("local_id"), F.col("original").alias("new_id")).join(chosen, "new_id")
    back = back.select(F.col("local_id").alias("new_id"), "original_id", "lat", "lon")
    return Prepared(staged.put(numbered, "numbered"), staged.put(back, "mapping"), lcc_share(inner, nodes, staged))


def master_table(mapping: DataFrame, descriptors: DataFrame, scores: DataFrame, adaptive: DataFrame | None = None) -> DataFrame:
    """mapping with descriptors and scores by node; what a table lacks is null."""
    out = mapping.withColumnRenamed("new_id", "node")
    for other in (descriptors, scores, adaptive):
        out = out if other is None else out.join(other, "node", "left")
    return out


def local_vs_global(whole: DataFrame, local: DataFrame, score: str) -> DataFrame:
    """Nodes in both tables by original_id, their average-tie ranks in each, and whether the ranks disagree by three quarters."""
    staged = Staged(whole.sparkSession)
    both = local.select("original_id", F.col(score).alias("score_local")).join(whole.select("original_id", F.col(score).alias("score_global")), "original_id")
    ranked = average_rank(average_rank(both, "score_global", "rank_global", staged), "score_local", "rank_local", staged)
    return rank_disagreement(staged.put(ranked, "ranked"), "rank_global", "rank_local")


def category_summary(metrics: DataFrame, protocols: list[str], categories: dict[str, str]) -> DataFrame:
    """Mean metrics over m for each network and protocol, with the network's category."""
    names = [c for c in metrics.columns if c.startswith(("mean_auc", "mean_p_lcc"))]
    category = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in categories.items()], F.lit("other"))
    return metrics.where(F.col("protocol").isin(protocols)).groupBy("label", "protocol").agg(*[F.avg(c).alias(c) for c in names]).withColumn("category", category)


def cascade_means(cascades: DataFrame) -> DataFrame:
    return cascades.groupBy("trigger_type").agg(F.avg("cascade_fraction").alias("mean_fraction"))
