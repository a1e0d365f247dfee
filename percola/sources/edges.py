"""Edge lists, node tables and result tables: readers and writers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.operators.graph import canonical_edges, endpoints


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def read_edge_list(spark: SparkSession, path: str, include_missing: bool = True, zero_indexed: bool = False) -> Graph:
    """Whitespace-separated integer pairs; further tokens, blank lines and lines that begin with # are ignored.

    Self-loops go but their end stays a node; repeats and mirrors collapse. With include_missing, nodes are
    all integers from 1 (0 if zero_indexed) to the greatest label. A line of one token, a token that is no
    integer, a label below the least, or a file without edges is an error.
    """
    least = 0 if zero_indexed else 1
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not startswith(line, '#')")
    part = F.split("line", " ")
    rows = rows.select("line", F.expr("try_cast(split(line, ' ')[0] as bigint)").alias("a"), F.expr("try_cast(try_element_at(split(line, ' '), 2) as bigint)").alias("b"), F.size(part).alias("n"))
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") < least) | (F.col("b") < least)
    fail = F.raise_error(F.concat(F.lit("not an edge: "), F.col("line"))).cast("bigint")
    pairs = rows.select(F.when(bad, fail).otherwise(F.col("a")).alias("src"), F.when(bad, fail).otherwise(F.col("b")).alias("dst"))
    top = pairs.agg(F.max(F.greatest("src", "dst")), F.count_if(F.col("src") != F.col("dst"))).first()
    if top[0] is None:
        raise ValueError(f"no edges in {path}")
    nodes = spark.range(least, top[0] + 1).withColumnRenamed("id", "node") if include_missing else endpoints(pairs)
    return Graph(nodes, canonical_edges(pairs))


def read_plain_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file that is known to be good: the first two numbers of each line, as they stand. Comments and blank lines go; nothing is checked, merged or filled."""
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    part = F.split("line", " ")
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not startswith(line, '#')")
    return rows.select(F.try_element_at(part, F.lit(1)).try_cast("bigint").alias("src"), F.try_element_at(part, F.lit(2)).try_cast("bigint").alias("dst"))


def read_header(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(N, E) from a comment `# N=... E=...` among the first five lines, if there is one."""
    head = spark.read.text(path).limit(5).select(F.regexp_extract("value", r"N=(\d+)\s+E=(\d+)", 1).alias("n"), F.regexp_extract("value", r"N=(\d+)\s+E=(\d+)", 2).alias("e")).where("n <> ''").collect()
    return (int(head[0]["n"]), int(head[0]["e"])) if head else None


def read_positional_edges(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """The first two columns of a CSV file (plain or gz), whatever their names, as (src, dst)."""
    df = spark.read.option("header", True).csv(path)
    a, b = df.columns[:2]
    return df.select(F.col(f"`{a}`").cast(kind).alias("src"), F.col(f"`{b}`").cast(kind).alias("dst"))


def read_nodes(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(original_id, lat, lon) from a CSV with the columns key, latitude and longitude."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(key).alias("original_id"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))


def number_by_key(edges: DataFrame, keys: DataFrame, key: str = "key", place: str = "row") -> tuple[DataFrame, DataFrame]:
    """Edges between string keys, and nodes, in numbers: keys(row, key) has each key's row, the last row of a repeated key counts.

    An end that has no key is an error.
    """
    last = keys.groupBy(key).agg(F.max(place).alias("id"))
    a, b = last.select(F.col(key).alias("src"), F.col("id").alias("_a")), last.select(F.col(key).alias("dst"), F.col("id").alias("_b"))
    missing = lambda end, c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no node for "), F.coalesce(end, F.lit("null")))).cast("bigint")).otherwise(F.col(c))
    out = edges.join(a, "src", "left").join(b, "dst", "left").select(missing("src", "_a").alias("src"), missing("dst", "_b").alias("dst"))
    return out, last.select("id", key)


def write_edge_list(edges: DataFrame, path: str, label: str, n_nodes: int) -> None:
    """One text file: three comments, then sorted `src dst 1` rows. Parquet is the form for large graphs."""
    n = edges.count()
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, 0, i, x) for i, x in enumerate((f"# {label}", f"# N={n_nodes} E={n}", "# src dst weight"))], "s long, d long, i int, value string")
    rows = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(9).alias("i"), F.concat_ws(" ", F.least("src", "dst"), F.greatest("src", "dst"), F.lit(1)).alias("value"))
    both = head.union(rows).withColumn("body", F.col("i") == 9)
    both.repartition(1).sortWithinPartitions("body", "i", "s", "d").select("value").write.mode("overwrite").text(path)


def write_node_mapping(mapping: DataFrame, path: str) -> None:
    """CSV of new_id, original_id, lat and lon."""
    mapping.select("new_id", "original_id", "lat", "lon").write.mode("overwrite").option("header", True).csv(path)


RESULT_SCHEMAS = {
    "node_mapping": ("new_id bigint, original_id string, lat double, lon double"),
    "raw": ("label string, protocol string, m int, stochastic_id int, removed int, p double, s1_over_n double, s2_over_n double"),
}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; empty fields are null."""
    reader = spark.read.option("header", True).option("nanValue", "")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str, decimals: dict[str, int] | None = None, order_by: list | None = None) -> None:
    """One CSV file with a header, for results that a person reads: numbers with fixed decimals where asked, nulls empty, in order."""
    if order_by:
        df = df.orderBy(*order_by).coalesce(1)
    fixed = [F.format_string(f"%.{decimals[c]}f", F.col(c)).alias(c) if decimals and c in decimals else F.col(c) for c in df.columns]
    nulls = [F.when(F.col(o).isNotNull(), c).alias(o) for c, o in zip(fixed, df.columns, strict=True)]
    df.select(*nulls).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Decimals of the tables of PageRank sweeps: probabilities and distances, and the damping.
RANK_DECIMALS = {"classical": 10, "quantum": 10, "fidelity_quantum": 10, "fidelity_classical": 10, "diff_quantum": 10, "diff_classical": 10, "alpha": 6}


def write_ranks(ranks: DataFrame, path: str, key: str | None = None) -> None:
    """walk_pagerank's result as CSV: node, classical and quantum, after the graph's key if one is named."""
    keys = [key] if key else []
    write_table(ranks.select(*keys, "node", "classical", "quantum"), path, {c: RANK_DECIMALS[c] for c in ("classical", "quantum")}, [*keys, "node"])


def write_sweep(sweep: DataFrame, path: str) -> None:
    """damping_sweep's result as CSV, by alpha."""
    columns = ["alpha", "fidelity_quantum", "fidelity_classical", "diff_quantum", "diff_classical"]
    write_table(sweep.select(*columns), path, {c: RANK_DECIMALS[c] for c in columns}, ["alpha"])


def key_faults(edges: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(n_repeated_keys, n_orphans): rows of keys beyond the first of a key, and distinct ends of edges without a key."""
    repeated = keys.agg((F.count(key) - F.count_distinct(key)).alias("n_repeated_keys"))
    ends = endpoints(edges).join(keys.select(F.col(key).alias("node")).distinct(), "node", "left_anti")
    return repeated.crossJoin(F.broadcast(ends.agg(F.count("node").alias("n_orphans"))))


def load_config(path: str, known: set[str]) -> dict:
    """A JSON object of defaults and `networks`; unknown keys, no networks, and networks without a label are errors."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    return checked_config(config, known)


def checked_config(config: dict, known: set[str]) -> dict:
    if not isinstance(config.get("networks"), dict) or not config["networks"]:
        raise ValueError("networks must be a non-empty object")
    if unknown := set(config) - known - {"networks", "order", "run_order", "python"}:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    for name, net in config["networks"].items():
        if not isinstance(net, dict):
            raise ValueError(f"{name}: an object is required")
        if unknown := set(net) - known - {"label", "enabled", "edge_file", "outdir"}:
            raise ValueError(f"{name}: unknown keys {sorted(unknown)}")
        if not str(net.get("label") or "").strip():
            raise ValueError(f"{name}: a label is required")
    return config
