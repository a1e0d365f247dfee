"""The registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from percola.functions import scalar
from percola.operators import curves, graph, ranking, robustness, statistics, walks
from percola.operators.robustness import RunConfig
from percola.plans import workflows
from percola.session import Staged
from percola.sources import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _plain_m(df: DataFrame) -> DataFrame:
    """0 where there is no m: results compare alike whatever stands for a missing integer."""
    return df.withColumn("m", F.coalesce("m", F.lit(0)))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def with_views(body: str, recursive: bool = False, **parts: str) -> str:
    keyed = {"c": "c(node, component) USING KEY (node)", "cc": "cc(k, node, component) USING KEY (k, node)"} if recursive else {}
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{keyed[k]} AS ({q})" if k in keyed else f"{k} AS MATERIALIZED ({q})" for k, q in parts.items()) + " " + body


CP = v.COPURCHASE_SQL
PS, EF, UF = v.PART_SUPPLIER_SQL, v.EVENT_FLOW_SQL, v.USER_FLOW_SQL
SYM = "SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e"
DEG = "SELECT node, count(*) AS degree FROM sym GROUP BY node"
# each round, a node takes the least label of the neighbours that changed; a table keyed by node holds the labels
COMP = "SELECT DISTINCT node, node AS component FROM sym UNION SELECT s.node, min(w.component) FROM c w JOIN sym s ON s.other = w.node JOIN recurring.c r ON r.node = s.node WHERE w.component < r.component GROUP BY s.node"

# --- cleaning, projections, filters -------------------------------------------------------------


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey")
def edges_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return graph.canonical_edges(v.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(with_views("SELECT count(*) FILTER (src = dst) AS n_self_loops, count(*) FILTER (src <> dst) AS n_other FROM e", e=EF))
def edges_self_loop_count(spark: SparkSession, sf: str) -> DataFrame:
    return graph.self_loop_count(v.event_flow(spark, sf))


@query(with_views("SELECT count(*) AS n_edges FROM e", e=CP))
def edge_count(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_count(v.copurchase(spark, sf))


@query(with_views("SELECT a.src, a.dst FROM e a JOIN k x ON a.src = x.node JOIN k y ON a.dst = y.node", e=CP, k="SELECT p_partkey AS node FROM part WHERE p_size <= 25"))
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    kept = v.table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return graph.induced_subgraph(v.copurchase(spark, sf), kept)


@query(with_views("SELECT src, dst FROM e WHERE src NOT IN (SELECT node FROM k) AND dst NOT IN (SELECT node FROM k)", e=CP, k="SELECT p_partkey AS node FROM part WHERE p_size <= 10"))
def remove_nodes(spark: SparkSession, sf: str) -> DataFrame:
    gone = v.table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return graph.remove_nodes(v.copurchase(spark, sf), gone)


@query(with_views("SELECT DISTINCT s.other AS node FROM sym s JOIN k ON s.node = k.node", e=CP, sym=SYM, k="SELECT p_partkey AS node FROM part WHERE p_size = 7"))
def neighbour_expand(spark: SparkSession, sf: str) -> DataFrame:
    seeds = v.table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    return graph.neighbours_of(v.copurchase(spark, sf), seeds)


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.86) / 2), 2) + cos(radians(48.86)) * cos(radians(lat)) * pow(sin(radians(lon - 2.35) / 2), 2))))"


@query(with_views(f"SELECT node, round({HAVERSINE}, 6) AS km FROM c WHERE {HAVERSINE} <= 2000.0", c=v.PLACES_SQL))
def haversine_radius(spark: SparkSession, sf: str) -> DataFrame:
    km = scalar.haversine_km(F.lit(48.86), F.lit(2.35), F.col("lat"), F.col("lon"))
    return v.places(spark, sf).withColumn("km", km).where("km <= 2000.0").select("node", F.round("km", 6).alias("km"))


@query(with_views("SELECT node, original_id, regexp_extract(original_id, '^([^_.]*)', 1) AS prefix FROM c WHERE regexp_extract(original_id, '^([^_.]*)', 1) = upper('building') AND NOT starts_with(original_id, 'BUFFER')", c=v.PLACES_SQL))
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = scalar.root_prefix(F.col("original_id"))
    return v.places(spark, sf).withColumn("prefix", p).where((F.col("prefix") == F.upper(F.lit("building"))) & ~F.startswith("original_id", F.lit("BUFFER"))).select("node", "original_id", "prefix")


@query(with_views(
    "SELECT count(*) AS n_rows, count(*) FILTER (la IS NULL OR lo IS NULL OR isnan(la) OR isnan(lo)) AS n_missing, count(*) FILTER (la IS NOT NULL AND lo IS NOT NULL AND NOT isnan(la) AND NOT isnan(lo) AND NOT (la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180)) AS n_out_of_range FROM d",
    c=v.PLACES_SQL, d="SELECT CASE WHEN node % 11 = 0 THEN NULL WHEN node % 13 = 0 THEN 'NaN'::DOUBLE ELSE lat * 1.01 END AS la, lon AS lo FROM c",
))
def latlon_sanity(spark: SparkSession, sf: str) -> DataFrame:
    lat = F.when(F.col("node") % 11 == 0, F.lit(None).cast("double")).when(F.col("node") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("lat") * 1.01)
    return statistics.coordinate_check(v.places(spark, sf).withColumn("lat", lat))


_GAPS = "SELECT node, CASE WHEN node % 11 = 0 THEN NULL WHEN node % 13 = 0 THEN 'NaN'::DOUBLE ELSE lat END AS lat, CASE WHEN node % 7 > 0 THEN lon END AS lon FROM c"


def _with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    lat = F.when(F.col("node") % 11 == 0, F.lit(None).cast("double")).when(F.col("node") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("lat"))
    return v.places(spark, sf).select("node", lat.alias("lat"), F.when(F.col("node") % 7 > 0, F.col("lon")).alias("lon"))


@query(with_views("SELECT count(*) AS n_rows, count(*) FILTER (lat IS NULL OR isnan(lat) OR lon IS NULL) AS n_with_null FROM g", c=v.PLACES_SQL, g=_GAPS))
def null_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.null_rows(_with_gaps(spark, sf))


@query(with_views("SELECT node FROM g WHERE lat IS NOT NULL AND NOT isnan(lat) AND lon IS NOT NULL", c=v.PLACES_SQL, g=_GAPS))
def drop_without_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.with_coordinates(_with_gaps(spark, sf)).select("node")


@query(with_views("SELECT label, protocol, coalesce(m, 0) AS m, stochastic_id, removed, p FROM c WHERE removed % 3 = 0 OR removed = 20", c=v.CURVES_SQL))
def curve_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return _plain_m(curves.subsample(v.synthetic_curves(spark, sf), 3, F.lit(20)).select("label", "protocol", "m", "stochastic_id", "removed", "p"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.duplicate_count(v.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


# --- joins, unions -------------------------------------------------------------------------------


@query("SELECT c_custkey AS node, n_name, n_orders, total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def master_left_join(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    n = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), "c_nationkey").join(n, "c_nationkey", "left").join(o, "node", "left").select("node", "n_name", "n_orders", "total")


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans_anti(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("node")).join(v.table(spark, sf, "orders").select(F.col("o_custkey").alias("node")), "node", "left_anti")


@query("SELECT 'customer' AS label, c_nationkey AS nation, round(avg(c_acctbal), 6) AS mean_balance FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, round(avg(s_acctbal), 6) FROM supplier GROUP BY 2")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda t, k, b: v.table(spark, sf, t).groupBy(F.col(k).alias("nation")).agg(F.round(F.avg(b), 6).alias("mean_balance")).select(F.lit(t).alias("label"), "nation", "mean_balance")
    return part("customer", "c_nationkey", "c_acctbal").unionByName(part("supplier", "s_nationkey", "s_acctbal"))


@query("SELECT node FROM ((SELECT l_partkey AS node FROM lineitem WHERE l_quantity >= 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09) EXCEPT SELECT p_partkey FROM part WHERE p_size = 1)")
def node_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    line = v.table(spark, sf, "lineitem")
    part = lambda c: line.where(c).select(F.col("l_partkey").alias("node"))
    return part("l_quantity >= 45").intersect(part("l_discount >= 0.09")).subtract(v.table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


# --- degrees, orders, relabelling ----------------------------------------------------------------


@query(with_views("SELECT node, degree FROM d", e=PS, sym=SYM, d=DEG))
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(v.part_supplier(spark, sf))


@query(with_views("SELECT p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON p_partkey = node", e=CP, sym=SYM, d=DEG))
def degree_with_isolates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(v.copurchase(spark, sf), v.table(spark, sf, "part").select(F.col("p_partkey").alias("node")))


@query(with_views("SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node", e="SELECT DISTINCT src, dst FROM (" + EF + ")"))
def in_out_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_out_degree(v.event_flow(spark, sf).distinct()).select("node", F.col("in_degree").cast("long"), F.col("out_degree").cast("long"))


@query(with_views("SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM d", e=CP, sym=SYM, d=DEG))
def order_degree_static(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.positions(graph.degree(v.copurchase(spark, sf)), [-F.col("degree"), F.col("node")]).select("node", "rank")


@query(with_views("SELECT node, row_number() OVER (ORDER BY md5('7|1|' || node::VARCHAR)) AS rank FROM (SELECT DISTINCT node FROM sym)", e=CP, sym=SYM))
def order_random_hash(spark: SparkSession, sf: str) -> DataFrame:
    nodes = graph.endpoints(v.copurchase(spark, sf))
    return ranking.positions(nodes, [F.md5(F.concat(F.lit("7|1|"), F.col("node").cast("string")).cast("binary"))])


@query(with_views("SELECT row_number() OVER (ORDER BY node) AS new_id, node AS original FROM (SELECT DISTINCT node FROM sym)", e=CP, sym=SYM))
def relabel_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relabel(graph.endpoints(v.copurchase(spark, sf)))[0]


@query(with_views("SELECT row_number() OVER (ORDER BY original_id) AS new_id, original_id AS original FROM c", c=v.PLACES_SQL))
def relabel_string(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relabel(v.places(spark, sf).select(F.col("original_id").alias("node")))[0]


# --- neighbourhoods, communities -----------------------------------------------------------------

COMMON = "SELECT e.src, e.dst, count(*) AS c FROM e JOIN sym a ON a.node = e.src JOIN sym b ON b.node = e.dst AND a.other = b.other GROUP BY ALL"
PAIRS = "SELECT e.src, e.dst, coalesce(c, 0) AS n_common, x.degree - 1 + y.degree - 1 - coalesce(c, 0) AS n_union FROM e LEFT JOIN cm ON e.src = cm.src AND e.dst = cm.dst JOIN d x ON x.node = e.src JOIN d y ON y.node = e.dst"


@query(with_views("SELECT src, dst, n_common, n_union, round(CASE WHEN n_union > 0 THEN n_common / n_union END, 8) AS similarity FROM pr", e=CP, sym=SYM, d=DEG, cm=COMMON, pr=PAIRS))
def edge_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_neighbourhoods(v.copurchase(spark, sf)).withColumn("similarity", F.round("similarity", 8))


@query(with_views(
    "SELECT node, count(*) AS degree, round(sum(CASE WHEN n_union > 0 THEN 1 - n_common / n_union ELSE 0 END) / count(*) * sqrt(count(*)), 7) AS score FROM (SELECT src AS node, n_common, n_union FROM pr UNION ALL SELECT dst, n_common, n_union FROM pr) GROUP BY node",
    e=CP, sym=SYM, d=DEG, cm=COMMON, pr=PAIRS,
))
def node_dissimilarity_score(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dissimilarity_score(v.copurchase(spark, sf)).withColumn("score", F.round("score", 7))


@query(with_views("SELECT round(corr(a.degree, b.degree), 8) AS assortativity FROM sym JOIN d a ON a.node = sym.node JOIN d b ON b.node = sym.other", e=CP, sym=SYM, d=DEG))
def assortativity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.assortativity(v.copurchase(spark, sf)).select(F.round("assortativity", 8).alias("assortativity"))


@query(with_views(
    "SELECT round(sum(inn) / (sum(dg) / 2.0::DOUBLE) - sum(dg * dg) / (sum(dg)::DOUBLE * sum(dg)::DOUBLE), 8) AS modularity FROM x",
    e=CP, l="SELECT p_partkey AS node, p_brand AS c FROM part", ed="SELECT a.c AS ca, b.c AS cb FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst",
    x="SELECT c, sum(i)::DOUBLE AS inn, count(*)::DOUBLE AS dg FROM (SELECT ca AS c, (ca = cb)::INT AS i FROM ed UNION ALL SELECT cb, 0 FROM ed) GROUP BY c",
))
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    labels = v.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return graph.modularity(v.copurchase(spark, sf), labels).select(F.round("modularity", 8).alias("modularity"))


# --- components ----------------------------------------------------------------------------------


@query(with_views("SELECT node, component FROM c", True, e=CP, sym=SYM, c=COMP))
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(v.copurchase(spark, sf))


@query(with_views("SELECT component, count(*) AS size FROM c GROUP BY component", True, e=CP, sym=SYM, c=COMP))
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_sizes(graph.components(v.copurchase(spark, sf)))


@query(with_views("SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)", True, e=CP, sym=SYM, c=COMP))
def lcc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.largest_component(v.copurchase(spark, sf))[0]


ORDERED = "SELECT -o_custkey AS src, o_orderkey AS dst FROM orders"


@query(with_views("SELECT component, count(*) AS size FROM c GROUP BY component", True, e=ORDERED, sym=SYM, c=COMP))
def component_sizes_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their orders: many components."""
    return graph.component_sizes(graph.components(v.table(spark, sf, "orders").select((-F.col("o_custkey")).alias("src"), F.col("o_orderkey").alias("dst"))))


@query(with_views(
    "SELECT s[1] AS s1, coalesce(s[2], 0) AS s2, round(s[1] / n, 8) AS s1_over_n, round(coalesce(s[2], 0) / n, 8) AS s2_over_n FROM (SELECT list(k ORDER BY k DESC) AS s, sum(k)::BIGINT AS n FROM z)",
    True, e=CP, sym=SYM, c=COMP, z="SELECT count(*) AS k FROM c GROUP BY component",
))
def s1_s2(spark: SparkSession, sf: str) -> DataFrame:
    staged = Staged(spark)
    sizes = staged.put(graph.component_sizes(graph.components(v.copurchase(spark, sf), staged=staged)), "sizes")
    out = graph.top_two(sizes, sizes.agg(F.sum("size")).first()[0])
    return out.select("s1", "s2", F.round("s1_over_n", 8).alias("s1_over_n"), F.round("s2_over_n", 8).alias("s2_over_n"))


@query(with_views("SELECT count(*) AS n_nodes, count(DISTINCT component) AS n_components, min(node) = 1 AND max(node) = count(*) AS contiguous FROM c", True, e=CP, sym=SYM, c=COMP))
def round_trip(spark: SparkSession, sf: str) -> DataFrame:
    e = v.copurchase(spark, sf)
    return graph.round_trip_check(graph.endpoints(e), e)


@query(with_views(
    "SELECT count(*) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, count(*) FILTER (component = top) AS lcc_nodes, (SELECT count(*) FROM e JOIN c x ON x.node = e.src, b WHERE x.component = b.top) AS lcc_edges, round(100.0::DOUBLE * count(*) FILTER (component <> top) / count(*), 6) AS pct_nodes_dropped, round(100.0::DOUBLE * (SELECT count(*) FROM e JOIN c x ON x.node = e.src, b WHERE x.component <> b.top) / (SELECT count(*) FROM e), 6) AS pct_edges_dropped FROM c, b",
    True, e=CP, sym=SYM, c=COMP, b="SELECT component AS top FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1",
))
def lcc_share(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(workflows.lcc_share(v.copurchase(spark, sf)), 6)


LOCAL = "SELECT original_id, c_acctbal AS s FROM c WHERE regexp_extract(original_id, '^([^_.]*)', 1) = 'BUILDING'"


@query(with_views(
    "SELECT original_id, rg AS rank_global, rl AS rank_local, (rg <= n / 4 AND rl >= 3 * n / 4) OR (rl <= n / 4 AND rg >= 3 * n / 4) AS rank_disagreement FROM r, (SELECT count(*)::DOUBLE AS n FROM j)",
    c=v.PLACES_SQL, l=LOCAL, j="SELECT l.original_id, l.s, -c.node % 97 AS g FROM l JOIN c USING (original_id)",
    r="SELECT original_id, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2 AS rg, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rl FROM j",
))
def local_vs_global(spark: SparkSession, sf: str) -> DataFrame:
    places = v.places(spark, sf)
    whole = places.select("original_id", (-F.col("node") % 97).cast("double").alias("s"))
    local = places.where(workflows.in_country("building")).select("original_id", F.col("c_acctbal").alias("s"))
    return workflows.local_vs_global(whole, local, "s").select("original_id", "rank_global", "rank_local", "rank_disagreement")


@query(with_views(
    "SELECT k AS removed, coalesce(max(sz) FILTER (t = 1), CASE WHEN n > k THEN 1 ELSE 0 END)::BIGINT AS s1, coalesce(max(sz) FILTER (t = 2), CASE WHEN n - k > coalesce(max(sz) FILTER (t = 1), 1) THEN 1 ELSE 0 END)::BIGINT AS s2 FROM g LEFT JOIN top ON top.gk = g.k GROUP BY k, n",
    True, e=CP, sym=SYM, d=DEG, r="SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM d",
    g="SELECT floor((SELECT count(*) FROM r) * i / 20)::BIGINT AS k, (SELECT count(*) FROM r) AS n FROM range(21) q(i)",
    alive="SELECT k, ra.node AS a, rb.node AS b FROM g, sym JOIN r ra ON ra.node = sym.node JOIN r rb ON rb.node = sym.other WHERE least(ra.rank, rb.rank) > k",
    cc="SELECT DISTINCT k, a AS node, a AS component FROM alive UNION SELECT s.k, s.a, min(w.component) FROM cc w JOIN alive s ON s.k = w.k AND s.b = w.node JOIN recurring.cc r ON r.k = s.k AND r.node = s.a WHERE w.component < r.component GROUP BY s.k, s.a",
    sz="SELECT k AS gk, component, count(*) AS sz FROM cc GROUP BY 1, 2",
    top="SELECT gk, sz, row_number() OVER (PARTITION BY gk ORDER BY sz DESC) AS t FROM sz",
))
def curve_kgrid(spark: SparkSession, sf: str) -> DataFrame:
    staged = Staged(spark)
    e = staged.put(v.copurchase(spark, sf), "edges")
    ranks = staged.put(ranking.positions(graph.degree(e), [-F.col("degree"), F.col("node")], "rank", staged), "ranks")
    n = ranks.count()
    return curves.curve_on_grid(e, ranks.select("node", "rank"), n, [n * i // 20 for i in range(21)], staged).select("removed", "s1", "s2")


# --- curves and metrics --------------------------------------------------------------------------

LAGGED = "SELECT *, lag(p) OVER w AS p0, lag(s1_over_n) OVER w AS a0, lag(s2_over_n) OVER w AS b0 FROM c WINDOW w AS (PARTITION BY label, protocol, m, stochastic_id ORDER BY removed)"


def _crossing(t: float) -> str:
    at = f"CASE WHEN p0 IS NULL OR a0 = s1_over_n THEN p ELSE p0 + ({t} - a0) * (p - p0) / (s1_over_n - a0) END"
    return f"arg_min({at}, removed) FILTER (s1_over_n <= {t})"


METRICS = (
    "SELECT label, protocol, m, stochastic_id, coalesce(sum((p - p0) * (s1_over_n + a0) / 2), 0) AS auc_s1, coalesce(sum((p - p0) * (s2_over_n + b0) / 2), 0) AS auc_s2, "
    + ", ".join(f"{_crossing(t)} AS {curves.threshold_name(t)}" for t in curves.THRESHOLDS)
    + ", max(s2_over_n) AS max_s2_over_n, arg_max(p, s2_over_n * 1000000 - removed / 1000.0) AS p_at_max_s2 FROM lg GROUP BY label, protocol, m, stochastic_id"
)
METRIC_NAMES = ["auc_s1", "auc_s2", *[curves.threshold_name(t) for t in curves.THRESHOLDS], "max_s2_over_n", "p_at_max_s2"]


def _rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    df = _plain_m(df) if "m" in df.columns else df
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return curves.curve_metrics(v.synthetic_curves(spark, sf))


def _metric_sql(*names: str) -> str:
    return with_views("SELECT label, protocol, coalesce(m, 0) AS m, stochastic_id, " + ", ".join(f"round({n}, 7) AS {n}" for n in names) + " FROM mt", c=v.CURVES_SQL, lg=LAGGED, mt=METRICS)


KEYS = ["label", "protocol", "m", "stochastic_id"]


@query(_metric_sql("auc_s1", "auc_s2"))
def curve_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_metrics(spark, sf).select(*KEYS, "auc_s1", "auc_s2"))


@query(_metric_sql(*[curves.threshold_name(t) for t in curves.THRESHOLDS]))
def curve_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_metrics(spark, sf).select(*KEYS, *[curves.threshold_name(t) for t in curves.THRESHOLDS]))


@query(_metric_sql("max_s2_over_n", "p_at_max_s2"))
def curve_peak_s2(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_metrics(spark, sf).select(*KEYS, "max_s2_over_n", "p_at_max_s2"))


@query(_metric_sql(*METRIC_NAMES))
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_metrics(spark, sf))


def _sem_sql(c: str) -> str:
    return f"CASE WHEN count({c}) > 1 THEN stddev_samp({c}) / sqrt(count({c})) ELSE 0 END"


@query(with_views(
    "SELECT label, protocol, coalesce(m, 0) AS m, " + ", ".join(f"round(avg({n}), 6) AS mean_{n}, round(stddev_samp({n}), 6) AS sd_{n}" + (f", round({_sem_sql(n)}, 6) AS sem_{n}" if n.startswith("auc_") else "") for n in METRIC_NAMES) + ", count(*) AS n FROM mt GROUP BY label, protocol, mt.m",
    c=v.CURVES_SQL, lg=LAGGED, mt=METRICS,
))
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(curves.metrics_summary(_metrics(spark, sf)), 6)


@query(with_views(
    "SELECT label, protocol, coalesce(m, 0) AS m, removed, min(p) AS p, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS sd_{c}, round({_sem_sql(c)}, 6) AS sem_{c}" for c in ("s1_over_n", "s2_over_n")) + ", count(*) AS n FROM c GROUP BY label, protocol, c.m, removed",
    c=v.CURVES_SQL,
))
def curve_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(curves.curve_summary(v.synthetic_curves(spark, sf)), 6)


SCORES = "SELECT label, protocol, m, node, avg(rank) AS mean_removal_rank, stddev_samp(rank) AS sd_removal_rank, avg(rank) / n AS mean_removal_fraction, stddev_samp(rank) / n AS sd_removal_fraction, count(*) AS n_replicates FROM o, (SELECT count(*) AS n FROM supplier) GROUP BY label, protocol, m, node, n"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return curves.node_scores(v.hash_orders(spark, sf), v.table(spark, sf, "supplier").count())


@query(with_views("SELECT label, protocol, coalesce(m, 0) AS m, node, " + ", ".join(f"round({c}, 7) AS {c}" for c in ("mean_removal_rank", "sd_removal_rank", "mean_removal_fraction", "sd_removal_fraction")) + ", n_replicates FROM s", o=v.ORDERS_SQL, s=SCORES))
def node_scores_long(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_scores(spark, sf))


@query(with_views("SELECT node, round(max(mean_removal_fraction) FILTER (protocol = 'random'), 7) AS random, round(avg(mean_removal_fraction) FILTER (protocol = 'local_sensing'), 7) AS local_sensing_mavg FROM s GROUP BY node", o=v.ORDERS_SQL, s=SCORES))
def node_scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(curves.node_scores_wide(_scores(spark, sf), ["random", "local_sensing"], list(range(1, 8))))


@query(with_views("SELECT label, protocol, removed, round(avg(x), 6) AS mean_s1 FROM (SELECT label, protocol, m, removed, avg(s1_over_n) AS x FROM c GROUP BY ALL) GROUP BY ALL", c=v.CURVES_SQL))
def m_average(spark: SparkSession, sf: str) -> DataFrame:
    s = curves.curve_summary(v.synthetic_curves(spark, sf)).select("label", "protocol", "removed", F.col("mean_s1_over_n").alias("mean_s1"))
    return _rounded(curves.average_over_m(s, ["label", "protocol", "removed"], ["mean_s1"]), 6)


# --- statistics ----------------------------------------------------------------------------------

RANKED = "SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS rd FROM p"


@query(with_views("SELECT round(corr(rs, rd), 8) AS spearman FROM r", p=v.PART_SCORES_SQL, r=RANKED))
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.spearman(v.part_scores(spark, sf), "score", "degree"), 8)


@query(with_views("SELECT round(corr(score, degree), 8) AS pearson FROM p", p=v.PART_SCORES_SQL))
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return v.part_scores(spark, sf).agg(F.round(F.corr("score", "degree"), 8).alias("pearson"))


@query(with_views("SELECT node, rd AS avg_rank FROM r", p=v.PART_SCORES_SQL, r=RANKED))
def avg_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.average_rank(v.part_scores(spark, sf), "degree", "avg_rank").select("node", "avg_rank")


@query(with_views("SELECT node, score, degree, load FROM p WHERE score <= (SELECT quantile_cont(score, 0.25) FROM p) AND degree <= (SELECT median(degree) FROM p) AND load <= (SELECT median(load) FROM p)", p=v.PART_SCORES_SQL))
def quantile_hidden(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.hidden_vulnerable(v.part_scores(spark, sf), "score", "degree", "load").select("node", "score", "degree", "load")


@query(with_views("SELECT node, community, round(avg(score) OVER (PARTITION BY community), 6) AS community_mean FROM p", p=v.PART_SCORES_SQL))
def group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.group_mean(v.part_scores(spark, sf), "community", "score", "community_mean").select("node", "community", "community_mean"), 6)


# the normal equations of three centred predictors, solved by cofactors
_OLS = {
    "p": v.PART_SCORES_SQL, "q": "SELECT *, degree::DOUBLE AS a, load AS b, avg(score) OVER (PARTITION BY community) AS c, score AS y FROM p",
    "m": "SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM q",
    "z": "SELECT node, a - ma AS a, b - mb AS b, c - mc AS c, y - my AS y FROM q, m",
    "s": "SELECT sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc, sum(a*y) ay, sum(b*y) yb, sum(c*y) cy, sum(y*y) yy FROM z",
    "dt": "SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM s",
    "k": "SELECT ((bb*cc-bc*bc)*ay + (ac*bc-ab*cc)*yb + (ab*bc-ac*bb)*cy)/det AS ka, ((ac*bc-ab*cc)*ay + (aa*cc-ac*ac)*yb + (ab*ac-aa*bc)*cy)/det AS kb, ((ab*bc-ac*bb)*ay + (ab*ac-aa*bc)*yb + (aa*bb-ab*ab)*cy)/det AS kc, ay, yb, cy, yy FROM dt",
}


def _ols(spark: SparkSession, sf: str) -> tuple[DataFrame, list, float | None]:
    staged = Staged(spark)
    df = staged.put(statistics.group_mean(v.part_scores(spark, sf), "community", "score", "community_mean"), "attributes")
    coefficients, r2 = statistics.least_squares(df, "score", ["degree", "load", "community_mean"])
    return df, coefficients, r2


@query(with_views("SELECT round((ka*ay + kb*yb + kc*cy) / yy, 6) AS r2 FROM k", **_OLS))
def ols_r2(spark: SparkSession, sf: str) -> DataFrame:
    _, _, r2 = _ols(spark, sf)
    return spark.createDataFrame([(r2,)], "r2 double").select(F.round("r2", 6).alias("r2"))


@query(with_views("SELECT node, round(y - ka*a - kb*b - kc*c, 4) AS regression_residual FROM z, k ORDER BY round(y - ka*a - kb*b - kc*c, 4), node LIMIT 20", **_OLS))
def ols_residual_top20(spark: SparkSession, sf: str) -> DataFrame:
    df, coefficients, _ = _ols(spark, sf)
    out = statistics.residuals(df, "score", ["degree", "load", "community_mean"], coefficients)
    return out.select("node", F.round("regression_residual", 4).alias("regression_residual")).orderBy("regression_residual", "node").limit(20)


@query(with_views(
    "SELECT k AS n_top, (SELECT count(*) FROM lo SEMI JOIN hi USING (node)) AS n_both, round((SELECT count(*) FROM lo SEMI JOIN hi USING (node)) / (SELECT count(*) FROM (SELECT * FROM lo UNION SELECT * FROM hi)), 8) AS jaccard FROM k",
    p=v.PART_SCORES_SQL, k="SELECT greatest(1, round_even(0.05 * count(*), 0))::BIGINT AS k FROM p",
    lo="SELECT node FROM p ORDER BY score, node LIMIT (SELECT k FROM k)", hi="SELECT node FROM p ORDER BY load DESC, node LIMIT (SELECT k FROM k)",
))
def topk_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.top_overlap(v.part_scores(spark, sf), "score", "load"), 8)


@query(with_views("SELECT node, rs, rd, (rs <= n / 4 AND rd >= 3 * n / 4) OR (rd <= n / 4 AND rs >= 3 * n / 4) AS rank_disagreement FROM r, (SELECT count(*)::DOUBLE AS n FROM p)", p=v.PART_SCORES_SQL, r=RANKED))
def rank_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    staged = Staged(spark)
    df = ranking.average_rank(ranking.average_rank(v.part_scores(spark, sf), "score", "rs", staged), "degree", "rd", staged)
    return statistics.rank_disagreement(staged.put(df.select("node", "rs", "rd"), "ranks"), "rs", "rd")


@query(with_views("SELECT node, round(6 + 54 * (degree - lo) / (hi - lo), 8) AS size FROM p, (SELECT min(degree) AS lo, max(degree) AS hi FROM p)", p=v.PART_SCORES_SQL))
def minmax_size(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(statistics.min_max_size(v.part_scores(spark, sf), "degree").select("node", "size"), 8)


# --- PageRank and quantum walk -------------------------------------------------------------------


def _rank_ctes(edges: str, alpha: float, steps: int) -> dict[str, str]:
    """A common table expression for each step."""
    out = {
        "e": f"SELECT DISTINCT src, dst FROM ({edges}) WHERE src <> dst", "nd": "SELECT src AS node FROM e UNION SELECT dst FROM e", "nn": "SELECT count(*)::DOUBLE AS n FROM nd",
        "od": "SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY src", "lk": "SELECT e.src, e.dst, 1 / d AS w FROM e JOIN od ON e.src = od.src", "p0": "SELECT node, 1 / n AS r FROM nd, nn",
    }
    for i in range(1, steps + 1):
        out[f"h{i}"] = f"SELECT coalesce(sum(r), 0) AS held FROM p{i - 1} WHERE node NOT IN (SELECT src FROM od)"
        out[f"i{i}"] = f"SELECT dst AS node, sum(r * w) AS x FROM p{i - 1} JOIN lk ON lk.src = node GROUP BY dst"
        out[f"u{i}"] = f"SELECT nd.node, {alpha} * (coalesce(x, 0) + held / n) + (1 - {alpha}) / n AS r FROM nd LEFT JOIN i{i} ON i{i}.node = nd.node, h{i}, nn"
        out[f"p{i}"] = f"SELECT node, r / (SELECT sum(r) FROM u{i}) AS r FROM u{i}"
    return out


def _materialised(body: str, parts: dict[str, str]) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({q})" for k, q in parts.items()) + " " + body


GOOGLE = {
    "e": f"SELECT DISTINCT src, dst FROM ({EF}) WHERE src <> dst", "nd": "SELECT src AS node FROM e UNION SELECT dst FROM e", "nn": "SELECT count(*)::DOUBLE AS n FROM nd",
    "od": "SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY src",
    "g": "SELECT a.node AS i, b.node AS j, 0.85::DOUBLE * CASE WHEN d IS NULL THEN 1 / n WHEN e.src IS NULL THEN 0 ELSE 1 / d END + 0.15::DOUBLE / n AS g FROM nd a CROSS JOIN nd b CROSS JOIN nn LEFT JOIN od ON od.src = b.node LEFT JOIN e ON e.src = b.node AND e.dst = a.node",
}


def _event_arcs(spark: SparkSession, sf: str) -> DataFrame:
    return Staged(spark).put(walks.arcs_of(v.event_flow(spark, sf)), "arcs")


@query(_materialised("SELECT i, j, round(g, 8) AS g FROM g", GOOGLE))
def google_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(walks.google_matrix(_event_arcs(spark, sf)), 8)


@query(_materialised("SELECT node, round(r, 8) AS rank FROM p20", _rank_ctes(UF, 0.85, 20)))
def pagerank_fixed20(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(walks.pagerank(walks.arcs_of(v.user_flow(spark, sf)), iterations=20), 8)


@query(_materialised("SELECT node, round(r, 5) AS rank FROM p60", _rank_ctes(PS.replace("-l_suppkey AS src, l_partkey AS dst", "l_partkey AS src, -l_suppkey AS dst"), 0.85, 60)))
def pagerank_settled(spark: SparkSession, sf: str) -> DataFrame:
    arcs = v.part_supplier(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _rounded(walks.pagerank(arcs, tolerance=1e-8), 5)


INIT = {"st0": "SELECT j, i AS k, sqrt(g / n) AS a FROM g, nn"}


def _walk_ctes(steps: int) -> dict[str, str]:
    out = dict(INIT)
    for t in range(1, steps + 1):
        out[f"c{t}"] = f"SELECT s.j, sum(sqrt(g) * a) AS c FROM st{t - 1} s JOIN g ON g.j = s.j AND g.i = s.k GROUP BY s.j"
        out[f"st{t}"] = f"SELECT s.k AS j, s.j AS k, 2 * sqrt(g) * c - a AS a FROM st{t - 1} s JOIN g ON g.j = s.j AND g.i = s.k JOIN c{t} x ON x.j = s.j"
    return out


@query(_materialised("SELECT j, k, round(a, 8) AS a FROM st0", GOOGLE | INIT))
def quantum_init(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(walks.quantum_init(walks.google_matrix(_event_arcs(spark, sf))), 8)


@query(_materialised("SELECT j, k, round(a, 8) AS a FROM st1", GOOGLE | _walk_ctes(1)))
def quantum_step(spark: SparkSession, sf: str) -> DataFrame:
    g = Staged(spark).put(walks.google_matrix(_event_arcs(spark, sf)), "google")
    return _rounded(walks.quantum_step(walks.quantum_init(g), g), 8)


@query(_materialised(
    "SELECT node, round(avg(q), 8) AS iq_mean, round(var_pop(q), 8) AS iq_var FROM (" + " UNION ALL ".join(f"SELECT k AS node, sum(a * a) AS q FROM st{t} GROUP BY k" for t in range(5)) + ") GROUP BY node", GOOGLE | _walk_ctes(4)
))
def quantum_avg_t5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(walks.quantum_average(walks.google_matrix(_event_arcs(spark, sf)), 5), 8)


def _two(a: dict[str, str], b: dict[str, str]) -> dict[str, str]:
    import re

    return a | {f"z{k}": re.sub(r"\b([hiup]\d+)\b", r"z\1", q) for k, q in b.items() if re.fullmatch(r"[hiup]\d+", k)}


TWO_RANKS = _two(_rank_ctes(UF, 0.85, 10), _rank_ctes(UF, 0.5, 10))


def _two_ranks(spark: SparkSession, sf: str) -> DataFrame:
    arcs = Staged(spark).put(walks.arcs_of(v.user_flow(spark, sf)), "arcs")
    a, b = walks.pagerank(arcs, iterations=10), walks.pagerank(arcs, 0.5, iterations=10)
    return a.withColumnRenamed("rank", "p").join(b.withColumnRenamed("rank", "q"), "node")


@query(_materialised("SELECT round(sum(sqrt(a.r * b.r)), 7) AS fidelity FROM p10 a JOIN zp10 b USING (node)", TWO_RANKS))
def fidelity(spark: SparkSession, sf: str) -> DataFrame:
    return _two_ranks(spark, sf).agg(F.round(statistics.fidelity("p", "q"), 7).alias("fidelity"))


@query(_materialised("SELECT round(max(abs(a.r - b.r)), 7) AS linf FROM p10 a JOIN zp10 b USING (node)", TWO_RANKS))
def linf_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _two_ranks(spark, sf).agg(F.round(statistics.largest_difference("p", "q"), 7).alias("linf"))


@query(_materialised("SELECT round(sum(abs(a.r - b.r)) / 2, 7) AS total_variation, round(abs(sum(a.r) - 1), 7) AS deviation FROM p10 a JOIN zp10 b USING (node)", TWO_RANKS))
def total_variation(spark: SparkSession, sf: str) -> DataFrame:
    return _two_ranks(spark, sf).agg(F.round(statistics.total_variation("p", "q"), 7).alias("total_variation"), F.round(F.abs(F.sum("p") - 1), 7).alias("deviation"))


@query(_materialised(
    "SELECT x.node, round(r, 8) AS classical, round(avg(q), 8) AS quantum, round(var_pop(q), 8) AS quantum_var FROM (" + " UNION ALL ".join(f"SELECT k AS node, sum(a * a) AS q FROM st{t} GROUP BY k" for t in range(5)) + ") x JOIN p80 USING (node) GROUP BY x.node, r",
    GOOGLE | _walk_ctes(4) | {k: q for k, q in _rank_ctes(EF, 0.85, 80).items() if k not in GOOGLE},
))
def quantum_pagerank_t5(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel's walk of five steps, and classical ranks."""
    arcs = walks.arcs_of(v.event_flow(spark, sf)).withColumn("graph", F.lit("events"))
    return _rounded(walks.walk_pagerank(arcs, [0.85], steps=5).select("node", "classical", "quantum", "quantum_var"), 8)


@query()
def quantum_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    arcs = walks.arcs_of(v.event_flow(spark, sf)).withColumn("graph", F.lit("events"))
    return walks.walk_pagerank(arcs, [0.85])


@query()
def damping_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return walks.damping_sweep(walks.arcs_of(v.event_flow(spark, sf)).withColumn("graph", F.lit("events")))


@query()
def topology_sweep(spark: SparkSession, sf: str) -> DataFrame:
    from percola.sources import generators as g

    graphs = [("erdos_renyi", g.erdos_renyi(spark)), ("scale_free", g.scale_free(spark)), *[(f"hierarchical_{n}", g.hierarchical(spark, n)) for n in (2, 3, 4)]]
    arcs = None
    for name, a in graphs:
        a = a.select(F.lit(name).alias("graph"), "src", "dst")
        arcs = a if arcs is None else arcs.unionByName(a)
    return walks.walk_pagerank(arcs, [0.85])


# --- combinations and simulations ----------------------------------------------------------------

COMBOS = """SELECT p AS protocol, CASE WHEN p = 'local_sensing' THEN mm::INT ELSE 0 END AS m, r::INT AS stochastic_id,
  p || '__m' || CASE WHEN p = 'local_sensing' THEN lpad(mm::VARCHAR, 3, '0') ELSE 'NA' END || '__rep' || lpad(r::VARCHAR, 4, '0') AS key
FROM (SELECT unnest(['random', 'degree', 'adap_degree', 'betweenness', 'adap_betweenness', 'local_sensing']) AS p), range(1, 21) q(mm), range(1, 101) t(r)
WHERE (p = 'local_sensing' OR mm = 1) AND (p NOT IN ('degree', 'betweenness') OR r = 1)"""


@query(COMBOS)
def combos(spark: SparkSession, sf: str) -> DataFrame:
    c = RunConfig()
    return _plain_m(robustness.combos(spark, list(c.protocols), c.m_values, c.n_attacks))


@query(f"WITH c AS ({COMBOS}) SELECT protocol, m, stochastic_id, key FROM c WHERE NOT (stochastic_id <= 40 AND m <= 10)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    c = RunConfig()
    work = robustness.combos(spark, list(c.protocols), c.m_values, c.n_attacks)
    return _plain_m(robustness.unfinished(work, work.where("stochastic_id <= 40 and (m is null or m <= 10)")))


def _attack(spark: SparkSession, sf: str, protocols: list[str], m_values: list[int], n_attacks: int, view=v.copurchase, **settings) -> DataFrame:
    edges = Staged(spark).put(view(spark, sf), "edges")
    config = RunConfig(label=view.__name__, protocols=tuple(protocols), n_attacks=n_attacks, **settings)
    done = robustness.simulate(edges, robustness.combos(spark, protocols, m_values, n_attacks), config)
    return curves.metrics_summary(curves.curve_metrics(robustness.curves_of(Staged(spark).put(done, "results"))))


@query()
def adaptive_degree(spark: SparkSession, sf: str) -> DataFrame:
    return _attack(spark, sf, ["random", "degree", "adap_degree"], [], 8)


@query()
def score_attack(spark: SparkSession, sf: str) -> DataFrame:
    return _attack(spark, sf, ["local_sensing"], [1, 10], 4, v.customer_flow)


@query()
def adaptive_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return _attack(spark, sf, ["betweenness", "adap_betweenness"], [], 2, v.customer_flow, btw_update=50)


@query()
def adaptive_betweenness_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of 64 sampled sources: an estimate."""
    return _attack(spark, sf, ["betweenness", "adap_betweenness"], [], 2, v.customer_flow, btw_update=50, btw_k=64)


@query()
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    return robustness.louvain(v.copurchase(spark, sf))


# breadth-first levels with path counts from every node, then dependencies from the last level back
PATHS = "SELECT node AS s, node, 0 AS d, 1.0::DOUBLE AS sigma FROM (SELECT DISTINCT node FROM sym) UNION SELECT w.s, x.other, min(w.d) + 1, sum(w.sigma) FROM bfs w JOIN sym x ON x.node = w.node ANTI JOIN recurring.bfs r ON r.s = w.s AND r.node = x.other GROUP BY w.s, x.other"
BACK = """SELECT s, node, d, 0.0::DOUBLE AS delta FROM bfs WHERE d = (SELECT max(d) FROM bfs)
  UNION ALL SELECT b.s, b.node, b.d, coalesce(b.sigma * h.share, 0.0) FROM bfs b
  LEFT JOIN (SELECT w.s, x.other AS node, sum((1 + w.delta) / t.sigma) AS share FROM back w JOIN bfs t ON t.s = w.s AND t.node = w.node JOIN sym x ON x.node = w.node GROUP BY ALL) h ON h.s = b.s AND h.node = b.node
  WHERE b.d = (SELECT max(d) FROM back) - 1"""
BETWEENNESS = (
    f"WITH RECURSIVE e AS MATERIALIZED ({CP}), sym AS MATERIALIZED ({SYM}), bfs(s, node, d, sigma) USING KEY (s, node) AS ({PATHS}), back(s, node, d, delta) AS ({BACK}) "
    "SELECT node, round(sum(delta) FILTER (s <> node) / 2, 6) AS betweenness FROM back GROUP BY node"
)


FLOW_BETWEENNESS = BETWEENNESS.replace(CP, v.CUSTOMER_FLOW_SQL)


@query(FLOW_BETWEENNESS.replace("betweenness FROM", "b FROM").replace("SELECT node, round", "SELECT node, row_number() OVER (ORDER BY b DESC, node) AS rank FROM (SELECT node, round") + ")")
def order_betweenness_static(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by static betweenness, the greatest first; ties by node."""
    scores = robustness.betweenness(v.customer_flow(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))
    return ranking.positions(scores, [-F.col("betweenness"), F.col("node")]).select("node", "rank")


@query(BETWEENNESS)
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return robustness.betweenness(v.copurchase(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def betweenness_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of 256 sampled sources, scaled to all: an estimate."""
    return robustness.betweenness(v.copurchase(spark, sf), k=256)


@query()
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Cascades from the nodes that local sensing removes first and from those of the greatest betweenness."""
    staged = Staged(spark)
    edges = staged.put(v.customer_flow(spark, sf), "edges")
    config = RunConfig(label="customer_flow", protocols=("local_sensing",), n_attacks=2)
    orders = robustness.orders_of(robustness.simulate(edges, robustness.combos(spark, ["local_sensing"], [1], 2), config))
    scores = curves.node_scores(orders, F.lit(1)).select("node", F.col("mean_removal_rank").alias("score"))
    loads = staged.put(robustness.betweenness(edges), "betweenness")
    triggers = staged.put(robustness.cascade_triggers(scores, loads), "triggers")
    return robustness.cascades(edges, triggers, scores=loads)


@query(with_views("SELECT trigger_type, round(avg(x), 8) AS mean_fraction FROM t GROUP BY trigger_type", t="SELECT c_mktsegment AS trigger_type, c_custkey % 97 / 97.0::DOUBLE AS x FROM customer"))
def cascade_means(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("trigger_type"), (F.col("c_custkey") % 97 / 97.0).alias("cascade_fraction"))
    return _rounded(workflows.cascade_means(c), 8)


@query(with_views(
    "SELECT label, protocol, round(avg(a), 6) AS mean_auc_s1, round(avg(b), 6) AS mean_p_lcc_0_5, CASE label WHEN '1' THEN 'power' WHEN '2' THEN 'rail' ELSE 'other' END AS category FROM ms GROUP BY label, protocol",
    c=v.CURVES_SQL, lg=LAGGED, mt=METRICS, ms="SELECT label, protocol, m, avg(auc_s1) AS a, avg(p_lcc_0_5) AS b FROM mt GROUP BY ALL",
))
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = curves.metrics_summary(_metrics(spark, sf))
    out = workflows.category_summary(summary, ["random", "local_sensing"], {"1": "power", "2": "rail"})
    return _rounded(out.select("label", "protocol", "mean_auc_s1", "mean_p_lcc_0_5", "category"), 6)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the network survives a degree attack: order, curve and metrics of the co-purchase graph."""
    return _attack(spark, sf, ["degree"], [], 1)
