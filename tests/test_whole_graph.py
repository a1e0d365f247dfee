"""Queries over the co-purchase graph of every line, whatever its quantity."""

import pytest

from percola.plans import queries as q
from percola.sources import views as v

LINES = [(1, 1, 50.0), (1, 2, 1.0), (2, 2, 3.0), (2, 3, 44.0), (3, 4, 47.0), (3, 5, 49.0), (4, 6, None), (4, 7, 2.0)]
EDGES = {(1, 2), (2, 3), (4, 5), (6, 7)}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    parts = [(i, 5 + i, f"b{i % 2}") for i in range(1, 9)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").write.parquet(f"{at}/part.parquet")
    return at


def test_every_line_counts(spark, sf):
    rows = lambda name: sorted(map(tuple, q.QUERIES[name](spark, sf).collect()))
    assert rows("edge_count") == [(4,)]
    assert rows("components") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert {r[:2] for r in rows("edge_jaccard")} == EDGES
    nodes = set(range(1, 8))
    assert {r[0] for r in rows("louvain")} == nodes
    assert {r[0]: r[1] for r in rows("betweenness")} == {n: 1.0 if n == 2 else 0.0 for n in nodes}
    # S1 of the intact graph is 3 of 7 nodes, and the curve's area follows from it
    assert q.flagship(spark, sf).count() == 1


def test_no_query_cuts_the_table():
    used = [n for n, sql in q.SQL.items() if "a.l_partkey < b.l_partkey" in sql]
    assert len(used) > 15 and not any("l_quantity" in q.SQL[n] for n in used)
    assert not any(n.endswith("_all") for n in q.QUERIES)


def test_customer_flow_takes_every_order(spark, tmp_path):
    orders = [(1, 7, "d1"), (2, 8, "d1"), (3, 8, "d1"), (4, 7, "d1"), (5, 9, "d2"), (6, 7, "d2"), (7, 3, "d3"), (8, None, "d2")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, v.customer_flow(spark, str(tmp_path)).collect())) == [(7, 8), (7, 9)]
    rows = q.QUERIES["cascade"](spark, str(tmp_path)).collect()
    assert {r.trigger_type for r in rows} == {"score", "betweenness"} and all(r.cascade_fraction == r.cascade_size / 3 for r in rows)


def test_betweenness_takes_every_source(spark, tmp_path):
    n = 300  # beyond a sample of 256: a path, order i joins parts i and i + 1
    rows = [(i, p, 50.0) for i in range(n - 1) for p in (i, i + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r[0]: r[1] for r in q.QUERIES["betweenness"](spark, str(tmp_path)).collect()}
    assert got == {i: float(i * (n - 1 - i)) for i in range(n)}


def test_adaptive_betweenness_takes_every_source(monkeypatch):
    asked = {}
    monkeypatch.setattr(q, "_attack", lambda *a, **settings: asked.update(settings))
    q.QUERIES["adaptive_betweenness"](None, "")
    assert asked.get("btw_k") is None


def test_edge_jaccard_joins_no_wedges(spark, sf, monkeypatch):
    monkeypatch.setattr("percola.operators.graph.common_neighbours", None)
    assert sorted(map(tuple, q.QUERIES["edge_jaccard"](spark, sf).collect())) == [(1, 2, 0, 1, 0.0), (2, 3, 0, 1, 0.0), (4, 5, 0, 0, None), (6, 7, 0, 0, None)]
