import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from percola.operators import graph, kernels, ranking
from percola.operators.components import connected_components
from percola.operators.kernels import Csr
from percola.session import Staged
from percola.sources.generators import small_graphs


def brute_components(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


@pytest.fixture(scope="module")
def some():
    rng = random.Random(2)
    return sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def test_components(spark, some):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 1000 + i) for i in range(50)] + [(2000, 1000 + i) for i in range(0, 50, 7)]
    edges = some + chain + star + [(9999, 9999), (160, 100)]
    raw = frame(spark, edges).union(spark.createDataFrame([(None, 3), (4, None)], "src long, dst long"))
    got = {r.node: r.component for r in connected_components(raw).collect()}
    assert got == brute_components(edges)
    assert connected_components(raw.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(small_graphs()))
def test_sizes_of_small_graphs(spark, name):
    n, edges = small_graphs()[name]
    nodes = spark.range(1, n + 1).withColumnRenamed("id", "node")
    want = {x: x for x in range(1, n + 1)} | brute_components(edges)
    got = {r.node: r.component for r in graph.components(frame(spark, edges), nodes).collect()}
    assert got == want


def test_cleaning(spark):
    raw = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (1, 2), (None, 5)], "src long, dst long")
    assert [tuple(r) for r in graph.canonical_edges(raw).collect()] == [(1, 2)]
    assert tuple(graph.self_loop_count(raw).first()) == (1, 3)
    assert graph.edge_count(raw.limit(0)).first()[0] == 0


def test_subgraphs(spark, some):
    e = frame(spark, some)
    keep = set(range(0, 60, 2))
    nodes = spark.createDataFrame([(x,) for x in keep], "node long")
    assert sorted(map(tuple, graph.induced_subgraph(e, nodes).collect())) == [x for x in some if set(x) <= keep]
    assert sorted(map(tuple, graph.remove_nodes(e, nodes).collect())) == [x for x in some if not set(x) & keep]
    near = adjacency(some)
    assert {r.node for r in graph.neighbours_of(e, nodes).collect()} == set().union(*(near.get(x, set()) for x in keep))


def test_scores(spark, some):
    e, near = frame(spark, some), adjacency(some)
    for r in graph.edge_neighbourhoods(e).collect():
        a, b = near[r.src] - {r.dst}, near[r.dst] - {r.src}
        assert (r.n_common, r.n_union) == (len(a & b), len(a | b))
        assert r.similarity == (pytest.approx(len(a & b) / len(a | b)) if a | b else None)
    nodes = spark.range(62).withColumnRenamed("id", "node")
    for r in graph.dissimilarity_score(e, nodes).collect():
        total = 0.0
        for u in near.get(r.node, ()):
            a, b = near[r.node] - {u}, near[u] - {r.node}
            total += 1 - len(a & b) / len(a | b) if a | b else 0.0
        d = len(near.get(r.node, ()))
        assert r.degree == d and r.score == pytest.approx(total / d * d**0.5 if d else 0.0)


def test_largest_component_and_relabelling(spark, some):
    kept, inner = graph.largest_component(frame(spark, some))
    comp = brute_components(some)
    best = max(set(comp.values()), key=lambda c: (sum(v == c for v in comp.values()), -c))
    assert {r.node for r in kept.collect()} == {x for x, c in comp.items() if c == best}
    mapping, edges = graph.relabel(kept, inner)
    m = {r.original: r.new_id for r in mapping.collect()}
    assert [m[x] for x in sorted(m)] == list(range(1, len(m) + 1))
    assert {tuple(r) for r in edges.collect()} == {tuple(sorted((m[a], m[b]))) for a, b in some if a in m and b in m}
    check = graph.round_trip_check(mapping.select(F.col("new_id").alias("node")), edges).first()
    assert tuple(check) == (len(m), 1, True)


def test_modularity_and_assortativity(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    labels = spark.createDataFrame([(i, (i - 1) // 3) for i in range(1, 7)], "node long, community int")
    assert graph.modularity(frame(spark, edges), labels).first()[0] == pytest.approx(6 / 7 - 0.5)
    d = {k: len(v) for k, v in adjacency(edges).items()}
    pairs = [(d[a], d[b]) for x in edges for a, b in (x, x[::-1])]
    mean = sum(a for a, _ in pairs) / len(pairs)
    want = sum((a - mean) * (b - mean) for a, b in pairs) / sum((a - mean) ** 2 for a, _ in pairs)
    assert graph.assortativity(frame(spark, edges)).first()[0] == pytest.approx(want)


def test_positions_and_quantiles(spark):
    rng = random.Random(1)
    values = [rng.randrange(30) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "id long, v long").repartition(7)
    staged = Staged(spark)
    got = {r.id: r["rank"] for r in ranking.positions(df, [F.col("v"), F.col("id")], staged=staged).collect()}
    order = sorted([(-1 if i == -1 else v, i) for i, v in [(-1, None), *enumerate(values)]])
    assert [i for _, i in order] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 202))
    avg = {r.id: r.a for r in ranking.average_rank(df, "v", "a", staged).collect()}
    for i, v in enumerate(values):
        assert avg[i] == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
    assert avg[-1] is None
    import numpy as np

    for p, q in zip((0.0, 0.25, 0.5, 0.9, 1.0), ranking.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]), strict=True):
        assert q == pytest.approx(np.quantile(values, p))
    assert ranking.exact_quantiles(df.limit(0), "v", [0.5]) == [None]




def test_no_wedge_is_a_row(spark, some, monkeypatch):
    rows = lambda **k: sorted(map(tuple, graph.edge_neighbourhoods(frame(spark, some), **k).collect()))
    joined = rows(most=0)
    monkeypatch.setattr(graph, "common_neighbours", None)  # the join of wedges
    assert rows() == joined and len(joined) == len(some)


def test_a_hubs_list_in_pieces():
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)]
    g = Csr.of(np.array(edges))
    for most in (1, 7, 1000):
        got = {tuple(sorted((u, x))): c for part in kernels.common_neighbours(g, 0, g.n, most) for u, x, c in zip(*(p.tolist() for p in part), strict=True)}
        near = adjacency(edges)
        assert got == {(a, b): len(near[a] & near[b]) for a, b in edges}
