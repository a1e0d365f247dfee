"""Curves, statistics, walks, readers, runs, the launcher and the registered queries."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from percola import session
from percola.functions import scalar
from percola.operators import curves, jvm, kernels, ranking, robustness, statistics, walks
from percola.operators.robustness import RunConfig
from percola.plans import launcher
from percola.session import Staged
from percola.sources import edges as sources
from percola.sources import generators

EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (2, 4), (6, 7), (7, 8), (3, 6)]


@pytest.fixture(scope="module")
def net(spark):
    return Staged(spark).put(spark.createDataFrame(EDGES, "src long, dst long"), "net")


def brute_metrics(p, y, t):
    for i, v in enumerate(y):
        if v <= t:
            return p[i] if i == 0 or y[i - 1] == v else p[i - 1] + (t - y[i - 1]) * (p[i] - p[i - 1]) / (v - y[i - 1])
    return None


def test_metrics(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for rep in range(6):
        y = np.sort(rng.random(11))[::-1] * (1 if rep else 0.3)
        y[3] = y[4]
        z = rng.random(11).round(1)
        p = np.arange(11) / 10
        rows += [("l", "random", None, rep, k, float(p[k]), float(y[k]), float(z[k])) for k in range(11)]
        want[rep] = [np.trapezoid(y, p), np.trapezoid(z, p), *[brute_metrics(p, y, t) for t in curves.THRESHOLDS], z.max(), p[z.argmax()]]
    df = spark.createDataFrame(rows, "label string, protocol string, m int, stochastic_id int, removed int, p double, s1_over_n double, s2_over_n double")
    names = ["auc_s1", "auc_s2", *[curves.threshold_name(t) for t in curves.THRESHOLDS], "max_s2_over_n", "p_at_max_s2"]
    for r in curves.curve_metrics(df).collect():
        for got, w in zip([r[n] for n in names], want[r.stochastic_id], strict=True):
            assert got == (None if w is None else pytest.approx(w))
    s = curves.metrics_summary(curves.curve_metrics(df)).first()
    areas = [v[0] for v in want.values()]
    assert s.n == 6 and s.mean_auc_s1 == pytest.approx(np.mean(areas)) and s.sem_auc_s1 == pytest.approx(np.std(areas, ddof=1) / 6**0.5)
    one = curves.metrics_summary(curves.curve_metrics(df.where("stochastic_id = 1"))).first()
    assert one.sem_auc_s1 == 0.0 and one.sd_auc_s1 is None
    assert curves.curve_metrics(df.limit(0)).count() == 0


def test_grid_curve_equals_the_kernel(spark, net):
    g = robustness.gather_graph(net)
    order = kernels.order_degree(g)
    s1, s2 = kernels.removal_curve(g, order)
    ranks = spark.createDataFrame([(int(g.nodes[v]), i + 1) for i, v in enumerate(order)], "node long, rank long")
    got = {r.removed: (r.s1, r.s2) for r in curves.curve_on_grid(net, ranks, g.n, list(range(g.n + 1))).collect()}
    assert got == {k: (s1[k], s2[k]) for k in range(g.n + 1)}


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 80).astype(float)
    y = (x * 2 + rng.integers(0, 9, 80)).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(a * a)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(99, None, 1.0, None)], "node long, x double, y double, z double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert statistics.spearman(df, "x", "y").first()[0] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    coefficients, r2 = statistics.least_squares(df, "y", ["x", "z"])
    m = np.stack([np.ones(80), x, x * x], 1)
    want, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert coefficients == pytest.approx(want) and r2 == pytest.approx(1 - ((y - m @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert statistics.least_squares(df.withColumn("y", F.lit(3.0)), "y", ["x"])[1] is None
    assert statistics.least_squares(df.limit(0), "y", ["x"])[1] is None
    low, high = set(np.lexsort((np.arange(80), x))[:4]), set(np.lexsort((np.arange(80), -y))[:4])
    assert statistics.top_overlap(df.where("node < 80"), "x", "y").first().jaccard == pytest.approx(len(low & high) / len(low | high))
    assert statistics.half_even(24.5) == 24
    assert {r.size for r in statistics.min_max_size(df.withColumn("c", F.lit(1)), "c").collect()} == {20.0}


def test_pagerank(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (1, 3), (4, 1), (3, 5)]
    df = spark.createDataFrame(arcs, "src long, dst long")
    a = np.array(arcs) - 1
    m = kernels.google_matrix(5, a[:, 0], a[:, 1], 0.85)
    want = kernels.power_iteration(m)
    got = {r.node: r["rank"] for r in walks.pagerank(df, tolerance=1e-10).collect()}
    assert [got[i + 1] for i in range(5)] == pytest.approx(want, abs=1e-8)
    for r in walks.google_matrix(df).collect():
        assert r.g == pytest.approx(m[r.i - 1, r.j - 1])
    avg = {r.node: r.iq_mean for r in walks.quantum_average(walks.google_matrix(df), 4).collect()}
    assert [avg[i + 1] for i in range(5)] == pytest.approx(kernels.quantum_walk(m, 4)[0])
    swept = walks.damping_sweep(df.withColumn("graph", F.lit("g")), [0.5, 0.85]).collect()
    same = next(r for r in swept if r.alpha == 0.85)
    assert same.fidelity_classical == pytest.approx(1) and same.diff_quantum == pytest.approx(0)


def test_betweenness_and_cascades(spark, net):
    g = robustness.gather_graph(net)
    want = kernels.betweenness(g) / 2
    got = {r.node: r.betweenness for r in robustness.betweenness(net, block=2).collect()}
    assert [got[v] for v in g.nodes.tolist()] == pytest.approx(want)
    t = spark.createDataFrame([(3, "x"), (8, "x")], "trigger_node long, trigger_type string")
    assert all(1 <= r.cascade_size <= g.n and r.cascade_fraction == r.cascade_size / g.n for r in robustness.cascades(net, t).collect())


def test_runs_resume_by_configuration(spark, net):
    path = Staged(spark).path("run")
    config = RunConfig(label="n", protocols=("random", "degree", "local_sensing"), m_max=2, n_attacks=3)
    out = robustness.run(net, config, path)
    assert out["metrics"].count() == 3 + 1 + 6 and out["raw"].count() == 10 * 9
    first = sorted(map(tuple, out["metrics"].collect()), key=str)
    again = robustness.run(net, config, path)
    assert sorted(map(tuple, again["metrics"].collect()), key=str) == first
    fewer = robustness.run(net, RunConfig(label="n", protocols=("random",), n_attacks=2), path)
    assert fewer["metrics"].count() == 2
    other = robustness.run(net, RunConfig(label="n", protocols=("random",), n_attacks=2, seed=1), path)
    assert other["metrics"].count() == 2
    wide = out["node_scores_wide"]
    assert wide.columns == ["node", "random", "degree", "local_sensing_m001", "local_sensing_m002"] and wide.count() == 8
    many = robustness.simulate(net.repartition(5), robustness.combos(spark, ["random", "adap_degree"], [], 4), config).collect()
    few = robustness.simulate(net.coalesce(1), robustness.combos(spark, ["random", "adap_degree"], [], 4), config).collect()
    assert sorted(map(str, many)) == sorted(map(str, few))


def test_costs(spark):
    config = RunConfig(btw_update=5)
    work = robustness.combos(spark, list(config.protocols), [1, 9], 10)
    cost = {(r.protocol, r.m): r.cost for r in robustness.with_cost(work, 100, 200, config).collect()}
    assert cost["adap_betweenness", None] > cost["betweenness", None] > cost["random", None] > 0 and cost["local_sensing", 9] > cost["local_sensing", 1]
    shares = {r.protocol: (r.runs, r.share) for r in robustness.cost_shares(work, 100, 200, config).collect()}
    assert sum(s for _, s in shares.values()) == pytest.approx(1) and shares["betweenness"][0] == 1 and shares["local_sensing"][0] == 20
    total = sum(cost[r.protocol, r.m] for r in work.collect())
    assert shares["random"][1] == pytest.approx(10 * cost["random", None] / total)


#: All settings that a launched run needs.
DEFAULTS = {"protocols": ["random", "degree"], "m_min": 1, "m_max": 2, "m_step": 1, "n_attacks": 3, "seed": 1, "p_step_nodes": 1, "btw_update": 10, "btw_k": None}


def test_plans_are_checked(spark, tmp_path):
    two = {"a": {"label": "A"}, "b": {"label": "B", "enabled": False}}
    assert [p.name for p in launcher.plan(DEFAULTS | {"networks": two})] == ["a"]
    assert [p.name for p in launcher.plan(DEFAULTS | {"networks": two, "run_order": ["b"]}, only=["a", "b"])] == ["b", "a"]
    bad = [{"m_min": None}, {"m_min": "1"}, {"btw_k": 1.5}, {"protocols": "random"}, {"protocols": ["x"]}, {"seed": True}, {"force": 1}, {"engine": "other"}, {"n_workers": -1}, {"typo": 1}, {"networks": {}}, {"networks": {"a": {"label": " "}}}, {"run_order": ["c"]}, {"networks": {"a": {"label": "A", "enabled": False}}}]
    for change in bad:
        with pytest.raises(launcher.ConfigError):
            launcher.plan(DEFAULTS | {"networks": two} | change)
    for absent in DEFAULTS:
        with pytest.raises(launcher.ConfigError, match="absent"):
            launcher.plan({k: x for k, x in DEFAULTS.items() if k != absent} | {"networks": two})
    with pytest.warns(UserWarning, match="btw_update"):
        launcher.plan(DEFAULTS | {"networks": two, "btw_update": 1, "protocols": ["adap_betweenness"]})
    sources.write_edge_list(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), f"{tmp_path}/a/a_edgelist.txt", "A", 3)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b_edgelist.txt").write_text("1 2\n")
    rows = launcher.plan_table(spark, launcher.plan(DEFAULTS | {"networks": two}, only=["a", "b"], force=True), str(tmp_path)).orderBy("turn").collect()
    assert [(r.name, r.n_nodes, r.n_edges, r.outdir, r.m_values, r.force) for r in rows] == [("a", 3, 2, "output/a", [1, 2], True), ("b", None, None, "output/b", [1, 2], True)]


def test_config_files(tmp_path):
    (tmp_path / "c.json").write_text('{"seed": 1, "networks": {"a": {"label": "A", "seed": 2}}}')
    assert sources.load_config(str(tmp_path / "c.json"), {"seed"})["networks"]["a"]["seed"] == 2
    for text in ('{"seed": 1, "networks": {}}', '{"sed": 1, "networks": {"a": {"label": "A"}}}', '{"networks": {"a": {"label": "A", "x": 1}}}', '{"networks": {"a": {}}}'):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(ValueError):
            sources.load_config(str(tmp_path / "c.json"), {"seed"})


def test_artefacts_of_a_run(spark, tmp_path):
    net = spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "src long, dst long")
    config = RunConfig(label="path", protocols=("random", "degree"), n_attacks=2)
    robustness.run(net, config, str(tmp_path))
    said = json.loads((tmp_path / "config.json").read_text())
    assert said["label"] == "path" and said["n_nodes"] == 8 and said["protocols"] == ["random", "degree"]
    log = "".join(p.read_text() for p in (tmp_path / "logs").glob("run-*.log"))
    assert [f"{k} took" in log for k in ("degree__mNA__rep0001", "random__mNA__rep0001", "random__mNA__rep0002", "random__mNA__rep0003")] == [True, True, True, False]
    assert "Robustness of path" in (tmp_path / "README.md").read_text()
    old = {r.stochastic_id: r.seconds for r in spark.read.parquet(f"{tmp_path}/partial-*").where("protocol = 'random'").collect()}
    again = robustness.run(net, config, str(tmp_path), force=True)
    assert again["metrics"].count() == 3 and {r.stochastic_id for r in spark.read.parquet(f"{tmp_path}/partial-*").where("protocol = 'random'").collect()} == set(old)


def test_tables_for_people(spark, tmp_path):
    ranks = spark.createDataFrame([("g", 0.85, 2, 0.25, 0.125, None), ("g", 0.85, 1, 0.75, 1 / 3, 0.0)], "graph string, alpha double, node long, classical double, quantum double, quantum_var double")
    text = lambda at: "".join(p.read_text() for p in (tmp_path / at).glob("part-*.csv")).split()
    sources.write_ranks(ranks, f"{tmp_path}/r", "graph")
    assert text("r") == ["graph,node,classical,quantum", "g,1,0.7500000000,0.3333333333", "g,2,0.2500000000,0.1250000000"]
    sources.write_sweep(spark.createDataFrame([(0.5, 1.0, 0.5, None, 0.25)], "alpha double, fidelity_quantum double, fidelity_classical double, diff_quantum double, diff_classical double"), f"{tmp_path}/s")
    assert text("s")[1] == "0.500000,1.0000000000,0.5000000000,,0.2500000000"
    back = sources.read_table(spark, f"{tmp_path}/s", "alpha double, fidelity_quantum double, fidelity_classical double, diff_quantum double, diff_classical double").first()
    assert back.diff_quantum is None and back.alpha == 0.5
    keys = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "x")], "row long, key string")
    faults = sources.key_faults(spark.createDataFrame([("x", "y"), ("z", "x"), ("z", "w")], "src string, dst string"), keys).first()
    assert (faults.n_repeated_keys, faults.n_orphans) == (2, 2)
    sources.write_node_mapping(spark.createDataFrame([(1, "A.1", 0.5, None)], "new_id long, original_id string, lat double, lon double").coalesce(1), f"{tmp_path}/m")
    assert text("m") == ["new_id,original_id,lat,lon", "1,A.1,0.5,"]


def test_plain_edges(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# a comment\n\n 3  1 1\n2 2\n1 3\n")
    assert sorted(map(tuple, sources.read_plain_edges(spark, str(tmp_path / "e.txt")).collect())) == [(1, 3), (2, 2), (3, 1)]


def test_small_things(spark):
    assert [scalar.format_duration(s) for s in (0, 59.4, 59.6, 245, 3723)] == ["0s", "59s", "1m00s", "4m05s", "1h02m03s"]
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(scalar.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, None]
    rows = spark.createDataFrame([("n", "p", 2, 1), ("n", "p", None, 1), ("n", "o", 1, 1)], "label string, protocol string, m int, stochastic_id int")
    assert [(r.protocol, r.m) for r in curves.in_order(rows).collect()] == [("o", 1), ("p", None), ("p", 2)]
    values = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.9)], "node long, x double")
    assert [r.node for r in curves.series(values, "x").collect()] == [3, 1, 2]
    from percola.sources.generators import small_graphs

    assert len(small_graphs()) == 10 and small_graphs() == small_graphs() and all(a < b <= n for k, (n, e) in small_graphs().items() if k.startswith("random") for a, b in e)


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_configurations():
    with pytest.raises(ValueError):
        RunConfig(protocols=("nothing",))
    with pytest.raises(ValueError):
        RunConfig(m_min=3, m_max=2)
    config = DEFAULTS | {"seed": 5, "btw_k": 7, "networks": {"b": {"label": "B", "btw_k": None}, "a": {"label": "A", "n_attacks": 2}}, "order": ["a"]}
    plan = launcher.planned(config)
    assert [p[0] for p in plan] == ["a", "b"] and plan[0][1].btw_k == 7 and plan[1][1].btw_k is None
    ran = []
    assert launcher.launch(config, lambda *x: ran.append(x[0]), only=["b"]) == ["b"] == ran
    assert launcher.launch(config, None, dry_run=True) == ["a", "b"]
    with pytest.raises(ValueError):
        launcher.planned(config, ["c"])


def test_edge_lists(spark, tmp_path):
    path = tmp_path / "e.txt"
    path.write_text("# x\n# N=5 E=3\n\n 2 1 1\n1 2\n3\t3 9\n5 1\n")
    g = sources.read_edge_list(spark, str(path))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (1, 5)] and {r.node for r in g.nodes.collect()} == {1, 2, 3, 4, 5}
    observed = sources.read_edge_list(spark, str(path), include_missing=False)
    assert {r.node for r in observed.nodes.collect()} == {1, 2, 3, 5}
    assert sources.read_header(spark, str(path)) == (5, 3)
    for bad in ("1 x\n", "0 1\n", "4\n", "# none\n"):
        path.write_text(bad)
        with pytest.raises(Exception):
            sources.read_edge_list(spark, str(path)).edges.collect()
    out = str(tmp_path / "out")
    sources.write_edge_list(g.edges.sparkSession.createDataFrame([(1, 5), (1, 2)], "src long, dst long"), out, "net", 5)
    back = sources.read_edge_list(spark, out)
    assert sorted(map(tuple, back.edges.collect())) == [(1, 2), (1, 5)] and sources.read_header(spark, out) == (5, 2)
    csv = tmp_path / "c.csv"
    csv.write_text("from,to,w\na,b,1\nb,c,2\n")
    e = sources.read_positional_edges(spark, str(csv))
    keys = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "a")], "row long, key string")
    numbered, _ = sources.number_by_key(e, keys)
    assert sorted(map(tuple, numbered.collect())) == [(1, 2), (3, 1)]
    with pytest.raises(Exception):
        sources.number_by_key(e, keys.where("key <> 'c'"))[0].collect()


def test_generators(spark):
    arcs = generators.erdos_renyi(spark, 40, 0.15)
    assert 150 < arcs.count() < 330 and arcs.where("src = dst").count() == 0
    free = generators.scale_free(spark, 60)
    assert free.count() == free.distinct().count() and free.where("src = dst").count() == 0


def test_queries_have_matching_columns(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("degree", "edge_jaccard", "metrics", "node_scores_wide", "quantile_hidden", "ols_r2", "google_matrix", "combos"):
        got = queries[name](spark, sf)
        got = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
        want = con.execute(sql[name])
        place = sorted(range(len(want.description)), key=lambda i: want.description[i][0])
        assert [want.description[i][0] for i in place] == sorted(queries[name](spark, sf).columns)
        want = [tuple(r[i] for i in place) for r in want.fetchall()]
        plain = lambda rows: sorted(tuple("-" if x is None else f"{float(x):.6g}" if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)
        assert plain(got) == plain(want), name
    assert entry.entry(spark).count() > 0


def test_running_totals_start_at_zero(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(50)], "k long, v long").repartition(6)
    got = {r.k: r.t for r in ranking.running_total(df, [F.col("k")], F.col("v"), "t").collect()}
    assert got == {i: sum(j * j for j in range(i)) for i in range(50)}


def test_prepare_and_extract(spark):
    from percola.plans import workflows

    raw = spark.createDataFrame([("A.1", "A.2"), ("A.2", "A.1"), ("A.2", "B.3"), ("B.3", "B.4"), ("A.1", "A.1"), ("C.8", "C.9")], "src string, dst string")
    attributes = spark.createDataFrame([("A.1", 0.0, 0.0), ("A.2", 0.1, 0.1), ("B.3", 50.0, 10.0), ("B.3", 50.0, 10.0)], "original_id string, lat double, lon double")
    p = workflows.prepare_network(raw, attributes)
    assert sorted(map(tuple, p.edges.collect())) == [(1, 2), (2, 3), (3, 4)]
    s = p.stats.first()
    assert (s.n_nodes, s.lcc_nodes, s.n_edges, s.lcc_edges, s.n_self_loops, s.n_missing) == (6, 4, 4, 3, 1, 1) and s.pct_nodes_dropped == pytest.approx(100 / 3)
    near = workflows.extract_local(p.edges, p.mapping, workflows.within(0.0, 0.0))
    assert sorted(map(tuple, near.edges.collect())) == [(1, 2)] and {r.original_id for r in near.mapping.collect()} == {"A.1", "A.2"}
    assert {r.original_id for r in workflows.extract_local(p.edges, p.mapping, workflows.in_country("b")).mapping.collect()} == {"B.3", "B.4"}
    table = workflows.master_table(p.mapping, spark.createDataFrame([(1, 5)], "node long, degree long"), spark.createDataFrame([(2, 0.5)], "node long, random double"))
    assert table.count() == 4 and table.where("degree is null").count() == 3


def test_a_mapped_graph_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(a) * 7 - 50, int(b) * 7 - 50) for a, b in rng.integers(0, 60, (400, 2))]
    edges, nodes = spark.createDataFrame([*rows, (6, 6)], "src long, dst long"), spark.createDataFrame([(9999,), (-43,)], "node long")
    monkeypatch.setattr(robustness, "PIECE", 100)
    whole = robustness.gather_graph(edges, nodes)
    monkeypatch.setattr(robustness, "IN_MEMORY", 0)
    mapped = robustness.gather_graph(edges, nodes, in_memory=0)
    assert isinstance(mapped.to, np.memmap) and mapped.nodes.tolist() == whole.nodes.tolist()
    assert mapped.start.tolist() == whole.start.tolist() and mapped.to.tolist() == whole.to.tolist()
    scores = lambda g: sorted(map(tuple, robustness.betweenness_of(spark, g, k=16).collect()))
    assert [n for n, _ in scores(mapped)] == [n for n, _ in scores(whole)]
    assert [x for _, x in scores(mapped)] == pytest.approx([x for _, x in scores(whole)])


def test_grid_of_forest_needs_no_component_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [tuple(sorted(map(int, e))) for e in rng.integers(0, 80, (120, 2)) if e[0] != e[1]]
    edges = spark.createDataFrame(sorted(set(rows)), "src long, dst long").repartition(3)
    names = sorted({x for r in rows for x in r})
    ranks = spark.createDataFrame([(v, i + 1) for i, v in enumerate(rng.permutation(names).tolist())], "node long, rank long")
    got = lambda **k: sorted(map(tuple, curves.curve_on_grid(edges, ranks, len(names), [0, 5, 20, 41, len(names)], **k).collect()))
    searched = got(most_nodes=0)
    monkeypatch.setattr(curves, "FOREST_PIECE", 10)
    monkeypatch.setattr(curves, "connected_components", None)
    assert got() == searched


def test_kernels_take_a_mapped_graph(spark, net, monkeypatch):
    work = robustness.combos(spark, ["adap_degree", "local_sensing"], [1, 3], 2)
    runs = lambda: sorted((r.protocol, r.m or 0, r.stochastic_id, r.nodes) for r in robustness.simulate(net, work, RunConfig()).collect())
    found = lambda: sorted(map(tuple, robustness.louvain(net).collect()))
    before = runs(), found()
    gather = robustness.gather_graph
    monkeypatch.setattr(robustness, "gather_graph", lambda e, n=None: gather(e, n, in_memory=0))
    assert (runs(), found()) == before


@pytest.mark.parametrize("in_memory", [0, 1_000_000])
@pytest.mark.parametrize("n,links", [(3, 2), (60, 150), (700, 2500)])
def test_louvain_of_the_jvm_is_the_kernels(spark, monkeypatch, n, links, in_memory):
    rng = np.random.default_rng(n)
    near = rng.integers(0, n, (links, 2))
    near[: links // 2, 1] = (near[: links // 2, 0] + rng.integers(0, 9, links // 2)) % n
    edges, nodes = spark.createDataFrame([(int(a) * 3 - 40, int(b) * 3 - 40) for a, b in near], "src long, dst long"), spark.createDataFrame([(99_999,)], "node long")
    gather = robustness.gather_graph
    g = gather(edges, nodes)
    want = {s: dict(zip(g.nodes.tolist(), kernels.louvain(g, s).tolist(), strict=True)) for s in (0, 5)}
    assert n == 3 or len(set(want[0].values())) < n / 5
    monkeypatch.setattr(robustness, "gather_graph", lambda e, v=None: gather(e, v, in_memory=in_memory))
    for s in want:
        found = robustness.louvain(edges, nodes, s)
        assert jvm.louvain(spark) in found._jdf.queryExecution().executedPlan().toString()
        assert {r.node: r.community for r in found.collect()} == want[s]


def test_a_mapped_graph_lies_in_the_shared_folder_once(spark, net, monkeypatch):
    from percola.session import shared_dir

    g = robustness.gather_graph(net, in_memory=0)
    assert str(g.to.filename).startswith(shared_dir(spark).removeprefix("file://"))
    monkeypatch.setattr(type(spark.sparkContext), "addFile", None)
    assert robustness.Sent(spark, g).graph().to.tolist() == g.to.tolist()


def test_a_mapped_graph_is_sent_where_the_shared_folder_is_remote(spark, net, monkeypatch):
    from percola.session import local_file

    monkeypatch.setattr(robustness, "shared_file", lambda s, name: (local_file(name), False))
    g = robustness.gather_graph(net, in_memory=0)
    sent = robustness.Sent(spark, g)
    assert sent.name and sent.graph().to.tolist() == g.to.tolist()


def test_lines_move_once_for_pairs(spark, tmp_path):
    from percola.sources import views

    rows = [(i // 4, i * 7 % 50) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = views.copurchase(spark, str(tmp_path))
    keys = [x for x in pairs._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    # the join's two sides are the same exchange; the other one is of pairs
    assert keys and not any("l_orderkey" in x and "l_partkey" in x for x in keys)
    assert len(keys) <= 3


@pytest.mark.parametrize("n,links", [(3, 2), (70, 150), (900, 2500)])
def test_exact_betweenness_of_the_jvm_is_the_kernels(spark, n, links, monkeypatch):
    rng = np.random.default_rng(n)
    rows = [(int(a) * 3 - 40, int(b) * 3 - 40) for a, b in rng.integers(0, n, (links, 2))]
    # a path has more levels than a graph by chance
    rows += [(10_000 + i, 10_001 + i) for i in range(40)]
    edges, nodes = spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([(99_999,)], "node long")
    g = robustness.gather_graph(edges, nodes)
    want = kernels.betweenness(g) / 2
    monkeypatch.setattr(kernels, "betweenness", None)
    got = {r.node: r.betweenness for r in robustness.betweenness_of(spark, g).collect()}
    assert sorted(got) == g.nodes.tolist() and [got[v] for v in g.nodes.tolist()] == pytest.approx(want)
    pairs = (g.n - 1) * (g.n - 2) / 2
    shares = {r.node: r.betweenness for r in robustness.betweenness_of(spark, g, normalised=True).collect()}
    assert [shares[v] for v in g.nodes.tolist()] == pytest.approx(want / pairs)


@pytest.mark.parametrize("shared", [True, False])
def test_exact_betweenness_of_a_mapped_graph_is_the_jvms(spark, net, monkeypatch, shared):
    from percola.session import local_file

    want = kernels.betweenness(robustness.gather_graph(net)) / 2
    if not shared:
        monkeypatch.setattr(robustness, "shared_file", lambda s, name: (local_file(name), False))
    g = robustness.gather_graph(net, in_memory=0)
    assert isinstance(g.to, np.memmap)
    monkeypatch.setattr(kernels, "betweenness", None)
    got = {r.node: r.betweenness for r in robustness.betweenness_of(spark, g).collect()}
    assert [got[v] for v in g.nodes.tolist()] == pytest.approx(want)


def test_cascades_by_rounds_are_the_kernels(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, 90, (140, 2)) if e[0] != e[1]})
    edges = spark.createDataFrame(rows, "src long, dst long")
    nodes = sorted({x for r in rows for x in r})[:8]
    triggers = spark.createDataFrame([(v, "t") for v in nodes], "trigger_node long, trigger_type string")
    found = lambda **k: sorted(map(tuple, robustness.cascades(edges, triggers, 0.1, **k).collect()))
    want = found()
    assert len({r[2] for r in want}) > 1
    monkeypatch.setattr(robustness, "IN_ONE_CALL", 0)
    monkeypatch.setattr(kernels, "cascade", None)
    assert found() == want
    scores = robustness.betweenness(edges).cache()
    monkeypatch.setattr(robustness, "betweenness_of", None)
    assert found(scores=scores) == want


@pytest.mark.parametrize("n,links", [(40, 45), (90, 200), (500, 3000)])
def test_sums_without_sets_of_nodes_are_those_of_what_is_left(spark, n, links):
    rng = np.random.default_rng(n)
    # a path has nodes that nothing reaches once one goes
    g = kernels.Csr.of(np.concatenate([rng.integers(0, n, (links, 2)), [[n + i, n + i + 1] for i in range(30)], [[0, n]]]), [n + 99])
    gone = [np.array(x) for x in ([0], [g.n - 15], [3, 7, 9], rng.choice(g.n, g.n // 4, replace=False).tolist(), np.argsort(-g.degrees())[:5].tolist())]
    whole = kernels.betweenness(g)
    for places, change in zip(gone, robustness._loads(spark, [g], gone), strict=True):
        rest, left = g.without(np.isin(np.arange(g.n), places))
        assert (whole + change)[left] == pytest.approx(kernels.betweenness(rest), abs=1e-7)


def test_cascades_that_lost_few_nodes_share_a_pass(spark, monkeypatch):
    rng = np.random.default_rng(12)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 90, (150, 2))], "src long, dst long")
    triggers = spark.createDataFrame([(v, "t") for v in sorted({x for r in edges.collect() for x in r})[:6]], "trigger_node long, trigger_type string")
    found = lambda: sorted(map(tuple, robustness.cascades(edges, triggers, 0.1).collect()))
    want = found()
    assert len({r[2] for r in want}) > 1
    monkeypatch.setattr(robustness, "IN_ONE_CALL", 0)
    loads, passes = robustness._loads, []
    monkeypatch.setattr(robustness, "_loads", lambda s, graphs, removed=None: passes.append(len(removed or ())) or loads(s, graphs, removed))
    assert found() == want
    assert passes[0] == 6


@pytest.mark.parametrize("k", [None, 20])
def test_adaptive_betweenness_of_the_jvm_is_the_kernels(spark, k):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a) * 3 - 40, int(b) * 3 - 40) for a, b in rng.integers(0, 150, (400, 2))], "src long, dst long")
    config = RunConfig(protocols=("betweenness", "adap_betweenness"), n_attacks=2, btw_update=7, btw_k=k)
    work = robustness.combos(spark, ["betweenness", "adap_betweenness"], [], 2).cache()
    g = robustness.gather_graph(edges)
    static, *want = [
        g.nodes[robustness.compute_order(g, p, None, robustness.combo_rng(config.seed, p, None, i), 7, k)].tolist() for p, i in (("betweenness", 1), ("adap_betweenness", 1), ("adap_betweenness", 2))
    ]
    assert want[0] != want[1]
    done = robustness.simulate(edges, work, config, timed=True)
    assert jvm.adaptive_order(spark) in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.protocol, r.stochastic_id): r for r in done.collect()}
    assert got["betweenness", 1].nodes == static and [got["adap_betweenness", i].nodes for i in (1, 2)] == want
    assert all(r.seconds > 0 for r in got.values())


def test_rounds_of_exact_adaptive_betweenness_are_dealt_and_shared(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(int(a) * 2, int(b) * 2) for a, b in rng.integers(0, 80, (200, 2))], "src long, dst long")
    config = RunConfig(protocols=("betweenness", "adap_betweenness"), n_attacks=2, btw_update=9)
    work = robustness.combos(spark, ["betweenness", "adap_betweenness"], [], 2).cache()
    orders = lambda: {(r.protocol, r.stochastic_id): r.nodes for r in robustness.simulate(edges, work, config).collect()}
    want = orders()
    dealt = []
    real = robustness._sums_of_spans
    monkeypatch.setattr(robustness, "_sums_of_spans", lambda spark, graphs: dealt.append([g.n for g in graphs]) or real(spark, graphs))
    # rounds are dealt at first, some, or all: down to a graph without arcs
    for most in (9_000, 0):
        monkeypatch.setattr(robustness, "IN_ONE_CALL", most)
        dealt.clear()
        assert orders() == want
        # the whole graph's sums are computed once, and so are those of what both have left
        assert len(dealt[0]) == len(dealt[1]) == 1 and dealt[0][0] == dealt[1][0] + 9
