"""Readers, costs, graphs and solvers on small networks whose answers are known in closed form or by brute force."""

import logging
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise import app
from arcwise.config import ConfigError, parse_config
from arcwise.functions import cost as C
from arcwise.functions import metrics as M
from arcwise.operators import assign, bushes, graph
from arcwise.operators import kernels as K
from arcwise.plans import solver as S
from arcwise.sources import sinks, tntp

#: Braess's example of 1968: four nodes, five links, closed-form equilibrium.
BRAESS = """<NUMBER OF ZONES> 4
<NUMBER OF NODES> 4
<FIRST THRU NODE> 1
<NUMBER OF LINKS> 5
<TOLL FACTOR> 1   ~ time per toll
<END OF METADATA>
~ tail head capacity length time alpha beta speed toll type
1 2 1 1 1  10   1 60 -1 0 ;
1 3 1 1 50 0.02 1 60 0 0 ;
2 3 1 1 10 0.1  1 60 0 0 ;

2 4 1 1 50 0.02 1 60 0 0 ;
3 4 1 1 1  10   1 60 -1 0 ;
"""
TRIPS = "<NUMBER OF ZONES> 4\n<TOTAL OD FLOW> 6\n<END OF METADATA>\nOrigin 1\n 4 : 6;\n"


def braess(spark):
    meta, rows = tntp.parse_network(BRAESS)
    links = spark.createDataFrame(rows, tntp.LINKS)
    head, trips = tntp.parse_trips(TRIPS, zones=4)
    demand = spark.createDataFrame(trips, tntp.TRIPS)
    classes = tntp.class_factors(spark, meta, [head])
    return meta, links, demand, classes, S.Network.of(links, classes, demand, meta.first_thru, meta.nodes)


def test_config():
    cfg = parse_config("~ note\n<NETWORK FILE> a.txt ~ the net\n<trips file> b.txt\n<TRIPS FILE> c.txt\n<FILE PATH> net/ ~ blanks before\n<MAX ITERATIONS> 5\n<STORE BUSHES> ~\n<GAP FUNCTION> RELATIVE GAP 2")
    assert (cfg.network, cfg.trips, cfg.file_path, cfg.max_iterations, cfg.store_bushes) == ("a.txt", ("b.txt", "c.txt"), "net/", 5, True)
    assert (cfg.min_reduced_cost, cfg.newton_step, cfg.inner_iterations, cfg.gap_function) == (1e-8, 1.0, 20, "RELATIVE GAP 2")
    for bad in ("<MAX ITERATIONS> 5", "<NETWORK FILE> a\n<TRIPS FILE> b", "<NETWORK FILE> a\n<TRIPS FILE> b\n<MAX ITERATIONS> x", "<NETWORK FILE> a\n<TRIPS FILE> b\n<MAX ITERATIONS> 1\n<LINK COST UPDATE> OFTEN", "<NETWORK FILE> a\n<TRIPS FILE> b\n<MAX ITERATIONS> 1\n<DEMAND MULTIPLIER> -1"):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_reader_errors(caplog):
    with pytest.raises(tntp.FormatError, match="ten numbers"):
        tntp.parse_network(BRAESS.replace("1 3 1 1 50 0.02 1 60 0 0 ;", "1 3 1 1 50"))
    with pytest.raises(tntp.FormatError, match="out of range"):
        tntp.parse_network(BRAESS.replace("1 3 1", "1 9 1"))
    with pytest.raises(tntp.FormatError, match="capacity"):
        tntp.parse_network(BRAESS.replace("1 3 1 1 50", "1 3 0 1 50"))
    with pytest.raises(tntp.FormatError, match="header"):
        tntp.parse_network(BRAESS.replace("LINKS> 5", "LINKS> 6"))
    with pytest.raises(tntp.FormatError, match="NODES"):
        tntp.parse_network(BRAESS.replace("<NUMBER OF NODES> 4\n", ""))
    with pytest.raises(tntp.FormatError, match="negative"):
        tntp.parse_trips(TRIPS.replace(": 6", ": -6"))
    with pytest.raises(tntp.FormatError, match="zones"):
        tntp.parse_trips(TRIPS, zones=5)
    with caplog.at_level(logging.WARNING):
        tntp.parse_network(BRAESS)
        tntp.parse_trips(TRIPS.replace("FLOW> 6", "FLOW> 9"))
    assert "negative length" in caplog.text
    assert "differs" in caplog.text


def test_trips_text():
    text = "<DEMAND MULTIPLIER> 0.5\n<END OF METADATA>\nOrigin 1\n1 : 2.0 2 : 4 3 : 6\nOrigin 2\n1 : 1; 1 : 3;\n"
    head, rows = tntp.parse_trips(text, 7, multiplier=9)
    assert rows == [(7, 0, 0, 1.0), (7, 0, 1, 2.0), (7, 0, 2, 3.0), (7, 1, 0, 1.5)]  # the file's factor; the last value of a cell
    assert [r[1:] for r in tntp.parse_trips(text, strict_semicolons=True)[1]] == [(0, 0, 1.0), (1, 0, 1.5)]


def test_data_source(spark, tmp_path):
    (tmp_path / "net.txt").write_text(BRAESS)
    (tmp_path / "trips.txt").write_text(TRIPS)
    (tmp_path / "flow.txt").write_text("From To Volume Cost\n1 2 4.5 9\n")
    assert tntp.load(spark, str(tmp_path / "net.txt")).where("cost_family = 'linear'").count() == 5
    assert [tuple(r) for r in tntp.load(spark, str(tmp_path / "trips.txt"), "trips").collect()] == [(0, 0, 3, 6.0)]
    assert [tuple(r) for r in tntp.load(spark, str(tmp_path / "flow.txt"), "flow").collect()] == [(0, 1, 4.5, 9.0)]


def test_round_trip(spark):
    meta, links, demand, *_ = braess(spark)
    meta2, rows = tntp.parse_network(sinks.network_text(meta, links))
    assert (meta2, [r[1:] for r in rows]) == (meta, [tuple(r)[1:] for r in links.orderBy("tail", "head").collect()])
    assert tntp.parse_trips(sinks.trips_text(4, demand))[1] == [(0, 0, 3, 6.0)]


@pytest.mark.parametrize("beta", [0.0, 1.0, 2.5, 4.0])
def test_costs(spark, beta):
    """Columns and arrays agree; the derivative is the slope, the integral the area."""
    rows = [(x, 3.0, 2.0, 0.15, beta) for x in (0.0, 0.5, 3.0, 7.0)]
    df = spark.createDataFrame(rows, "x double, capacity double, free_flow_time double, alpha double, beta double")
    x = F.col("x")
    got = np.array(df.select(C.time_cost(x), C.derivative(x), C.integral(x)).collect())
    time, der, area = C.np_cost(*np.array(rows).T)
    assert np.allclose(got, np.array([time, der, area]).T)
    f = lambda v: 2 * (1 + 0.15 * (v / 3) ** beta)
    for (v, *_), (t, d, a) in zip(rows, got, strict=True):
        if v > 0:
            assert t == pytest.approx(f(v))
            assert d == pytest.approx((f(v + 1e-6) - f(v - 1e-6)) / 2e-6, rel=1e-4, abs=1e-6)
            grid = np.linspace(0, v, 20001)
            assert a == pytest.approx(np.trapezoid([f(g) for g in grid], grid), rel=1e-5)


def test_conic(spark):
    p = {k: F.lit(v) for k, v in dict(a=6.0, b=1.1, e=0.05, h0=0.3, sat=4.0, s=0.4, ca=1.0, cb=-0.5, cc=0.7, cd=2.0, m=0.2, u=0.6).items()}
    xs = (1.0, 3.4, 3.6, 3.9)
    h = 1e-6
    df = spark.createDataFrame([(x, y, 3.0, 2.0) for x in xs for y in (x - h, x, x + h)], "at double, x double, capacity double, free_flow_time double")
    rows = df.select("at", C.conic_cost(F.col("x"), p).alias("c"), C.conic_derivative(F.col("x"), p).alias("d")).collect()
    for i in range(0, len(rows), 3):
        assert rows[i + 1]["d"] == pytest.approx((rows[i + 2]["c"] - rows[i]["c"]) / (2 * h), rel=1e-4)
    with pytest.raises(NotImplementedError):
        C.conic_integral()


def random_graph(seed, n=14, m=50):
    rng = random.Random(seed)
    arcs = [(i, (i + 1) % n) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(m - n)]
    arcs += arcs[:3]  # parallel links
    return K.Graph(n, [a for a, _ in arcs], [b for _, b in arcs], first_thru=4), np.array([float(rng.randint(1, 9)) for _ in arcs])


def brute_labels(g, cost, origin):
    label = np.full(g.n, math.inf)
    label[origin] = 0
    for _ in range(g.n):
        for a, (i, j) in enumerate(zip(g.tail, g.head, strict=True)):
            if i == origin or i >= g.first_thru:
                label[j] = min(label[j], label[i] + cost[a])
    return label


def test_labels(spark):
    for seed in range(6):
        g, cost = random_graph(seed)
        for o in range(0, g.n, 5):
            want = brute_labels(g, cost, o)
            label, pred, _ = K.shortest(g, cost, o)
            assert (label == want).all()
            for q in ("FIFO", "LIFO", "DEQUE"):
                assert (K.label_correcting(g, cost, o, q) == want).all()
            assert (K.label_correcting(g, cost, o, "DEQUE", np.where(np.isfinite(want), want + 3, want)) == want).all()
            for v in range(g.n):
                tight = [a for a in g.inn[v] if label[g.tail[a]] + cost[a] == label[v] and g.expands(int(g.tail[a]), o)]
                assert pred[v] == (tight[0] if tight and v != o and np.isfinite(label[v]) else -1)
    links = spark.createDataFrame([(a, int(i), int(j), float(c)) for a, (i, j, c) in enumerate(zip(g.tail, g.head, cost, strict=True))], "arc_id int, tail int, head int, cost double")
    origins = spark.createDataFrame([(0, o) for o in range(g.n)], "class_id int, origin int")
    key = lambda df: sorted((r["origin"], r["node"], r["cost"]) for r in df.collect())
    assert key(graph.labels_relational(links, origins, first_thru=4)) == key(graph.labels(origins, g, {0: cost}))


def test_loading(spark):
    g, cost = random_graph(3)
    flow, sptt, label = K.all_or_nothing(g, cost, 5, [5, 6, 9], [100.0, 2.0, 3.0])
    assert sptt == 2 * label[6] + 3 * label[9] == (flow * cost).sum()
    with pytest.raises(K.Unreachable):
        K.all_or_nothing(K.Graph(3, [0], [1]), np.ones(1), 0, [2], [1.0])


def test_reach_repair_and_order(spark):
    arcs = [(0, 1), (1, 2), (3, 2)]
    links = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(arcs)], "arc_id int, tail int, head int")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node_id int")
    assert {r["node"]: r["hops"] for r in graph.reach(links, 0).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r["node"] for r in graph.reach(links, 2, reverse=True).collect()} == {0, 1, 2, 3}
    extra = graph.artificial_links(links, nodes)
    assert sorted((r["tail"], r["head"]) for r in extra.collect()) == [(0, 3), (1, 3), (2, 3), (3, 0), (3, 1)]
    g = K.Graph(4, [a for a, _ in arcs], [b for _, b in arcs])
    assert K.reachable(g, 0).tolist() == [0, 1, 2, -1]
    assert K.topological_order(g, range(3)) == [0, 3, 1, 2]
    assert {r["node"]: r["depth"] for r in graph.topo_depth(links, nodes).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    ring = links.unionByName(spark.createDataFrame([(3, 2, 0)], "arc_id int, tail int, head int"))
    with pytest.raises(ValueError, match="cycle"):
        graph.topo_depth(ring, nodes)
    with pytest.raises(ValueError, match="cycle"):
        K.topological_order(K.Graph(3, [0, 1, 2], [1, 2, 0]), range(3))


def test_braess_passes(spark):
    _, _, demand, _, net = braess(spark)
    msa = S.solve(net, demand, S.SolverConfig.preset("msa", max_iterations=3, gap=-1.0))
    assert [round(r[1], 9) for r in msa.iterations] == [0.236363636, 0.35, 0.0, 0.116564417]
    assert [round(r[2], 6) for r in msa.iterations] == [438, 414, 386, 393]
    fw = S.solve(net, demand, S.SolverConfig.preset("fw", max_iterations=3, gap=0.0))
    assert [round(r[2], 9) for r in fw.iterations] == [438, 409.833457947, 387.737894345, 386.668951714]
    stopped = S.solve(net, demand, S.SolverConfig.preset("msa", max_iterations=9, gap=1e-9))
    assert len(stopped.iterations) == 3
    newton = S.solve(net, demand, S.SolverConfig.preset("fw", line_search="newton", max_iterations=40, gap=1e-3))
    assert newton.iterations[-1][1] <= 1e-3


@pytest.mark.parametrize("algorithm", ["cfw", "bfw", "bush"])
def test_braess_equilibrium(spark, algorithm):
    _, _, demand, _, net = braess(spark)
    r = S.solve(net, demand, S.SolverConfig.preset(algorithm, max_iterations=60, gap=1e-6))
    assert np.allclose(r.flow[0], [4, 2, 2, 2, 4], atol=2e-2)
    assert r.iterations[-1][2] == pytest.approx(386, abs=1e-2)
    # ten halvings may step a little too far; Newton shifts never do
    assert algorithm != "bush" or all(b[2] <= a[2] + 1e-9 for a, b in zip(r.iterations, r.iterations[1:], strict=False))


def test_bush_state(spark, tmp_path):
    """Totals, paths, balances and a warm start from stored bushes."""
    meta, links, demand, classes, net = braess(spark)
    cfg = S.SolverConfig.preset("bush", max_iterations=30, gap=1e-10)
    r = S.bush_equilibrium(net, demand, cfg)
    lc = r.link_class(spark, net)
    state = M.link_state(links, lc.select("arc_id", "flow"))
    assert M.tstt(state, lc).first()[0] == pytest.approx(552)
    assert M.beckmann(state, lc).first()[0] == pytest.approx(386)
    total = M.class_totals(state, lc).where("class_id is null").first()
    assert (total["time"], total["toll"], total["generalized_cost"]) == (pytest.approx(560), pytest.approx(-8), pytest.approx(552))
    paths = bushes.path_flows(r.bushes, demand)
    assert sum(x["flow"] for x in paths.collect()) == pytest.approx(6)
    assert {tuple(x["nodes"]): round(x["flow"], 5) for x in paths.collect()} == {(0, 1, 3): 2.0, (0, 2, 3): 2.0, (0, 1, 2, 3): 2.0}
    assert bushes.balance(r.bushes, demand).where("abs(balance) > 1e-5").count() == 0
    assert bushes.same_paths(paths, paths).count() == 3
    shares = bushes.merge_share(r.bushes).groupBy("head").agg(F.sum("share").alias("s")).collect()
    assert all(x["s"] == pytest.approx(1) for x in shares)
    sinks.write_state(sinks.with_batch(r.bushes, meta.zones, 2), str(tmp_path / "b"))
    stored = sinks.read_state(spark, str(tmp_path / "b"), 0).drop("batch")
    warm = S.bush_equilibrium(net, demand.withColumn("trips", F.col("trips") * 1.0), S.SolverConfig.preset("bush", max_iterations=0), stored)
    assert warm.iterations[-1][1] == pytest.approx(0, abs=1e-9)
    more = S.bush_equilibrium(net, demand.withColumn("trips", F.col("trips") * 2), cfg, stored)
    assert more.iterations[-1][1] < 1e-9
    spread = S.bush_distributed(net, demand, S.SolverConfig.preset("bush", max_iterations=25, gap=1e-8))
    assert spread.iterations[-1][2] == pytest.approx(386, rel=1e-6)


def test_two_halves_are_one_class(spark):
    meta, links, demand, classes, net = braess(spark)
    half = demand.withColumn("trips", F.col("trips") / 2)
    two = half.unionByName(half.withColumn("class_id", F.lit(1)))
    both = classes.unionByName(classes.withColumn("class_id", F.lit(1)))
    net2 = S.Network.of(links, both, two, meta.first_thru, meta.nodes)
    cfg = S.SolverConfig.preset("fw", max_iterations=3, gap=0.0)
    a, b = S.solve(net, demand, cfg), S.solve(net2, two, cfg)
    assert np.allclose([r[1:3] for r in a.iterations], [r[1:3] for r in b.iterations])
    assert np.allclose(b.flow.sum(0), a.flow[0])


def test_app(spark, tmp_path):
    (tmp_path / "net.txt").write_text(BRAESS)
    (tmp_path / "trips.txt").write_text(TRIPS)
    base = f"<NETWORK FILE> net.txt\n<FILE PATH> {tmp_path}/\n<DATA PATH> {tmp_path}/\n<CONVERGENCE GAP> 1e-10\n<STORE BUSHES>\n<STORE MATRICES>\n<CALCULATE ENTROPY>\n"
    one = base + f"<TRIPS FILE> trips.txt\n<FLOWS FILE> {tmp_path}/flows\n<PATH FLOWS FILE> {tmp_path}/paths\n"
    got = app.run(spark, parse_config(one))
    assert got["tstt"] == pytest.approx(552)
    # merges at nodes 3 (2 + 2) and 4 (2 + 4), origin's own link whole
    assert got["entropy"] == pytest.approx(4 * math.log(2) + 6 * math.log(6) - 2 * math.log(2) - 4 * math.log(4))
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/flows").collect()]
    assert lines[0] == "(1,2) 4.000000"
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/paths").collect()) == ["[1,2,3,4] : 2.000000", "[1,2,4] : 2.000000", "[1,3,4] : 2.000000"]
    again = app.run(spark, parse_config(one + "<WARM START>\n<MAX ITERATIONS> 0\n"))
    assert (again["iterations"], again["tstt"]) == (0, pytest.approx(552))
    two = base + f"<TRIPS FILE> trips.txt\n<TRIPS FILE> trips.txt\n<DEMAND MULTIPLIER> 0.5\n<FLOWS FILE> {tmp_path}/report\n"
    app.run(spark, parse_config(two))
    text = [r[0] for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert text[0] == "Link TotalFlow TravelTime Class1 Class2"
    assert text[1].startswith("(1,2) 4.000000")
    assert text[-1].startswith("TOTAL 560.0")


def test_gaps(spark):
    it = spark.createDataFrame([(0, 10.0, 8.0, 9.0), (1, 9.0, 8.5, 8.6), (2, 9.5, 7.0, 9.9)], "iter int, objective double, sptt double, tstt double")
    got = {r["iter"]: r["lower_bound"] for r in M.bound_gap(it).collect()}
    assert got == {0: 9.0, 1: 9.0, 2: 9.0}
    zero = spark.range(1).select(M.relative_gap(F.lit(0.0), F.lit(0.0)).alias("g")).first()["g"]
    assert zero == 0


def test_state_helpers(spark):
    df = spark.createDataFrame([(c, o) for c in range(2) for o in range(5)], "class_id int, origin int")
    assert [r["batch"] for r in sinks.with_batch(df, 5, 3).orderBy("class_id", "origin").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError, match="divide"):
        sinks.with_batch(df, 5, 3, strict=True)
    x = assign.origin_index(df, 5)
    assert x.where("node_back <> origin or class_back <> class_id").count() == 0


def grid(spark, side=5, seed=1):
    """A street grid with curved costs and demand between random nodes, and its solver input."""
    rng = random.Random(seed)
    rows = []
    for i in range(side * side):
        for j in (i + 1 if (i + 1) % side else -1, i + side):
            for a, b in ((i, j), (j, i)) if 0 <= j < side * side else ():
                rows.append((len(rows), a, b, rng.uniform(50, 150), 1.0, rng.uniform(1, 3), 0.15, 4.0, 60.0, 0.0, 1, "quartic", False))
    trips = [(c, o, d, rng.uniform(5, 20)) for c in range(2) for o in rng.sample(range(side * side), 8) for d in rng.sample(range(side * side), 5) if o != d]
    links, demand = spark.createDataFrame(rows, tntp.LINKS), spark.createDataFrame(trips, tntp.TRIPS)
    classes = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.1)], "class_id int, toll_factor double, distance_factor double")
    return links, demand, S.Network.of(links, classes, demand, 0, side * side)


@pytest.fixture(scope="module")
def town(spark):
    _, demand, net = grid(spark)
    return net, demand.cache()


def test_methods_agree(town):
    """One task, one block and blocks in parallel come to one objective, which the biconjugate method nears from above."""
    net, demand = town
    cfg = S.SolverConfig.preset("bush", max_iterations=40, gap=1e-9)
    best = S.bush_equilibrium(net, demand, cfg)
    low = best.iterations[-1][2]
    one = S.bush_distributed(net, demand, cfg)
    four = S.bush_distributed(net, demand, S.SolverConfig.preset("bush", max_iterations=40, gap=1e-6), blocks=4)
    assert best.iterations[-1][1] <= 1e-9 and one.iterations[-1][1] <= 1e-9
    assert one.iterations[-1][2] == pytest.approx(low, rel=1e-8)
    assert four.iterations[-1][2] == pytest.approx(low, rel=1e-5)
    assert [x[2] for x in four.iterations] == sorted((x[2] for x in four.iterations), reverse=True)
    bfw = S.convex_combinations(net, demand, S.SolverConfig.preset("bfw", max_iterations=60, gap=1e-5))
    assert low - 1e-6 * low <= bfw.iterations[-1][2] <= low * (1 + 1e-5)
    for r in (best, four):
        assert bushes.balance(r.bushes, demand).agg(F.max(F.abs("balance"))).first()[0] < 1e-6
    again = S.bush_distributed(net, demand, S.SolverConfig.preset("bush", max_iterations=0), four.bushes, blocks=3)
    assert np.allclose(again.flow, four.flow, atol=1e-6)


@pytest.mark.parametrize("name", ["RELATIVE GAP", "RELATIVE GAP 2", "AVERAGE EXCESS COST", "MAXIMUM EXCESS COST"])
def test_gap_functions(town, name):
    """Each gap is what its name says, and bush methods stop by it."""
    net, demand = town
    total = demand.agg(F.sum("trips")).first()[0]
    cfg = S.SolverConfig.preset("bush", gap_function=name, gap=1e-3, max_iterations=30)
    for r in (S.bush_equilibrium(net, demand, cfg), S.bush_distributed(net, demand, cfg, blocks=2)):
        assert r.iterations[-1][1] <= 1e-3 < r.iterations[0][1]
        bound = -math.inf
        for _, gap, objective, tstt, sptt, _ in r.iterations:
            bound = max(bound, objective + sptt - tstt)
            want = {"RELATIVE GAP": tstt / sptt - 1, "RELATIVE GAP 2": objective / bound - 1, "AVERAGE EXCESS COST": (tstt - sptt) / total}.get(name)
            assert gap >= 0 if want is None else gap == pytest.approx(want, abs=1e-12)
    if name == "MAXIMUM EXCESS COST":
        with pytest.raises(ValueError, match="bush"):
            S.convex_combinations(net, demand, cfg)


def test_run_settings(town, caplog):
    """Every setting of the shifts changes what a run does, as its name says."""
    net, demand = town

    def objectives(passes=1, inner=0, text="", **other):
        cfg = app.solver_config(parse_config(f"<NETWORK FILE> a\n<TRIPS FILE> b\n<MAX ITERATIONS> {passes}\n<INNER ITERATIONS> {inner}\n{text}"))
        return [x[2] for x in S.bush_equilibrium(net, demand, S.SolverConfig(**(cfg.__dict__ | other))).iterations]

    first, plain = objectives()
    assert plain < first
    for still in ("<MIN COST DIFFERENCE> 1e9", "<MIN LINK FLOW SHIFT> 1e9", "<THRESHOLD GAP> 1e9", "<THRESHOLD AEC> 1e9", "<NEWTON SHIFTS> 0", "<SHIFT REPETITIONS> 0"):
        assert objectives(text=still) == [first, first], still
    a, b, c = objectives(2, text="<THRESHOLD AEC> 1e9")  # holds for the first pass; later ones follow the gap
    assert (a, b) == (first, first) and c < b
    assert objectives(2, threshold_share=1e9)[1:] == [plain, plain]
    assert plain < objectives(text="<NEWTON STEP> 0.1")[1] < first
    end = objectives(40, 20)[-1]
    seen = {plain}
    for more in ("<NEWTON SHIFTS> 3", "<SHIFT REPETITIONS> 3", "<SHIFT REPETITIONS> 3\n<RESCAN AFTER SHIFT>", "<LINK COST UPDATE> LINEAR", "<LINK COST UPDATE> NONE", "<NEWTON STEP> 0.5"):
        got = objectives(text=more)[1]
        assert got not in seen, more
        seen.add(got)
        if "NONE" not in more:
            assert objectives(40, 20, more)[-1] == pytest.approx(end, rel=1e-6), more
    assert len(objectives(50, 20, "<MAX RUN TIME> 0")) == 1
    assert len(objectives(3, 0, "<MAX RUN TIME> 1e9\n<EXCLUDE GAP TIME>")) == 4
    caplog.clear()
    objectives(text="<NUMBER OF THREADS> 4\n<SHORTEST PATH QUEUE DISCIPLINE> FIFO\n<REUSE FIRST BUSH>\n<MIN REDUCED COST> 1")
    assert len([r for r in caplog.records if "no effect" in r.message]) == 4
    cfg = parse_config("<NETWORK FILE> a\n<TRIPS FILE> b\n<MAX ITERATIONS> 1\n<ALGORITHM> bfw")
    assert app.solver_config(cfg).algorithm == "bfw"


def test_short_of_the_gap(town, caplog):
    net, demand = town
    caplog.set_level(logging.INFO, "arcwise")
    S.bush_equilibrium(net, demand, S.SolverConfig.preset("bush", max_iterations=1, gap=1e-12))
    assert "stopped after 1 passes" in caplog.text and "pass 0: gap" in caplog.text
    with pytest.raises(ArithmeticError):
        S.shifted(np.array([1.0]), np.array([-3.0]), 1.0)
    assert S.shifted(np.array([1.0]), np.array([-1.0 - 1e-12]), 1.0).tolist() == [0.0]


def test_conjugacy_warning(town, caplog):
    """Directions are conjugate but where their weight hits a bound, and a warning tells where."""
    net, demand = town
    warned = []
    for tolerance in (-1.0, 1e-3):
        caplog.clear()
        S.convex_combinations(net, demand, S.SolverConfig.preset("cfw", max_iterations=8, conjugacy_tolerance=tolerance))
        warned.append({r.message[:7] for r in caplog.records if "not conjugate" in r.message})
    assert len(warned[0]) >= 4
    assert warned[1] < warned[0]


def test_path_sets_and_dump(spark):
    schema = "class_id int, origin int, dest int, nodes array<int>, flow double"
    a = spark.createDataFrame([(0, 1, 3, [1, 2, 3], 2.0)], schema)
    b = spark.createDataFrame([(0, 1, 3, [1, 2, 3], 1.0), (0, 1, 3, [1, 3], 4.0)], schema)
    assert {(tuple(r["nodes"]), r["flow"]) for r in bushes.add_paths(a, b).collect()} == {((1, 2, 3), 3.0), ((1, 3), 4.0)}
    rows = [(0, 0, 0, 0, 1, 2.0, 1), (0, 0, 1, 0, 2, 1.0, 2), (0, 0, 2, 1, 2, 2.0, 2)]
    bush = spark.createDataFrame(rows, "class_id int, origin int, arc_id int, tail int, head int, approach_flow double, topo_pos int")
    assert [r["line"] for r in bushes.described(bush).orderBy("topo_pos").collect()] == ["2 from 1 (2.000000)", "3 from 1 (1.000000), 2 (2.000000)"]


def test_path_flows_of_an_equilibrium(town):
    """Path flows of split bushes carry all demand, and over each link they sum to its flow."""
    net, demand = town
    r = S.bush_equilibrium(net, demand, S.SolverConfig.preset("bush", max_iterations=8, gap=1e-6))
    got = bushes.path_flows(r.bushes.where("approach_flow > 0"), demand).collect()
    arc = {(t, h): a for a, (t, h) in enumerate(zip(net.g.tail.tolist(), net.g.head.tolist(), strict=True))}
    pairs, flow = {}, np.zeros_like(r.flow)
    for p in got:
        assert (p["nodes"][0], p["nodes"][-1]) == (p["origin"], p["dest"]) and len(set(p["nodes"])) == len(p["nodes"])
        k = (p["class_id"], p["origin"], p["dest"])
        pairs[k] = pairs.get(k, 0.0) + p["flow"]
        for a, b in zip(p["nodes"], p["nodes"][1:], strict=False):
            flow[p["class_id"], arc[a, b]] += p["flow"]
    assert pairs == pytest.approx({(d["class_id"], d["origin"], d["dest"]): d["trips"] for d in demand.collect()})
    assert len(got) > len(pairs)  # some pairs use several paths
    assert np.allclose(flow, r.flow, atol=1e-6)


def test_trips_files(spark, tmp_path):
    """Bodies are parsed by tasks; headers, order of classes and errors are as with the text parser."""
    (tmp_path / "a").write_text(TRIPS)
    (tmp_path / "b").write_text(TRIPS.replace("4 : 6", "4 : 2; 3 : 0").replace("<TOTAL OD FLOW> 6", "<TOLL FACTOR> 3"))
    heads, demand = tntp.read_trips(spark, [str(tmp_path / "a"), str(tmp_path / "b")], 2.0, 4)
    assert sorted(tuple(r) for r in demand.collect()) == [(0, 0, 3, 12.0), (1, 0, 3, 4.0)]
    assert heads[1]["TOLL FACTOR"] == "3"
    with pytest.raises(tntp.FormatError, match="zones"):
        tntp.read_trips(spark, [str(tmp_path / "a")], 1.0, 5)
    (tmp_path / "c").write_text("no header\n1 : 2;\n")
    with pytest.raises(tntp.FormatError, match="metadata"):
        tntp.read_trips(spark, [str(tmp_path / "c")])
