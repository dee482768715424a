"""Equilibrium solvers. The driver keeps one number per (class, link) of a road network - bounded, and checked by
graph_of - and per pass one Spark stage loads all origins; line searches then need no job at all."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.functions.cost import np_cost
from arcwise.operators import kernels as K
from arcwise.operators.assign import all_or_nothing
from arcwise.operators.graph import graph_of
from arcwise.schema import BUSH_ARCS, ITERATIONS, Algorithm, GapFunction

ROUNDS = 10
#: (origin, link) states that one task solves, one origin after the other.
ONE_TASK = 200_000
#: Passes of shifts between two meetings of parallel blocks.
FEW_PASSES = 2
log = logging.getLogger("arcwise")


@dataclass(frozen=True)
class SolverConfig:
    algorithm: str = "fw"
    line_search: str = "bisection"  # "bisection", "newton" or "msa"
    gap: float = 1e-4
    gap_function: str = GapFunction.RELATIVE.value
    max_iterations: int = 100
    max_seconds: float | None = None
    weight_cap: float = 1e-8
    as_written: bool = False  # keep the conjugate methods' known slips (no restart, squared weight)
    stop_first: bool = True
    conjugacy_tolerance: float | None = None  # warn where conjugate directions miss it
    inner_passes: int = 20
    rules: K.ShiftRules = K.ShiftRules()
    threshold_share: float = 0.25  # after the first pass, an origin rests below this share of the relative gap
    exclude_gap_time: bool = False  # the time limit counts shifts alone

    @classmethod
    def preset(cls, algorithm: str, **other) -> SolverConfig:
        return cls(**({"algorithm": Algorithm(algorithm).value, "line_search": "msa" if algorithm == "msa" else "bisection"} | other))


@dataclass
class Network:
    """Links as arrays with the classes' fixed costs."""

    g: K.Graph
    rows: pd.DataFrame
    fixed: np.ndarray
    total_demand: float = 0.0

    @classmethod
    def of(cls, links: DataFrame, classes: DataFrame, demand: DataFrame, first_thru: int = 0, nodes: int | None = None) -> Network:
        g, rows = graph_of(links, nodes, first_thru)
        f = classes.orderBy("class_id").toPandas()  # a row per user class
        fixed = np.outer(f["distance_factor"], rows["length"]) + np.outer(f["toll_factor"], rows["toll"])
        return cls(g, rows, fixed, demand.agg(F.sum("trips")).first()[0] or 0.0)

    def performance(self, x, arcs=slice(None)):
        r = self.rows
        return np_cost(x[arcs], *(r[c].to_numpy()[arcs] for c in ("capacity", "free_flow_time", "alpha", "beta")))

    def objective(self, flow) -> float:
        return float(self.performance(flow.sum(0))[2].sum() + (flow * self.fixed).sum())


@dataclass
class Result:
    flow: np.ndarray
    iterations: list[tuple] = field(default_factory=list)
    bushes: DataFrame | None = None

    def iterations_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.iterations, ITERATIONS)

    def link_class(self, spark, net: Network) -> DataFrame:
        ids = net.rows["arc_id"].tolist()
        rows = [(int(a), c, float(net.fixed[c, i]), float(net.rows["toll"].iat[i]), float(self.flow[c, i])) for c in range(len(self.flow)) for i, a in enumerate(ids)]
        return spark.createDataFrame(rows, "arc_id int, class_id int, fixed_cost double, toll double, flow double")


def load(net: Network, demand: DataFrame, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """All-or-nothing flows by (class, link) and the shortest total, from one Spark job."""
    got = all_or_nothing(demand, net.g, {c: cost[c] for c in range(len(cost))}).toPandas()  # at most a row per class and link
    real = got[got.arc_id >= 0]
    out = np.zeros_like(cost)
    out[real.class_id, real.arc_id] = real.flow
    return out, float(got[got.arc_id < 0].flow.sum())


def slope(net: Network, flow, d, lam: float) -> float:
    """Derivative of the objective along d at step lam."""
    time_ = net.performance((flow + lam * d).sum(0))[0]
    return float(((time_ + net.fixed) * d).sum())


def bisection(net: Network, flow, d, rounds: int = ROUNDS) -> float:
    lo, hi, lam = 0.0, 1.0, 0.0
    for _ in range(rounds):
        lam = (lo + hi) / 2
        lo, hi = (lo, lam) if slope(net, flow, d, lam) > 0 else (lam, hi)
    return lam


def newton_iteration(net: Network, flow, d, lam: float, lo: float, hi: float) -> float:
    """One step from lam, kept between lo and hi."""
    x, total = (flow + lam * d).sum(0), d.sum(0)
    bottom = float((net.performance(x)[1] * total**2).sum())
    return 1.0 if bottom == 0 else float(np.clip(lam - slope(net, flow, d, lam) / bottom, lo, hi))


def newton(net: Network, flow, d, rounds: int = ROUNDS) -> float:
    lam, lo, hi = 0.0, 0.0, 1.0
    for _ in range(rounds):
        new = newton_iteration(net, flow, d, lam, lo, hi)
        lo, hi = (max(lo, new), hi) if slope(net, flow, d, new) < 0 else (lo, min(hi, new))
        if abs(new - lam) < 1e-12:
            return new
        lam = new
    return lam


def cfw_alpha(h, aon, old, cap: float) -> float:
    """Weight of the last direction that makes the new one conjugate to it."""
    n, q = float((h * aon * old).sum()), float((h * old * (aon - old)).sum())
    return 0.0 if q == 0 else float(np.clip(n / q, 0.0, 1 - cap))


def bfw_weights(h, aon, old, older, lam: float) -> tuple[float, float, float]:
    q1, q2 = float((h * older * (older - old)).sum()), float((h * old**2).sum())
    mu = max(0.0, -float((h * aon * older).sum()) / q1 * (1 - lam)) if q1 else 0.0
    nu = max(0.0, mu * lam / (1 - lam) - float((h * aon * old).sum()) / q2) if q2 else 0.0
    b0 = 1 / (1 + mu + nu)
    return b0, nu * b0, mu * b0


def gap_of(cfg: SolverConfig, total_demand: float, tstt: float, sptt: float, objective: float, bound: float, excess: float | None = None) -> float:
    """The gap by the configured function. excess: the largest excess cost over used paths, which only bushes tell."""
    if cfg.gap_function == GapFunction.MAXIMUM_EXCESS.value:
        if excess is None:
            raise ValueError("MAXIMUM EXCESS COST needs the used paths that only the bush methods keep")
        return excess
    if cfg.gap_function == GapFunction.AVERAGE_EXCESS.value:
        return (tstt - sptt) / total_demand if total_demand else 0.0
    if cfg.gap_function == GapFunction.RELATIVE_BOUND.value:
        return objective / bound - 1 if bound else 0.0
    return 0.0 if tstt == sptt == 0 or not sptt else tstt / sptt - 1


def told(iterations: list[tuple], limit: int, gap: float) -> None:
    """A line of log for each pass, and a warning where the passes end short of the gap."""
    for k, value, objective, *_ in iterations:
        log.info("pass %d: gap %.15f, objective %.15g", k, value, objective)
    if iterations and iterations[-1][0] >= limit and iterations[-1][1] > gap > 0:
        log.warning("stopped after %d passes at gap %g; asked for %g", limit, iterations[-1][1], gap)


def shifted(flow: np.ndarray, d: np.ndarray, lam: float) -> np.ndarray:
    """Flows after the step; what rounding leaves below zero is zero, more than one trip below is an error."""
    out = flow + lam * d
    if out.min(initial=0.0) < -1.0:
        raise ArithmeticError(f"a link's flow fell to {out.min()} by step {lam}")
    return np.maximum(out, 0.0)


def convex_combinations(net: Network, demand: DataFrame, cfg: SolverConfig) -> Result:
    """MSA, Frank-Wolfe, conjugate and bi-conjugate Frank-Wolfe from the free-flow loading."""
    demand = demand.cache()
    began, near_one = time.monotonic(), 1 - 2.0**-ROUNDS
    zero = np.zeros_like(net.fixed)
    flow, _ = load(net, demand, net.performance(zero.sum(0))[0] + net.fixed)
    out, old, older, lam, bound = Result(flow), None, None, 1.0, -np.inf
    for k in range(cfg.max_iterations + 1):
        time_, h, _ = net.performance(flow.sum(0))
        cost = time_ + net.fixed
        target, sptt = load(net, demand, cost)
        tstt, obj = float((flow * cost).sum()), net.objective(flow)
        bound = max(bound, obj + sptt - tstt)
        gap = gap_of(cfg, net.total_demand, tstt, sptt, obj, bound)
        stop = gap <= cfg.gap or k == cfg.max_iterations or (cfg.max_seconds and time.monotonic() - began > cfg.max_seconds)
        if stop and cfg.stop_first:
            out.iterations.append((k, gap, obj, tstt, sptt, 0.0))
            break
        aon = target - flow
        restart = lam == 1 if cfg.as_written else lam >= near_one
        d = aon
        if cfg.algorithm == "cfw" and old is not None and not restart:
            a = cfw_alpha(h, aon.sum(0), old.sum(0), cfg.weight_cap)
            d = a * old + (1 - a) * aon
        elif cfg.algorithm == "bfw" and old is not None and not restart:
            if older is None:
                a = cfw_alpha(h, aon.sum(0), old.sum(0), cfg.weight_cap)
                d = a * old + (1 - a) * aon
            else:
                b0, b1, b2 = bfw_weights(h, aon.sum(0), old.sum(0), older.sum(0), lam)
                d = b0 * aon + (b1 + b2) * old + (b2 * b2 if cfg.as_written else b2) / (1 - lam) * (older - old)
        if cfg.conjugacy_tolerance is not None and old is not None and not restart and abs(product := float((d.sum(0) * h * old.sum(0)).sum())) > cfg.conjugacy_tolerance:
            log.warning("pass %d: directions are not conjugate, their product is %g", k, product)
        if restart:
            old = None
        lam = 1 / (k + 2) if cfg.line_search == "msa" else newton(net, flow, d) if cfg.line_search == "newton" else bisection(net, flow, d)
        out.iterations.append((k, gap, obj, tstt, sptt, lam))
        flow = shifted(flow, d, lam)
        older, old = (None if old is None else (1 - lam) * old), (1 - lam) * d
        if stop:
            break
    out.flow = flow
    demand.unpersist()
    told(out.iterations, cfg.max_iterations, cfg.gap)
    return out


def bush_rows(c: int, b: K.Bush) -> pd.DataFrame:
    pos = {v: i for i, v in enumerate(b.order)}
    a = b.arcs
    return pd.DataFrame({"class_id": c, "origin": b.origin, "arc_id": a, "tail": b.g.tail[a], "head": b.g.head[a], "approach_flow": b.x[a], "topo_pos": [pos[int(v)] for v in b.g.head[a]]})


def states(net: Network, demand: DataFrame) -> int:
    """(class, origin, link) states of a bush method."""
    return demand.select("class_id", "origin").distinct().count() * len(net.rows)


def first_bush(net: Network, c: int, o: int, pdf: pd.DataFrame, old: pd.DataFrame | None, free: np.ndarray) -> K.Bush:
    """An earlier bush scaled to this demand, or else the shortest tree with the demand on it."""
    if old is not None and len(old):
        flow = np.zeros(len(net.rows))
        flow[old.arc_id] = old.approach_flow
        b = K.Bush(net.g, o, old.arc_id.to_numpy(), flow)
        b.rescale(pdf.dest.to_numpy(), pdf.trips.to_numpy())
        return b
    label, pred, order = K.shortest(net.g, free + net.fixed[c], o)
    if not np.isfinite(label[pdf.dest]).all():
        raise K.Unreachable(f"origin {o}")
    return K.Bush(net.g, o, pred[pred >= 0], K.load_tree(net.g, pred, order, pdf.dest.to_numpy(), pdf.trips.to_numpy()))


def rules_at(cfg: SolverConfig, k: int, relative: float) -> K.ShiftRules:
    """The first pass takes the configured bound below which origins rest; later ones a share of the gap."""
    return cfg.rules if k == 0 else replace(cfg.rules, rest_excess=cfg.threshold_share * max(relative, 0.0))


def turn_of(net: Network, x, total: np.ndarray, rules: K.ShiftRules) -> float | None:
    c, b, dests, trips = x
    fixed = net.fixed[c]
    return b.turn(lambda v, a=slice(None): net.performance(v, a)[0] + fixed[a], lambda v, a=slice(None): net.performance(v, a)[1], total, rules, dests, trips)


def moving(demand: DataFrame) -> DataFrame:
    return demand.where("trips > 0 and origin <> dest")


def bush_equilibrium(net: Network, demand: DataFrame, cfg: SolverConfig, start: DataFrame | None = None) -> Result:
    """Origin-based equilibrium, every origin's flow on its own acyclic links, all origins in one task and so one
    after the other, each meeting the flows the last has left: for up to ONE_TASK (origin, link) states; larger ones
    take bush_distributed. `start`: bush_arcs of an earlier run, rescaled to this demand. Result.bushes has the final
    bush_arcs."""
    spark = demand.sparkSession
    if states(net, demand) > ONE_TASK:
        raise ValueError("too large for one task; use bush_distributed")
    warm = {} if start is None else {k: v for k, v in start.toPandas().groupby(["class_id", "origin"])}  # as many states
    fixed, perf, n, all_trips = net.fixed, net.performance, len(net.rows), net.total_demand

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total, bushes = np.zeros(n), []
        free = perf(total)[0]
        for (c, o), x in pdf.groupby(["class_id", "origin"]):
            b = first_bush(net, int(c), int(o), x, warm.get((c, o)), free)
            total += b.x
            bushes.append((int(c), b, x.dest.to_numpy(), x.trips.to_numpy()))
        notes, bound, spent = [], -np.inf, 0.0
        for k in range(cfg.max_iterations + 1):
            began = time.monotonic()
            time_ = perf(total)[0]
            sptt = sum(float((t * K.shortest(net.g, time_ + fixed[c], b.origin)[0][d]).sum()) for c, b, d, t in bushes)
            tstt = sum(float((b.x * (time_ + fixed[c])).sum()) for c, b, _, _ in bushes)
            obj = float(perf(total)[2].sum() + sum(float((b.x * fixed[c]).sum()) for c, b, _, _ in bushes))
            bound = max(bound, obj + sptt - tstt)
            excess = max((b.excess(time_ + fixed[c], d) for c, b, d, _ in bushes), default=0.0) if cfg.gap_function == GapFunction.MAXIMUM_EXCESS.value else None
            gap = gap_of(cfg, all_trips, tstt, sptt, obj, bound, excess)
            notes.append((k, gap, obj, tstt, sptt))
            if not cfg.exclude_gap_time:
                spent += time.monotonic() - began
            if gap <= cfg.gap or k == cfg.max_iterations or cfg.max_seconds is not None and spent > cfg.max_seconds:
                break
            began, rules, active = time.monotonic(), rules_at(cfg, k, tstt / sptt - 1 if sptt else 0.0), []
            for x in bushes:
                x[1].grow(perf(total)[0] + fixed[x[0]], cfg.rules.min_flow)
                if turn_of(net, x, total, rules) is not None:
                    active.append(x)
            for _ in range(cfg.inner_passes):
                moved = [(x, turn_of(net, x, total, rules)) for x in active]
                active = [x for x, m in moved if m is not None]
                if not sum(m or 0.0 for _, m in moved):
                    break
            spent += time.monotonic() - began
        out = pd.concat([bush_rows(c, b) for c, b, _, _ in bushes], ignore_index=True)
        notes = pd.DataFrame(notes, columns=["topo_pos", "approach_flow", "obj", "tstt", "sptt"])
        notes = pd.concat([notes[["topo_pos"]].assign(class_id=-1, origin=j, arc_id=-1, tail=-1, head=-1, approach_flow=notes[v]) for j, v in enumerate(("approach_flow", "obj", "tstt", "sptt"))])
        return pd.concat([out, notes], ignore_index=True)[["class_id", "origin", "arc_id", "tail", "head", "approach_flow", "topo_pos"]]

    got = moving(demand).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(solve, BUSH_ARCS).toPandas()
    notes = got[got.class_id < 0].pivot(index="topo_pos", columns="origin", values="approach_flow")
    bush = got[got.class_id >= 0]
    flow = np.zeros_like(fixed)
    np.add.at(flow, (bush.class_id, bush.arc_id), bush.approach_flow)
    out = Result(flow, [(int(k), *(float(v) for v in r), 1.0) for k, r in notes.iterrows()])
    out.bushes = spark.createDataFrame(bush, BUSH_ARCS)
    told(out.iterations, cfg.max_iterations, cfg.gap)
    return out


def bush_distributed(net: Network, demand: DataFrame, cfg: SolverConfig, start: DataFrame | None = None, blocks: int | None = None) -> Result:
    """The same equilibrium with blocks of origins in parallel, by default as many as keep a block's states at ONE_TASK.
    Within a block origins move one after the other; blocks move against the same link flows, their changes are summed
    by link and applied with one step length, which keeps every bush feasible and the objective falling. Where blocks
    overshoot together the next shifts are shorter, so that steps are soon whole and links can lose all their flow. The
    driver holds link flows only; each task holds one block."""
    fixed, perf, g, n = net.fixed, net.performance, net.g, len(net.rows)
    blocks = blocks or max(1, -(-states(net, demand) // ONE_TASK))
    block = F.pmod(F.xxhash64("class_id", "origin"), F.lit(blocks)).cast("int")
    free, trips = perf(np.zeros(n))[0], moving(demand).withColumn("block", block).checkpoint()
    old = start if start is not None else demand.sparkSession.createDataFrame([], BUSH_ARCS)
    of_block, pair = trips.groupBy("block"), ["class_id", "origin"]

    def begin(key, pdf, had):
        had = dict(list(had.groupby(pair)))
        out = [pd.DataFrame({"class_id": [], "origin": [], "arc_id": [], "x": []})]
        for (c, o), x in pdf.groupby(pair):
            b = first_bush(net, int(c), int(o), x, had.get((c, o)), free)
            out.append(pd.DataFrame({"class_id": c, "origin": o, "arc_id": b.arcs, "x": b.x[b.arcs]}))
        return pd.concat(out)

    bush = of_block.cogroup(old.groupBy(block)).applyInPandas(begin, "class_id int, origin int, arc_id int, x double").checkpoint()

    def flows(df: DataFrame, col: str) -> np.ndarray:
        got = df.groupBy("class_id", "arc_id").agg(F.sum(col).alias("v")).toPandas()  # a row per class and link
        out = np.zeros_like(fixed)
        out[got.class_id, got.arc_id] = got.v
        return out

    def held(pdf: pd.DataFrame, od: pd.DataFrame | None = None):
        """(class, bush, destinations, trips) of a block's origins."""
        ends = {} if od is None else dict(list(od.groupby(pair)))
        for (c, o), x in pdf.groupby(pair):
            flow = np.zeros(n)
            flow[x.arc_id] = x.x
            d = ends.get((c, o))
            yield (int(c), K.Bush(g, int(o), x.arc_id.to_numpy(), flow), *(np.zeros(0, int) if d is None else d[v].to_numpy() for v in ("dest", "trips")))

    def widest(bush: DataFrame, cost: np.ndarray) -> float:
        def one(key, pdf, od):
            return pd.DataFrame({"v": [max([0.0, *(b.excess(cost[c], d) for c, b, d, _ in held(pdf, od))])]})

        return float(bush.groupBy(block).cogroup(of_block).applyInPandas(one, "v double").agg(F.max("v")).first()[0] or 0.0)

    flow = flows(bush, "x")
    out, bound, spent, share = Result(flow), -np.inf, 0.0, 1.0
    for k in range(cfg.max_iterations + 1):
        began = time.monotonic()
        time_ = perf(flow.sum(0))[0]
        _, sptt = load(net, trips, time_ + fixed)
        tstt, obj = float((flow * (time_ + fixed)).sum()), net.objective(flow)
        bound = max(bound, obj + sptt - tstt)
        excess = widest(bush, time_ + fixed) if cfg.gap_function == GapFunction.MAXIMUM_EXCESS.value else None
        gap = gap_of(cfg, net.total_demand, tstt, sptt, obj, bound, excess)
        if not cfg.exclude_gap_time:
            spent += time.monotonic() - began
        if gap <= cfg.gap or k == cfg.max_iterations or cfg.max_seconds is not None and spent > cfg.max_seconds:
            out.iterations.append((k, gap, obj, tstt, sptt, 0.0))
            break
        began, total = time.monotonic(), flow.sum(0)
        rules = rules_at(cfg, k, tstt / sptt - 1 if sptt else 0.0)
        rules = replace(rules, step=rules.step * share)
        passes = cfg.inner_passes if blocks == 1 else min(cfg.inner_passes, FEW_PASSES)

        def step(key, pdf, od):
            own, active, rows = total.copy(), [], []  # noqa: B023  pickled before total and rules change
            for x in held(pdf, od):
                c, b, d, t = x
                before = b.x.copy()
                b.grow(perf(own)[0] + fixed[c], cfg.rules.min_flow)
                rows.append((c, b, before))
                if turn_of(net, x, own, rules) is not None:  # noqa: B023
                    active.append(x)
            for _ in range(passes):  # noqa: B023
                moved = [(x, turn_of(net, x, own, rules)) for x in active]  # noqa: B023
                active = [x for x, m in moved if m is not None]
                if not sum(m or 0.0 for _, m in moved):
                    break
            # links that left a bush carry less than min_flow
            return pd.concat([pd.DataFrame({"class_id": c, "origin": b.origin, "arc_id": b.arcs, "x": before[b.arcs], "y": b.x[b.arcs]}) for c, b, before in rows])

        moved = bush.groupBy(block).cogroup(of_block).applyInPandas(step, "class_id int, origin int, arc_id int, x double, y double").checkpoint()
        d = flows(moved, "y") - flow
        lam = 1.0 if slope(net, flow, d, 1.0) <= 0 else bisection(net, flow, d, 20)
        share = min(1.0, share * 1.5) if lam == 1.0 else max(0.01, share * max(0.3, lam))
        whole = F.col("y") if lam == 1.0 else F.greatest(F.lit(0.0), F.col("x") + lam * (F.col("y") - F.col("x")))
        bush = moved.select("class_id", "origin", "arc_id", whole.alias("x"))
        out.iterations.append((k, gap, obj, tstt, sptt, lam))
        flow = shifted(flow, d, lam)
        spent += time.monotonic() - began
    out.flow = flow

    def rows(key, pdf):
        return pd.concat([bush_rows(c, b) for c, b, *_ in held(pdf)])

    out.bushes = bush.groupBy(block).applyInPandas(rows, BUSH_ARCS)
    told(out.iterations, cfg.max_iterations, cfg.gap)
    return out


def solve(net: Network, demand: DataFrame, cfg: SolverConfig, start: DataFrame | None = None) -> Result:
    """The configured method. "bush" means origins in parallel, unless all of them are small work for one task."""
    if cfg.algorithm == "bush":
        return (bush_equilibrium if states(net, demand) <= ONE_TASK else bush_distributed)(net, demand, cfg, start)
    if cfg.algorithm == "bush_distributed":
        return bush_distributed(net, demand, cfg, start)
    return convex_combinations(net, demand, cfg)
