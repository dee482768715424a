"""The query catalogue on the derived network: DataFrame queries and, where SQL can say it, their SQL.

Results are rounded to four places where they are not whole numbers, as sums run in another order on each engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions import cost as C
from arcwise.functions import metrics as M
from arcwise.operators import assign, bushes, graph
from arcwise.plans import derived as D
from arcwise.plans import solver as S
from arcwise.schema import DEMAND
from arcwise.sources import sinks, tntp

NET = """sup AS (SELECT s_nationkey n, sum(l_quantity) q FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1),
 tot AS (SELECT sum(l_quantity)/25 q FROM lineitem),
 steps(idx,off) AS (VALUES (0,1),(1,3),(2,8),(3,24)),
 e0 AS (SELECT 4*n_nationkey+idx arc_id, n_nationkey tail, (n_nationkey+off)%25 head FROM nation, steps),
 net AS (SELECT arc_id, tail, head, coalesce(sup.q,tot.q)/4 capacity, CAST(1+(tail+head)%5 AS DOUBLE) length,
  CAST(1+(7*tail+3*head)%11 AS DOUBLE) fft, CAST(0.15 AS DOUBLE) alpha,
  CAST(CASE tail%3 WHEN 0 THEN 4.0 WHEN 1 THEN 1.0 ELSE 2.5 END AS DOUBLE) beta, CAST((tail*head)%3 AS DOUBLE) toll
  FROM e0 LEFT JOIN sup ON e0.tail=sup.n, tot),
 cls(c,tf,df) AS (VALUES (0,CAST(0 AS DOUBLE),CAST(0 AS DOUBLE)),(1,CAST(2 AS DOUBLE),CAST(1 AS DOUBLE))),
 fix AS (SELECT c, arc_id, tail, head, fft, length, toll, length*df+toll*tf fc FROM net, cls),
 dod AS (SELECT CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END c, s_nationkey o, c_nationkey d, sum(l_quantity) trips
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
  WHERE s_nationkey<>c_nationkey GROUP BY 1,2,3)"""


def tree_sql(t: str, costs: str) -> str:
    """CTEs lab{t}(c,o,n,cost), pred{t}, walk{t}, aon{t}(c,arc_id,flow) for the costs in `costs`(c,arc_id,tail,head,cost)."""
    return f"""r{t}(c,o,n,cost) USING KEY (c,o,n) AS (
 SELECT c,n_nationkey,n_nationkey,CAST(0 AS DOUBLE) FROM nation, cls UNION
 SELECT x.c,x.o,x.n,x.cost FROM (SELECT r.c,r.o,e.head n,min(r.cost+e.cost) cost FROM r{t} r JOIN {costs} e ON r.n=e.tail AND r.c=e.c GROUP BY 1,2,3) x
 LEFT JOIN recurring.r{t} p ON p.c=x.c AND p.o=x.o AND p.n=x.n WHERE p.cost IS NULL OR x.cost<p.cost),
 lab{t} AS MATERIALIZED (SELECT * FROM r{t}),
 pred{t} AS MATERIALIZED (SELECT a.c, a.o, e.head n, min(e.arc_id) arc_id FROM {costs} e JOIN lab{t} a ON a.n=e.tail AND a.c=e.c
  JOIN lab{t} b ON b.c=a.c AND b.o=a.o AND b.n=e.head WHERE abs(a.cost+e.cost-b.cost)<1e-9*greatest(1,b.cost) AND e.head<>a.o GROUP BY 1,2,3),
 walk{t}(c,o,n,trips) AS (SELECT c,o,d,trips FROM dod UNION ALL SELECT w.c,w.o,e.tail,w.trips FROM walk{t} w
  JOIN pred{t} p ON p.c=w.c AND p.o=w.o AND p.n=w.n JOIN net e ON e.arc_id=p.arc_id),
 aon{t} AS MATERIALIZED (SELECT p.c, p.arc_id, sum(w.trips) flow FROM walk{t} w JOIN pred{t} p ON p.c=w.c AND p.o=w.o AND p.n=w.n GROUP BY 1,2)"""


COST = "CASE beta WHEN 1 THEN fft*(1+alpha*x/capacity) WHEN 4 THEN fft*(1+alpha*(x/capacity*(x/capacity)*(x/capacity)*(x/capacity))) ELSE fft*(1+alpha*pow(x/capacity,beta)) END"
DER = "CASE beta WHEN 1 THEN fft*alpha/capacity WHEN 4 THEN 4*fft*alpha*(x/capacity*(x/capacity)*(x/capacity))/capacity ELSE fft*alpha*beta/capacity*pow(x/capacity,beta-1) END"
INT = "CASE beta WHEN 1 THEN x*fft*(1+alpha*x/capacity/2) WHEN 4 THEN x*fft*(1+alpha*(x/capacity*(x/capacity)*(x/capacity)*(x/capacity))/5) ELSE x*fft*(1+alpha/(beta+1)*pow(x/capacity,beta)) END"


def state_sql(t: str, flows: str) -> str:
    """CTEs lc{t}(c,arc_id,f,fc) and st{t}(arc_id,x,tc,der,area) of the class flows in `flows`(c,arc_id,flow); gc{t} has
    the generalized costs."""
    return f"""lc{t} AS MATERIALIZED (SELECT fix.c, fix.arc_id, coalesce(a.flow,0) f, fc FROM fix LEFT JOIN {flows} a ON a.c=fix.c AND a.arc_id=fix.arc_id),
 st{t} AS MATERIALIZED (SELECT *, {COST} tc, {DER} der, {INT} area FROM (SELECT net.*, s.x FROM net JOIN (SELECT arc_id, sum(f) x FROM lc{t} GROUP BY 1) s USING (arc_id))),
 gc{t} AS MATERIALIZED (SELECT l.c, l.arc_id, s.tail, s.head, s.tc+l.fc AS cost FROM lc{t} l JOIN st{t} s USING (arc_id))"""


FREE = f"WITH RECURSIVE {NET}, gc AS MATERIALIZED (SELECT c,arc_id,tail,head,fft+fc AS cost FROM fix)"
T0 = FREE + ", " + tree_sql("0", "gc")
S0 = T0 + ", " + state_sql("0", "aon0")
T1 = S0 + ", " + tree_sql("1", "gc0")
DIR1 = T1 + ", dir1 AS MATERIALIZED (SELECT l.c, l.arc_id, l.f, coalesce(a.flow,0)-l.f AS d FROM lc0 l LEFT JOIN aon1 a ON a.c=l.c AND a.arc_id=l.arc_id)"
X1 = DIR1 + ", x1 AS (SELECT c, arc_id, f+0.5*d AS flow FROM dir1), " + state_sql("1", "x1")
T2 = X1 + ", " + tree_sql("2", "gc1")
#: Sums over links of the second pass: loading direction, last direction scaled, derivative.
DIR2 = T2 + """, two AS MATERIALIZED (SELECT l.arc_id, sum(coalesce(a.flow,0)-l.f) aon, sum(0.5*d.d) old, sum(l.f) f FROM lc1 l LEFT JOIN aon2 a ON a.c=l.c AND a.arc_id=l.arc_id
 JOIN dir1 d ON d.c=l.c AND d.arc_id=l.arc_id GROUP BY 1), two_h AS (SELECT two.*, der FROM two JOIN st1 USING (arc_id))"""


class Base:
    """The derived network and its first loadings, made once for a query."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark = spark
        self.links, self.classes = D.net_links(spark, d), D.classes(spark)
        # a row per pair of nations and class, so a cache that nothing ever frees isn't needed
        most = D.ZONES * D.ZONES * len(D.CLASS_FACTORS)
        rows = D.net_demand(spark, d).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("more nations than the network has nodes")
        self.demand = spark.createDataFrame(rows, DEMAND)
        self.net = S.Network.of(self.links, self.classes, self.demand, 0, D.ZONES)
        self.g, self.ids = self.net.g, self.net.rows["arc_id"].to_numpy()
        self.links = spark.createDataFrame(self.net.rows)  # at most a row per road link, already on the driver
        self.origins = spark.range(D.ZONES).select(F.col("id").cast("int").alias("origin")).crossJoin(F.broadcast(self.classes.select("class_id")))

    def cost(self, flow=None) -> dict:
        import numpy as np

        x = np.zeros(len(self.ids)) if flow is None else flow.sum(0)
        t = self.net.performance(x)[0]
        return {c: t + self.net.fixed[c] for c in range(len(self.net.fixed))}

    def load(self, flow=None):
        import numpy as np

        c = self.cost(flow)
        return S.load(self.net, self.demand, np.array([c[k] for k in sorted(c)]))

    def tables(self, flow) -> tuple[DataFrame, DataFrame]:
        lc = S.Result(flow).link_class(self.spark, self.net)
        return M.link_state(self.links, lc.select("arc_id", "flow")), lc

    def first(self):
        return self.load()[0]

    def labels(self, flow=None) -> DataFrame:
        return graph.labels(self.origins, self.g, self.cost(flow), self.ids)

    def bush(self) -> DataFrame:
        """Two-tree bushes: half the demand on the free-flow tree, half on the tree of the loaded costs."""
        half = self.demand.withColumn("trips", F.col("trips") / 2)
        a = bushes.tree_bushes(half, self.g, self.cost()).where("approach_flow > 0")
        b = bushes.tree_bushes(half, self.g, self.cost(self.first())).where("approach_flow > 0")
        keys = ["class_id", "origin", "arc_id", "tail", "head"]
        return a.unionByName(b).groupBy(*keys).agg(F.sum("approach_flow").alias("approach_flow"))


BUSH = T1 + """, bush AS MATERIALIZED (SELECT c, o, b.arc_id, tail, head, sum(f) f FROM (
 SELECT p.c, p.o, p.arc_id, sum(w.trips)/2 f FROM walk0 w JOIN pred0 p ON p.c=w.c AND p.o=w.o AND p.n=w.n GROUP BY 1,2,3 UNION ALL
 SELECT p.c, p.o, p.arc_id, sum(w.trips)/2 f FROM walk1 w JOIN pred1 p ON p.c=w.c AND p.o=w.o AND p.n=w.n GROUP BY 1,2,3) b JOIN net USING (arc_id) GROUP BY 1,2,3,4,5)"""


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def ids(df: DataFrame, **cols: str) -> list:
    return [F.col(v).cast("long").alias(k) for k, v in cols.items()]


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("net_links", f"WITH {NET} SELECT CAST(arc_id AS BIGINT) arc_id, CAST(tail AS BIGINT) tail, CAST(head AS BIGINT) head, capacity, length, fft, alpha, beta, toll FROM net")
def q_links(spark, d):
    x = D.net_links(spark, d)
    return x.select(*ids(x, arc_id="arc_id", tail="tail", head="head"), "capacity", "length", F.col("free_flow_time").alias("fft"), "alpha", "beta", "toll")


@query("net_demand", f"WITH {NET} SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(d AS BIGINT) dest, trips FROM dod")
def q_demand(spark, d):
    x = D.net_demand(spark, d)
    return x.select(*ids(x, class_id="class_id", origin="origin", dest="dest"), "trips")


@query("net_class_fixed_cost", f"WITH {NET} SELECT CAST(arc_id AS BIGINT) arc_id, CAST(c AS BIGINT) class_id, fc fixed_cost FROM fix")
def q_fixed(spark, d):
    x = assign.class_costs(D.net_links(spark, d), D.classes(spark))
    return x.select(*ids(x, arc_id="arc_id", class_id="class_id"), "fixed_cost")


@query("class_weights", "SELECT CAST(i AS BIGINT) class_id, CASE WHEN t<0 OR f<0 THEN 0.0::DOUBLE ELSE 1.0 END time_weight, CASE WHEN t<0 THEN 1.0::DOUBLE WHEN f<0 THEN 0.0 ELSE t END toll_weight, CASE WHEN t<0 THEN 0.0::DOUBLE WHEN f<0 THEN 1.0 ELSE f END distance_weight FROM (VALUES (0,0.0::DOUBLE,0.0::DOUBLE),(1,2.0,1.0),(2,-1.0,0.0),(3,0.0,-1.0)) v(i,t,f)")
def q_weights(spark, d):
    x = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)], "class_id long, t double, f double")
    a, b, c = C.weights(F.col("t"), F.col("f"))
    return x.select("class_id", a.alias("time_weight"), b.alias("toll_weight"), c.alias("distance_weight"))


@query("demand_total_check", f"WITH {NET} SELECT CAST(c AS BIGINT) class_id, sum(trips) total, count(*) pairs, count(DISTINCT o) origins FROM dod GROUP BY 1")
def q_totals(spark, d):
    x = D.net_demand(spark, d).groupBy(F.col("class_id").cast("long").alias("class_id"))
    return x.agg(F.sum("trips").alias("total"), F.count("*").alias("pairs"), F.countDistinct("origin").alias("origins"))


@query("trips_text_parse", "SELECT CAST(o AS BIGINT) origin, CAST(d AS BIGINT) dest, CAST(t AS DOUBLE) trips FROM (VALUES (0,1,5.5),(0,2,7.0),(1,0,3.0),(1,2,100.0)) v(o,d,t)")
def q_trips(spark, d):
    text = ["Origin 1", "2 : 5.5; 3 : 7", "Origin 2", "1 : 3; 3 : 1e2;"]
    x = tntp.trips_lines(spark.createDataFrame(list(enumerate(text)), "line_no int, line string"))
    return x.select(*ids(x, origin="origin", dest="dest"), "trips")


@query("links_forward_star_sort", f"WITH {NET} SELECT CAST(arc_id AS BIGINT) arc_id, CAST(tail AS BIGINT) tail, CAST(head AS BIGINT) head, row_number() OVER (PARTITION BY tail ORDER BY head, arc_id) star_pos, count(*) OVER (PARTITION BY tail) star_size FROM net")
def q_star(spark, d):
    x = graph.forward_star(D.net_links(spark, d))
    return x.select(*ids(x, arc_id="arc_id", tail="tail", head="head", star_pos="star_pos", star_size="star_size"))


@query("origin_index_arith", f"WITH {NET} SELECT CAST(c*25+o AS BIGINT) pseudo, CAST(c AS BIGINT) class_back, CAST(o AS BIGINT) node_back, count(*) n FROM dod GROUP BY 1,2,3")
def q_index(spark, d):
    x = assign.origin_index(D.net_demand(spark, d), D.ZONES)
    return x.groupBy(*ids(x, pseudo="pseudo", class_back="class_back", node_back="node_back")).agg(F.count("*").alias("n"))


@query("batch_assignment", f"WITH {NET} SELECT CAST((c*25+o)//10 AS BIGINT) batch, count(*) pairs, sum(trips) trips FROM dod GROUP BY 1")
def q_batch(spark, d):
    x = sinks.with_batch(D.net_demand(spark, d), D.ZONES, 10)
    return x.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("pairs"), F.sum("trips").alias("trips"))


#: A part of the network in which not every node is reached.
PART = "(arc_id % 4 = 1 AND tail < 18) OR (arc_id % 4 = 0 AND tail < 4)"


def _reach_sql(a: str, b: str, start: int) -> str:
    return f"WITH RECURSIVE {NET}, part AS (SELECT * FROM net WHERE {PART}), w(n,h) AS (SELECT {start},0 UNION SELECT part.{b},h+1 FROM w JOIN part ON part.{a}=w.n WHERE h<30) SELECT CAST(n AS BIGINT) node, CAST(min(h) AS BIGINT) hops FROM w GROUP BY 1"


@query("reach_forward", _reach_sql("tail", "head", 1))
def q_fwd(spark, d):
    x = graph.reach(D.net_links(spark, d).where(PART), 1)
    return x.select(*ids(x, node="node", hops="hops"))


@query("reach_reverse", _reach_sql("head", "tail", 20))
def q_rev(spark, d):
    x = graph.reach(D.net_links(spark, d).where(PART), 20, reverse=True)
    return x.select(*ids(x, node="node", hops="hops"))


@query("artificial_links", f"""WITH RECURSIVE {NET}, part AS (SELECT * FROM net WHERE {PART}),
 f(n) AS (SELECT 24 UNION SELECT part.head FROM f JOIN part ON part.tail=f.n), b(n) AS (SELECT 24 UNION SELECT part.tail FROM b JOIN part ON part.head=b.n)
 SELECT CAST(24 AS BIGINT) tail, CAST(n_nationkey AS BIGINT) head, 99999.0::DOUBLE free_flow_time FROM nation WHERE n_nationkey NOT IN (SELECT n FROM f)
 UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(24 AS BIGINT), 99999.0::DOUBLE FROM nation WHERE n_nationkey NOT IN (SELECT n FROM b)""")
def q_artificial(spark, d):
    nodes = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"))
    x = graph.artificial_links(D.net_links(spark, d).where(PART).select("tail", "head"), nodes)
    return x.select(*ids(x, tail="tail", head="head"), "free_flow_time")


@query("topo_depth", f"WITH RECURSIVE {NET}, w(n,h) AS (SELECT n_nationkey,0 FROM nation UNION SELECT net.head,h+1 FROM w JOIN net ON net.tail=w.n WHERE net.tail<net.head) SELECT CAST(n AS BIGINT) node, CAST(max(h) AS BIGINT) depth FROM w GROUP BY 1")
def q_topo(spark, d):
    nodes = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"))
    x = graph.topo_depth(D.net_links(spark, d).where("tail < head").select("tail", "head"), nodes)
    return x.select(*ids(x, node="node", depth="depth"))


def _link_query(name: str, expr, sql: str):
    @query(name, f"WITH {NET}, v AS (SELECT *, 1.7*capacity*((arc_id%7)/4.0) x FROM net) SELECT CAST(arc_id AS BIGINT) arc_id, round({sql},4) v FROM v")
    def q(spark, d):
        x = D.net_links(spark, d).withColumn("x", 1.7 * F.col("capacity") * ((F.col("arc_id") % 7) / F.lit(4.0)))
        return x.select(F.col("arc_id").cast("long").alias("arc_id"), r4(expr(F.col("x")), "v"))


_link_query("cost_bpr", C.time_cost, COST)
_link_query("der_bpr", lambda x: C.derivative(x) * 1000, f"({DER})*1000")
_link_query("int_bpr", C.integral, INT)
_link_query("cost_update_linear", lambda x: C.time_cost(x) + 5.0 * C.derivative(x), f"({COST})+5.0*({DER})")
_link_query("cost_update_exact", lambda x: C.time_cost(x + 5.0), COST.replace("x/", "(x+5.0)/"))

#: A conical link's parameters for the query.
CONIC = dict(a=6.0, b=1.1, e=0.05, h0=0.3, s=0.4, ca=1.0, cb=-0.5, cc=0.7, cd=2.0, m=0.2, u=0.6)


@query("cost_conic", f"""WITH {NET}, v AS (SELECT *, capacity*((arc_id%9)/8.0) x, 1-(arc_id%9)/8.0+0.05 g, (arc_id%9)/8.0/0.98 vs FROM net)
 SELECT CAST(arc_id AS BIGINT) arc_id, round(fft+fft*(1+sqrt(1.1*1.1+6.0*6.0*g*g)-6.0*g-1.1-0.3)+CASE WHEN vs<=0.875 THEN 0.4/(1-vs) WHEN vs<0.925 THEN 2.0+vs*(0.7+vs*(-0.5+vs*1.0)) ELSE 4.0 END+0.2+0.6*x/capacity,4) v,
 round(capacity*(fft*(6.0-36.0*g/sqrt(1.1*1.1+6.0*6.0*g*g))/capacity+CASE WHEN vs<=0.875 THEN 0.4/(0.98*capacity)/((1-vs)*(1-vs)) WHEN vs<0.925 THEN (0.7+vs*(-1.0+3*vs))/(0.98*capacity) ELSE 0 END+0.6/capacity),4) der FROM v""")
def q_conic(spark, d):
    x = D.net_links(spark, d).withColumn("x", F.col("capacity") * ((F.col("arc_id") % 9) / F.lit(8.0)))
    p = {k: F.lit(v) for k, v in CONIC.items()} | {"sat": F.col("capacity") * 0.98}
    return x.select(F.col("arc_id").cast("long").alias("arc_id"), r4(C.conic_cost(F.col("x"), p), "v"), r4(F.col("capacity") * C.conic_derivative(F.col("x"), p), "der"))


@query("gen_cost_by_class", S0 + " SELECT CAST(c AS BIGINT) class_id, CAST(arc_id AS BIGINT) arc_id, round(cost,4) gen_cost FROM gc0")
def q_gen(spark, d):
    b = Base(spark, d)
    st, lc = b.tables(b.first())
    x = lc.join(st.select("arc_id", "time_cost"), "arc_id")
    return x.select(*ids(x, class_id="class_id", arc_id="arc_id"), r4(F.col("time_cost") + F.col("fixed_cost"), "gen_cost"))


@query("sp_labels", T0 + " SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(n AS BIGINT) node, cost FROM lab0")
def q_labels(spark, d):
    x = Base(spark, d).labels()
    return x.select(*ids(x, class_id="class_id", origin="origin", node="node"), "cost")


@query("sp_labels_relational", T0 + " SELECT CAST(o AS BIGINT) origin, CAST(n AS BIGINT) node, cost FROM lab0 WHERE c=0")
def q_labels_rel(spark, d):
    links = D.net_links(spark, d).withColumn("cost", F.col("free_flow_time"))
    origins = spark.range(D.ZONES).select(F.lit(0).alias("class_id"), F.col("id").cast("int").alias("origin"))
    x = graph.labels_relational(links.checkpoint(), origins)
    return x.select(*ids(x, origin="origin", node="node"), "cost")


@query("sp_pred", T0 + " SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(n AS BIGINT) node, CAST(arc_id AS BIGINT) pred_arc FROM pred0")
def q_pred(spark, d):
    x = Base(spark, d).labels().where("pred_arc is not null")
    return x.select(*ids(x, class_id="class_id", origin="origin", node="node", pred_arc="pred_arc"))


@query("dest_rank_by_label", T0 + " SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(n AS BIGINT) node, row_number() OVER (PARTITION BY c,o ORDER BY cost,n) rank FROM lab0")
def q_rank(spark, d):
    x = assign.dest_rank(Base(spark, d).labels())
    return x.select(*ids(x, class_id="class_id", origin="origin", node="node", rank="rank"))


@query("aon_flow", T0 + " SELECT CAST(arc_id AS BIGINT) arc_id, sum(flow) flow FROM aon0 GROUP BY 1")
def q_aon(spark, d):
    b = Base(spark, d)
    x = assign.all_or_nothing(b.demand, b.g, b.cost(), b.ids).where("arc_id >= 0")
    return x.groupBy(F.col("arc_id").cast("long").alias("arc_id")).agg(F.sum("flow").alias("flow"))


@query("aon_flow_multiclass", T0 + " SELECT CAST(c AS BIGINT) class_id, CAST(arc_id AS BIGINT) arc_id, flow FROM aon0")
def q_aon_mc(spark, d):
    b = Base(spark, d)
    x = assign.all_or_nothing(b.demand, b.g, b.cost(), b.ids).where("arc_id >= 0")
    return x.select(*ids(x, class_id="class_id", arc_id="arc_id"), "flow")


@query("sptt", T0 + " SELECT CAST(dod.c AS BIGINT) class_id, sum(trips*cost) sptt FROM dod JOIN lab0 l ON l.c=dod.c AND l.o=dod.o AND l.n=dod.d GROUP BY 1")
def q_sptt(spark, d):
    b = Base(spark, d)
    return assign.sptt(b.demand, b.labels()).select(F.col("class_id").cast("long").alias("class_id"), "sptt")


@query("tstt", S0 + " SELECT round(sum(f*(tc+fc)),1) tstt FROM lc0 JOIN st0 USING (arc_id)")
def q_tstt(spark, d):
    b = Base(spark, d)
    return M.tstt(*b.tables(b.first())).select(F.round("tstt", 1).alias("tstt"))


@query("beckmann", S0 + " SELECT round((SELECT sum(area) FROM st0)+(SELECT sum(f*fc) FROM lc0),1) objective")
def q_beckmann(spark, d):
    b = Base(spark, d)
    return M.beckmann(*b.tables(b.first())).select(F.round("objective", 1).alias("objective"))


GAPS = S0 + ", " + tree_sql("1", "gc0") + """, tt AS (SELECT sum(f*(tc+fc)) v FROM lc0 JOIN st0 USING (arc_id)),
 ss AS (SELECT sum(trips*cost) v FROM dod JOIN lab1 l ON l.c=dod.c AND l.o=dod.o AND l.n=dod.d), dd AS (SELECT sum(trips) v FROM dod)"""


def _gap_frame(spark, d) -> DataFrame:
    b = Base(spark, d)
    flow = b.first()
    return M.tstt(*b.tables(flow)).crossJoin(assign.sptt(b.demand, b.labels(flow)).agg(F.sum("sptt").alias("sptt"))).crossJoin(b.demand.agg(F.sum("trips").alias("demand")))


@query("rel_gap", GAPS + " SELECT round(tt.v/ss.v-1,4) gap FROM tt, ss")
def q_gap(spark, d):
    return _gap_frame(spark, d).select(r4(M.relative_gap(F.col("tstt"), F.col("sptt")), "gap"))


@query("avg_excess_cost", GAPS + " SELECT round((tt.v-ss.v)/dd.v,2) gap FROM tt, ss, dd")
def q_aec(spark, d):
    return _gap_frame(spark, d).select(F.round(M.average_excess_cost(F.col("tstt"), F.col("sptt"), F.col("demand")), 2).alias("gap"))


@query("gap2_running_bound", "SELECT CAST(i AS BIGINT) iter, round(o/max(o+s-t) OVER (ORDER BY i)-1,4) gap2 FROM (SELECT l_linenumber i, 1000+100.0/l_linenumber o, 900+10.0*(l_linenumber%3) s, 950+40.0/l_linenumber t FROM lineitem GROUP BY l_linenumber)")
def q_gap2(spark, d):
    i = F.col("l_linenumber")
    x = D.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*")).select(i.alias("iter"), (1000 + 100.0 / i).alias("objective"), (900 + 10.0 * (i % 3)).alias("sptt"), (950 + 40.0 / i).alias("tstt"))
    x = M.bound_gap(x)
    return x.select(*ids(x, iter="iter"), r4(F.col("gap2"), "gap2"))


@query("class_totals_rollup", S0 + ' SELECT CAST(c AS BIGINT) class_id, round(sum(f*tc),1) "time", round(sum(f*length),1) distance, round(sum(f*toll),1) toll, round(sum(f*(tc+fc)),1) generalized_cost FROM lc0 JOIN st0 USING (arc_id) GROUP BY ROLLUP (c)')
def q_rollup(spark, d):
    b = Base(spark, d)
    x = M.class_totals(*b.tables(b.first()))
    return x.select(F.col("class_id").cast("long").alias("class_id"), *(F.round(c, 1).alias(c) for c in ("time", "distance", "toll", "generalized_cost")))


@query("report_pivot", S0 + " SELECT CAST(arc_id AS BIGINT) arc_id, max(x) total_flow, round(max(tc),4) travel_time, sum(CASE WHEN c=0 THEN f ELSE 0 END) class1, sum(CASE WHEN c=1 THEN f ELSE 0 END) class2 FROM lc0 JOIN st0 USING (arc_id) GROUP BY 1")
def q_report(spark, d):
    b = Base(spark, d)
    st, lc = b.tables(b.first())
    x = sinks.report(b.links, lc, st, [0, 1])
    return x.select(*ids(x, arc_id="arc_id"), "total_flow", r4(F.col("travel_time"), "travel_time"), "class1", "class2")


def _directions(spark, d, passes: int = 1):
    """Base, flow and loading direction after `passes` - 1 half steps, and the last direction scaled by what is left."""
    b = Base(spark, d)
    flow, old = b.first(), None
    for k in range(passes):
        aon = b.load(flow)[0] - flow
        if k + 1 < passes:
            flow, old = flow + 0.5 * aon, 0.5 * aon
    return b, flow, aon, old


@query("fw_direction", DIR1 + " SELECT CAST(c AS BIGINT) class_id, CAST(arc_id AS BIGINT) arc_id, round(d,4) d FROM dir1")
def q_direction(spark, d):
    b, flow, aon, _ = _directions(spark, d)
    x = S.Result(aon).link_class(spark, b.net)
    return x.select(*ids(x, class_id="class_id", arc_id="arc_id"), r4(F.col("flow"), "d"))


@query("msa_pass1", X1 + " SELECT CAST(arc_id AS BIGINT) arc_id, round(x,4) flow, round(tc,4) time_cost FROM st1")
def q_msa1(spark, d):
    b, flow, aon, _ = _directions(spark, d)
    x, _ = b.tables(flow + 0.5 * aon)
    return x.select(*ids(x, arc_id="arc_id"), r4(F.col("flow"), "flow"), r4(F.col("time_cost"), "time_cost"))


@query("msa_pass2", T2 + " SELECT CAST(l.arc_id AS BIGINT) arc_id, round(sum(l.f+(coalesce(a.flow,0)-l.f)/3),4) flow FROM lc1 l LEFT JOIN aon2 a ON a.c=l.c AND a.arc_id=l.arc_id GROUP BY 1")
def q_msa2(spark, d):
    b, flow, aon, _ = _directions(spark, d, 2)
    x, _ = b.tables(flow + aon / 3)
    return x.select(*ids(x, arc_id="arc_id"), r4(F.col("flow"), "flow"))


#: One aggregation over the 511 inner points of the tenth halving stands for all rounds, as the slope never falls.
@query("fw_bisection_step", DIR1 + f""", tot1 AS (SELECT arc_id, sum(f) f, sum(d) d FROM dir1 GROUP BY 1), fixd AS (SELECT sum(fc*d) v FROM dir1 JOIN fix USING (c,arc_id)),
 gl AS (SELECT k, sum(({COST})*d) g FROM (SELECT net.*, k, t.d, t.f+k/512.0*t.d AS x FROM net JOIN tot1 t USING (arc_id), range(1,512) r(k)) GROUP BY k)
 SELECT round((2*coalesce(max(k),0)+1)/1024.0::DOUBLE,10) step FROM gl, fixd WHERE g+fixd.v<=0""")
def q_bisection(spark, d):
    b, flow, aon, _ = _directions(spark, d)
    return spark.createDataFrame([(round(S.bisection(b.net, flow, aon), 10),)], "step double")


@query("fw_newton_step", DIR1 + ", tot1 AS (SELECT arc_id, sum(d) d FROM dir1 GROUP BY 1) SELECT round(least(1,greatest(0,-(SELECT sum((s.tc+l.fc)*d.d) FROM dir1 d JOIN lc0 l ON l.c=d.c AND l.arc_id=d.arc_id JOIN st0 s ON s.arc_id=d.arc_id)/(SELECT sum(der*d*d) FROM tot1 JOIN st0 USING (arc_id)))),8) step")
def q_newton(spark, d):
    b, flow, aon, _ = _directions(spark, d)
    return spark.createDataFrame([(round(S.newton_iteration(b.net, flow, aon, 0.0, 0.0, 1.0), 8),)], "step double")


def _second(spark, d) -> DataFrame:
    """(arc_id, aon, old, der) of the second pass, link totals."""
    b, flow, aon, old = _directions(spark, d, 2)
    h = b.net.performance(flow.sum(0))[1]
    return spark.createDataFrame([(int(a), float(x), float(y), float(z)) for a, x, y, z in zip(b.ids, aon.sum(0), old.sum(0), h, strict=True)], "arc_id int, aon double, old double, der double")


@query("conjugacy", DIR2 + " SELECT round(sum(der*aon*old),2) product FROM two_h")
def q_conjugacy(spark, d):
    x = _second(spark, d)
    return M.conjugacy(x.select("arc_id", F.col("aon").alias("d")), x.select("arc_id", F.col("old").alias("d")), x).select(F.round("product", 2).alias("product"))


@query("cfw_alpha", DIR2 + " SELECT round(least(1-1e-8,greatest(0,sum(der*aon*old)/sum(der*old*(aon-old)))),8) alpha FROM two_h")
def q_cfw(spark, d):
    n, q = F.sum(F.col("der") * F.col("aon") * F.col("old")), F.sum(F.col("der") * F.col("old") * (F.col("aon") - F.col("old")))
    return _second(spark, d).agg(F.round(F.least(F.lit(1 - 1e-8), F.greatest(F.lit(0.0), n / q)), 8).alias("alpha"))


@query("bfw_coeffs", DIR2 + """, o AS (SELECT *, aon*0.3-old*0.2 AS oo FROM two_h), s AS (SELECT greatest(0,-sum(der*aon*oo)/sum(der*oo*(oo-old))*0.5) mu, sum(der*aon*old)/sum(der*old*old) q FROM o),
 t AS (SELECT mu, greatest(0,mu*0.5/0.5-q) nu FROM s) SELECT round(1/(1+mu+nu),8) b0, round(nu/(1+mu+nu),8) b1, round(mu/(1+mu+nu),8) b2 FROM t""")
def q_bfw(spark, d):
    p = _second(spark, d).toPandas()  # a row per road link
    b = S.bfw_weights(p.der.to_numpy(), p.aon.to_numpy(), p.old.to_numpy(), (p.aon * 0.3 - p.old * 0.2).to_numpy(), 0.5)
    return spark.createDataFrame([tuple(round(v, 8) for v in b)], "b0 double, b1 double, b2 double")


RC = BUSH + """, rc AS MATERIALIZED (SELECT a.c, a.o, g.arc_id, g.cost+a.cost-b.cost AS rc, u.arc_id IS NOT NULL AS used FROM gc0 g JOIN lab1 a ON a.c=g.c AND a.n=g.tail JOIN lab1 b ON b.c=a.c AND b.o=a.o AND b.n=g.head
 LEFT JOIN bush u ON u.c=a.c AND u.o=a.o AND u.arc_id=g.arc_id WHERE EXISTS (SELECT 1 FROM dod WHERE dod.c=a.c AND dod.o=a.o))"""


def _rc(spark, d) -> DataFrame:
    b = Base(spark, d)
    flow = b.first()
    st, lc = b.tables(flow)
    links = lc.join(st.select("arc_id", "tail", "head", "time_cost"), "arc_id").select("arc_id", "class_id", "tail", "head", (F.col("time_cost") + F.col("fixed_cost")).alias("gen_cost"))
    lab = b.labels(flow).join(b.demand.select("class_id", "origin").distinct(), ["class_id", "origin"])
    return bushes.reduced_costs(b.bush(), lab, links)


@query("reduced_cost_bins", RC + " SELECT used, CAST(CASE WHEN abs(rc)<1e-9 THEN 0 ELSE greatest(0,least(69,floor(log2(abs(rc)))+61)) END AS BIGINT) bin, count(*) n FROM rc GROUP BY 1,2")
def q_bins(spark, d):
    return bushes.rc_bins(_rc(spark, d))


@query("accept_reject_gap", RC + " SELECT round(max(CASE WHEN used THEN rc END),4) accept_gap, round(min(CASE WHEN NOT used AND rc>1e-8 THEN rc END),4) reject_gap FROM rc")
def q_accept(spark, d):
    return bushes.acceptance(_rc(spark, d)).select(r4(F.col("accept_gap"), "accept_gap"), r4(F.col("reject_gap"), "reject_gap"))


@query("node_flow_balance", BUSH + """, i AS (SELECT c,o,head n,sum(f) f FROM bush GROUP BY 1,2,3), u AS (SELECT c,o,tail n,sum(f) f FROM bush GROUP BY 1,2,3)
 SELECT CAST(i.c AS BIGINT) class_id, CAST(i.o AS BIGINT) origin, CAST(i.n AS BIGINT) node, round(i.f,4) inflow, round(coalesce(u.f,0),4) outflow FROM i LEFT JOIN u ON u.c=i.c AND u.o=i.o AND u.n=i.n WHERE i.n<>i.o""")
def q_balance(spark, d):
    b = Base(spark, d)
    x = bushes.balance(b.bush(), b.demand)
    return x.select(*ids(x, class_id="class_id", origin="origin", node="node"), r4(F.col("inflow"), "inflow"), r4(F.col("outflow"), "outflow"))


@query("merge_nodes", BUSH + " SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(head AS BIGINT) head, count(*) approaches, round(sum(f),4) node_flow, CAST(min(arc_id) AS BIGINT) first_arc, CAST(max(arc_id) AS BIGINT) last_arc FROM bush GROUP BY 1,2,3 HAVING count(*)>1")
def q_merges(spark, d):
    x = bushes.merge_nodes(Base(spark, d).bush())
    return x.select(*ids(x, class_id="class_id", origin="origin", head="head", approaches="approaches"), r4(F.col("node_flow"), "node_flow"), *ids(x, first_arc="first_arc", last_arc="last_arc"))


@query("merge_share", BUSH + " SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(arc_id AS BIGINT) arc_id, round(f/sum(f) OVER (PARTITION BY c,o,head),8) share FROM bush")
def q_share(spark, d):
    x = bushes.merge_share(Base(spark, d).bush())
    return x.select(*ids(x, class_id="class_id", origin="origin", arc_id="arc_id"), F.round("share", 8).alias("share"))


@query("entropy", BUSH + " SELECT CAST(c AS BIGINT) class_id, round(-sum(f*ln(f/t)),4) entropy FROM (SELECT *, sum(f) OVER (PARTITION BY c,o,head) t FROM bush) GROUP BY 1")
def q_entropy(spark, d):
    return bushes.entropy(Base(spark, d).bush()).select(F.col("class_id").cast("long").alias("class_id"), r4(F.col("entropy"), "entropy"))


@query("path_flows", T0 + """, pw(c,o,d,n,trips,path) AS (SELECT c,o,d,d,trips,CAST(d AS VARCHAR) FROM dod UNION ALL SELECT w.c,w.o,w.d,e.tail,w.trips,e.tail||','||w.path FROM pw w
 JOIN pred0 p ON p.c=w.c AND p.o=w.o AND p.n=w.n JOIN net e ON e.arc_id=p.arc_id)
 SELECT CAST(c AS BIGINT) class_id, CAST(o AS BIGINT) origin, CAST(d AS BIGINT) dest, path nodes, trips flow FROM pw WHERE n=o""")
def q_paths(spark, d):
    b = Base(spark, d)
    x = bushes.path_flows(bushes.tree_bushes(b.demand, b.g, b.cost()), b.demand)
    return x.select(*ids(x, class_id="class_id", origin="origin", dest="dest"), F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"), "flow")


@query("max_excess_cost", T1 + """, lw(c,o,d,n,cost) AS (SELECT c,o,d,d,CAST(0 AS DOUBLE) FROM dod UNION ALL SELECT w.c,w.o,w.d,g.tail,w.cost+g.cost FROM lw w JOIN pred0 p ON p.c=w.c AND p.o=w.o AND p.n=w.n JOIN gc0 g ON g.c=p.c AND g.arc_id=p.arc_id)
 SELECT round(max(w.cost-l.cost),4) max_excess_cost FROM lw w JOIN lab1 l ON l.c=w.c AND l.o=w.o AND l.n=w.d WHERE w.n=w.o""")
def q_mec(spark, d):
    b = Base(spark, d)
    flow = b.first()
    st, lc = b.tables(flow)
    cost = lc.join(st.select("arc_id", "tail", "head", "time_cost"), "arc_id").select("class_id", F.col("tail").alias("a"), F.col("head").alias("b"), (F.col("time_cost") + F.col("fixed_cost")).alias("gen"))
    p = bushes.path_flows(bushes.tree_bushes(b.demand, b.g, b.cost()), b.demand)
    steps = p.select("class_id", "origin", "dest", F.explode(F.expr("transform(sequence(0, size(nodes) - 2), i -> struct(nodes[i] AS a, nodes[i + 1] AS b))")).alias("s")).select("class_id", "origin", "dest", "s.*")
    used = steps.join(cost, ["class_id", "a", "b"]).groupBy("class_id", "origin", "dest").agg(F.sum("gen").alias("longest"))
    lab = b.labels(flow).select("class_id", "origin", F.col("node").alias("dest"), F.col("cost").alias("shortest"))
    return M.max_excess(used.join(lab, ["class_id", "origin", "dest"])).select(r4(F.col("max_excess_cost"), "max_excess_cost"))


def _equilibrium(name: str, **cfg):
    @query(name)
    def q(spark, d):
        b = Base(spark, d)
        r = S.solve(b.net, b.demand, S.SolverConfig.preset(name.removesuffix("_equilibrium"), **cfg))
        x, _ = b.tables(r.flow)
        return x.select(*ids(x, arc_id="arc_id"), r4(F.col("flow"), "flow"), r4(F.col("time_cost"), "time_cost"))


_equilibrium("msa_equilibrium", max_iterations=10)
_equilibrium("fw_equilibrium", max_iterations=10)
_equilibrium("cfw_equilibrium", max_iterations=10)
_equilibrium("bfw_equilibrium", max_iterations=10)
_equilibrium("bush_equilibrium", max_iterations=40, gap=1e-9)


@query("bush_distributed_equilibrium")
def q_distributed(spark, d):
    """Origins in four blocks that move in parallel."""
    b = Base(spark, d)
    r = S.bush_distributed(b.net, b.demand, S.SolverConfig.preset("bush", max_iterations=12, gap=1e-7), blocks=4)
    x, _ = b.tables(r.flow)
    return x.select(*ids(x, arc_id="arc_id"), r4(F.col("flow"), "flow"), r4(F.col("time_cost"), "time_cost"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """All-or-nothing flow per link."""
    return q_aon(spark, d)
