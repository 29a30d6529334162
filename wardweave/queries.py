"""Registered queries over the driver's tables as a districting graph, with their SQL.

Doubles are rounded to nine places on both sides. Chains are random walks: their queries score
what the kernels return and have no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import scores as S
from .sources import geometry as P
from .sources import graphs as G

PARTIES = {"d": "votes_d", "r": "votes_r"}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BASE = """
WITH RECURSIVE o AS (SELECT o_custkey, count(*) AS p, count(*) FILTER (o_orderstatus = 'F') AS d, count(*) FILTER (o_orderstatus = 'O') AS r, count(*) FILTER (o_orderstatus = 'P') AS x FROM orders GROUP BY 1),
n0 AS (SELECT c_custkey AS node_id, c_custkey // 30 AS row, c_custkey % 30 AS col, CAST(coalesce(p, 0) AS BIGINT) AS population, CAST(coalesce(d, 0) AS BIGINT) AS votes_d, CAST(coalesce(r, 0) AS BIGINT) AS votes_r, c_nationkey AS county, c_mktsegment AS muni FROM customer LEFT JOIN o ON o_custkey = c_custkey),
e AS (SELECT a.node_id AS src, b.node_id AS dst FROM n0 a JOIN n0 b ON b.node_id = a.node_id + 1 WHERE a.col < 29 UNION ALL SELECT a.node_id, b.node_id FROM n0 a JOIN n0 b ON b.node_id = a.node_id + 30),
g AS (SELECT x AS node_id, count(*) AS degree FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
n AS (SELECT n0.*, 4 - coalesce(degree, 0) AS bp FROM n0 LEFT JOIN g USING (node_id)),
p AS (SELECT 'bands' || k AS plan_id, node_id, CAST(floor(k * row / (SELECT max(row) + 1 FROM n0)) AS INTEGER) AS part FROM n0, (SELECT unnest([5, 8]) AS k)),
p5 AS (SELECT * FROM p WHERE plan_id = 'bands5'),
f AS (SELECT event_id AS step, user_id * 10 + event_id % 10 AS node_id, CAST(CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS part FROM events),
l AS (SELECT node_id, max_by(part, step) AS part FROM f GROUP BY 1),
q AS (SELECT p5.plan_id, p5.node_id, coalesce(l.part, p5.part) AS part FROM p5 LEFT JOIN l USING (node_id)),
c AS (SELECT a.plan_id, e.src, e.dst, a.part AS ps, b.part AS pd FROM e JOIN p a ON a.node_id = e.src JOIN p b ON b.node_id = e.dst AND b.plan_id = a.plan_id WHERE a.part <> b.part),
cq AS (SELECT e.src, e.dst, a.part AS ps, b.part AS pd FROM e JOIN q a ON a.node_id = e.src JOIN q b ON b.node_id = e.dst WHERE a.part <> b.part),
k AS (SELECT plan_id, unnest([ps, pd]) AS part, src, dst FROM c),
t AS (SELECT plan_id, part, CAST(sum(population) AS BIGINT) AS population, CAST(sum(votes_d) AS BIGINT) AS votes_d, CAST(sum(votes_r) AS BIGINT) AS votes_r, count(*) AS area FROM p JOIN n USING (node_id) GROUP BY 1, 2),
m AS (SELECT t.*, CAST(coalesce(x, 0) AS DOUBLE) AS exterior, CAST(coalesce(i, 0) AS DOUBLE) AS interior, CAST(coalesce(x, 0) + coalesce(i, 0) AS DOUBLE) AS perimeter FROM t LEFT JOIN (SELECT plan_id, part, sum(bp) AS x FROM p JOIN n USING (node_id) GROUP BY ALL) USING (plan_id, part) LEFT JOIN (SELECT plan_id, part, count(*) AS i FROM k GROUP BY ALL) USING (plan_id, part)),
pp AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS polsby_popper FROM m),
v AS (SELECT plan_id, part, votes_d AS v1, votes_r AS v2, CAST(votes_d AS DOUBLE) / (votes_d + votes_r) AS share FROM t)
"""


def graph(spark: SparkSession, sf_dir: str):
    nodes, edges = G.customers(spark, sf_dir)
    return nodes, edges, G.bands(nodes, 5).unionAll(G.bands(nodes, 8))


def flipped(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    return S.plan_at(G.bands(nodes, 5), G.flip_log(spark, sf_dir), 2**62)


def nine(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a function of (nodes, edges, plans, spark, sf_dir) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return nine(f(*graph(spark, sf_dir), spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


R = lambda *names: ", ".join(f"round({x}, 9) AS {x.split('.')[-1]}" for x in names)


@query("SELECT plan_id, part, population, votes_d, votes_r FROM t")
def tally_population(n, e, p, *_):
    return S.tally(n, p, population="population", votes_d="votes_d", votes_r="votes_r")


@query("SELECT plan_id, part, CAST(sum(votes_d + votes_r) AS BIGINT) AS votes FROM p JOIN n USING (node_id) GROUP BY ALL")
def tally_fields(n, e, p, *_):
    return S.tally(n, p, votes=["votes_d", "votes_r"])


@query("SELECT plan_id, src, dst FROM c")
def cut_edges(n, e, p, *_):
    return S.cut_edges(e, p).select("plan_id", "src", "dst")


@query("SELECT plan_id, part, count(*) AS cut_edges FROM k GROUP BY ALL")
def cut_edges_by_part(n, e, p, *_):
    return S.by_part(S.cut_edges(e, p)).groupBy("plan_id", "part").agg(F.count("*").alias("cut_edges"))


@query("SELECT plan_id, part, exterior, interior, perimeter FROM m")
def perimeter(n, e, p, *_):
    return S.perimeters(n, e, p)


@query(f"SELECT plan_id, part, CAST(area AS DOUBLE) AS area, perimeter, {R('polsby_popper')} FROM pp")
def polsby_popper(n, e, p, *_):
    return S.compact(n, e, p).select("plan_id", "part", "area", "perimeter", "polsby_popper")


@query("SELECT plan_id, round(sum(polsby_popper), 9) AS l1, round(sqrt(sum(polsby_popper * polsby_popper)), 9) AS l2, round(count(*) / sum(1 / polsby_popper), 9) AS harmonic, round(sum(1 / polsby_popper), 9) AS l1_reciprocal FROM pp GROUP BY 1")
def pp_norms(n, e, p, *_):
    return S.norms(S.compact(n, e, p))


@query("SELECT plan_id, part, population, round((population - avg(population) OVER w) / avg(population) OVER w, 9) AS deviation FROM t WINDOW w AS (PARTITION BY plan_id)")
def population_deviation(n, e, p, *_):
    return S.deviation(S.tally(n, p, population="population"))


@query("SELECT plan_id, min(population) >= 100 AND max(population) <= 4000 AS valid FROM t GROUP BY 1")
def bounds_check(n, e, p, *_):
    return S.within_bounds(S.tally(n, p, population="population"), "population", 100, 4000)


@query("SELECT plan_id, max(population) - min(population) <= 0.1 * min(population) AS valid FROM t GROUP BY 1")
def tolerance_check(n, e, p, *_):
    return S.within_tolerance(S.tally(n, p, population="population"))


@query("SELECT plan_id, 'election' AS election, v.party_ord, v.party, v.votes, part, votes_d + votes_r AS total, round(CAST(v.votes AS DOUBLE) / (votes_d + votes_r), 9) AS share, v.votes > v.other AS won FROM (SELECT *, unnest([{'party_ord': 0, 'party': 'd', 'votes': votes_d, 'other': votes_r}, {'party_ord': 1, 'party': 'r', 'votes': votes_r, 'other': votes_d}]) AS v FROM t)")
def election_results(n, e, p, *_):
    return S.election(n, p, PARTIES)


@query("SELECT plan_id, 'election' AS election, v.party AS party, count(*) FILTER (v.votes > v.other) AS seats, CAST(sum(v.votes) AS BIGINT) AS votes, round(CAST(sum(v.votes) AS DOUBLE) / sum(votes_d + votes_r), 9) AS share FROM (SELECT *, unnest([{'party': 'd', 'votes': votes_d, 'other': votes_r}, {'party': 'r', 'votes': votes_r, 'other': votes_d}]) AS v FROM t) GROUP BY 1, 3")
def seats(n, e, p, *_):
    return S.seats(S.election(n, p, PARTIES))


@query("SELECT plan_id, part, CAST(CASE WHEN v1 > v2 THEN v1 - (v1 + v2) / 2.0 ELSE v1 END AS DOUBLE) AS wasted_d, CAST(CASE WHEN v1 > v2 THEN v2 ELSE v2 - (v1 + v2) / 2.0 END AS DOUBLE) AS wasted_r FROM v")
def wasted_votes(n, e, p, *_):
    a, b = S.wasted(F.col("v1"), F.col("v2"))
    return S.two_party(S.election(n, p, PARTIES)).select("plan_id", "part", a.alias("wasted_d"), b.alias("wasted_r"))


@query("""
, z AS (SELECT *, avg(share) OVER (PARTITION BY plan_id) AS mean, sum(v1) OVER (PARTITION BY plan_id) / CAST(sum(v1 + v2) OVER (PARTITION BY plan_id) AS DOUBLE) AS overall, row_number() OVER (PARTITION BY plan_id ORDER BY share DESC) AS i, row_number() OVER (PARTITION BY plan_id ORDER BY share) AS j FROM v),
y AS (SELECT a.plan_id, avg(abs((a.overall - a.share + 0.5) - (1 - (b.overall - b.share + 0.5)))) AS gini FROM z a JOIN z b ON a.plan_id = b.plan_id AND a.i = b.j GROUP BY 1)
SELECT plan_id, 'election' AS election, round(median(share) - avg(share), 9) AS mean_median, round(list_sort(list(share))[CAST(round_even(count(*) / 3.0, 0) AS INTEGER) + 1] - avg(share), 9) AS mean_thirdian,
 round(sum(CAST(CASE WHEN v1 > v2 THEN v2 - (v1 - (v1 + v2) / 2.0) ELSE v2 - (v1 + v2) / 2.0 - v1 END AS DOUBLE)) / sum(v1 + v2), 9) AS efficiency_gap, round(count(*) FILTER (share > mean) / CAST(count(*) AS DOUBLE) - 0.5, 9) AS partisan_bias, round(any_value(gini), 9) AS partisan_gini FROM z JOIN y USING (plan_id) GROUP BY 1""")
def partisan_metrics(n, e, p, *_):
    return S.partisan(S.election(n, p, PARTIES))


@query("SELECT plan_id, county, count(DISTINCT part) AS n_parts, count(*) AS n_nodes, count(DISTINCT part) > 1 AS split FROM p JOIN n USING (node_id) GROUP BY ALL")
def county_splits(n, e, p, *_):
    return S.counties(n, p, "county").select("plan_id", "county", F.size("parts").cast("long").alias("n_parts"), "n_nodes", "split")


@query("SELECT plan_id, count(DISTINCT CASE WHEN a.muni = b.muni THEN a.muni END) AS split_regions FROM c JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst GROUP BY 1")
def region_splits(n, e, p, *_):
    return S.region_splits(n, e, p, "muni")


@query("""
, x AS (SELECT plan_id, county, part, CAST(count(*) AS DOUBLE) AS n, CAST(sum(population) AS DOUBLE) AS p FROM p JOIN n USING (node_id) GROUP BY ALL),
y AS (SELECT *, sum(n) OVER (PARTITION BY plan_id, county) AS nl, sum(n) OVER (PARTITION BY plan_id) AS al, sum(p) OVER (PARTITION BY plan_id, county) AS pl, sum(p) OVER (PARTITION BY plan_id, part) AS pd, count(*) OVER (PARTITION BY plan_id, county) AS k FROM x),
b AS (SELECT plan_id, count(*) AS naked FROM c JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst WHERE a.county = b.county GROUP BY 1)
SELECT y.plan_id, count(*) AS num_parts, round(sum(nl / al * n / nl * ln(nl / n)), 9) AS shannon_entropy, round(sum(pow(n / nl, 0.95) * al / nl) - sum(al / nl / k), 9) AS power_entropy, round(sum(sqrt(p * pd) + sqrt(p * pl)), 9) AS symmetric_entropy, count(DISTINCT CASE WHEN k > 1 THEN county END) AS num_split_localities, coalesce(any_value(naked), 0) AS naked_boundary FROM y LEFT JOIN b ON b.plan_id = y.plan_id GROUP BY 1""")
def locality_scores(n, e, p, *_):
    return S.localities(n, e, p, "county")


@query("SELECT plan_id, county, CAST(ceil(sum(population) * k / CAST(sum(sum(population)) OVER (PARTITION BY plan_id) AS DOUBLE)) AS BIGINT) AS allowed_pieces FROM p JOIN n USING (node_id) JOIN (SELECT plan_id, count(DISTINCT part) AS k FROM p GROUP BY 1) USING (plan_id) GROUP BY plan_id, county, k")
def allowed_pieces(n, e, p, *_):
    return S.allowed_pieces(n, p, "county")


REACH = """
, s AS (SELECT a.part, e.src AS a, e.dst AS b FROM e JOIN q a ON a.node_id = src JOIN q b ON b.node_id = dst WHERE a.part = b.part), u AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), r AS (SELECT node_id AS a, node_id AS b FROM q UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
w AS (SELECT a AS node_id, min(b) AS component FROM r GROUP BY 1)
"""


@query(REACH + "SELECT q.part, node_id, component FROM w JOIN q USING (node_id)")
def components(n, e, p, spark, sf):
    return S.components(n, e, flipped(spark, sf, n)).select("part", "node_id", "component")


@query(REACH + "SELECT count(*) FILTER (k = 1) AS contiguous_parts, count(*) AS parts, bool_and(k = 1) AS contiguous FROM (SELECT part, count(DISTINCT component) AS k FROM w JOIN q USING (node_id) GROUP BY 1)")
def contiguous_parts(n, e, p, spark, sf):
    return S.contiguity(S.components(n, e, flipped(spark, sf, n))).drop("plan_id")


@query("SELECT node_id, part FROM q")
def plan_at_step(n, e, p, spark, sf):
    return flipped(spark, sf, n).select("node_id", "part")


@query("SELECT node_id, unnest([a.part, b.part]) AS part, unnest(['out', 'in']) AS direction FROM p5 a JOIN q b USING (node_id) WHERE a.part <> b.part")
def flows(n, e, p, spark, sf):
    return S.flows(G.bands(n, 5), flipped(spark, sf, n)).drop("plan_id")


CUTS = ", a AS (SELECT src, dst, unnest([ps, pd]) AS part FROM c WHERE plan_id = 'bands5'), b AS (SELECT src, dst, unnest([ps, pd]) AS part FROM cq)\n"


@query(CUTS + "SELECT src, dst, part, 'out' AS direction FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT src, dst, part, 'in' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def edge_flows(n, e, p, spark, sf):
    return S.edge_flows(e, G.bands(n, 5), flipped(spark, sf, n)).drop("plan_id")


@query(CUTS + "SELECT src, dst, 'new' AS change FROM (SELECT src, dst FROM b EXCEPT SELECT src, dst FROM a) UNION ALL SELECT src, dst, 'obsolete' FROM (SELECT src, dst FROM a EXCEPT SELECT src, dst FROM b)")
def incremental_cut_edges(n, e, p, spark, sf):
    return S.changed_cuts(e, G.bands(n, 5), flipped(spark, sf, n)).drop("plan_id")


@query("SELECT event_id AS step, user_id AS chain, value, max(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_best(n, e, p, spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("step"), "value")
    return S.running_best(ev, "value").select("step", F.col("plan_id").alias("chain"), "value", "best")


@query("SELECT plan_id, unnest([src, dst]) AS node_id, unnest([pd, ps]) AS part FROM c")
def metagraph_flips(n, e, p, *_):
    return S.metagraph_flips(e, p)


@query("SELECT plan_id, 2 * count(*) AS degree FROM c GROUP BY 1 UNION ALL SELECT 'whole', 0")
def metagraph_degree(n, e, p, *_):
    whole = n.select(F.lit("whole").alias("plan_id"), "node_id", F.lit(0).alias("part"))
    return S.metagraph_degree(e, p.unionAll(whole))


@query("SELECT n.node_id, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (node_id)")
def degrees(n, e, *_):
    return G.degrees(n, e)


@query("SELECT node_id FROM n WHERE node_id NOT IN (SELECT unnest([src, dst]) FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0)")
def islands(n, e, *_):
    """Of the graph without the edges of every fifth node."""
    return G.islands(n, e.filter("src % 5 <> 0 and dst % 5 <> 0")).select("node_id")


@query("SELECT node_id, n_name AS nation FROM n JOIN nation ON n_nationkey = county")
def graph_join(n, e, p, spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_name").alias("nation"))
    return G.join_table(n, nation, "county", "n_nationkey").select("node_id", "nation")


def _squares(n: DataFrame) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("col") + dx).cast("double").alias("x"), (F.col("row") + dy).cast("double").alias("y"))
    return n.select("node_id", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


@query("SELECT src, dst, CAST(1 AS DOUBLE) AS shared_perim FROM e")
def rook_edges(n, *_):
    return G.adjacency(_squares(n))


@query("SELECT src, dst, CAST(1 AS DOUBLE) AS shared_perim FROM e UNION ALL SELECT a.node_id, b.node_id, 0 FROM n a JOIN n b ON b.row = a.row + 1 AND abs(b.col - a.col) = 1")
def queen_edges(n, *_):
    return G.adjacency(_squares(n), queen=True)


@query("SELECT node_id, CAST(4 AS DOUBLE) AS perimeter, CAST(bp AS DOUBLE) AS boundary_perim FROM n")
def boundary_perims(n, *_):
    s = _squares(n)
    return G.boundary_perimeters(s, G.adjacency(s)).drop("boundary_node")


@query("SELECT plan_id, count(*) FILTER (share >= 0.5) AS n_districts FROM v GROUP BY 1")
def opportunity_districts(n, e, p, *_):
    d = S.two_party(S.election(n, p, PARTIES))
    return d.groupBy("plan_id").agg(C.opportunity(F.col("share"), 0.5)["n_districts"].alias("n_districts"))


@query("SELECT x AS step, CAST(CASE WHEN x % 30 < 10 THEN 0 ELSE 1 END AS DOUBLE) AS jump, round(CASE WHEN x % 50 < 10 THEN 0 WHEN x % 50 < 20 THEN (x % 50 - 10) / 10.0 WHEN x % 50 < 40 THEN 1 ELSE 1 - (x % 50 - 40) / 10.0 END, 9)::DOUBLE AS linear FROM (SELECT unnest(range(0, 200)) AS x)")
def beta_schedules(n, e, p, spark, sf):
    s = F.col("id")
    return spark.range(200).select(s.alias("step"), C.jump_cycle(s, 10, 20).alias("jump"), C.linear_cycle(s, 10, 10, 20).alias("linear"))


@query("SELECT x AS step, " + ", ".join(f"round(CAST({q} AS DOUBLE), 9) AS {n}" for n, q in {
    "linear_jump": "CASE WHEN x % 40 < 10 THEN 0 WHEN x % 40 < 20 THEN (x % 40 - 10) / 10.0 ELSE 1 END",
    "logit": "CASE WHEN x % 50 <= 10 THEN 0 WHEN x % 50 < 20 THEN greatest(0, least(1, (ln(((x % 50 - 10) / 10.0) / (1 - (x % 50 - 10) / 10.0)) + 5) / 10)) WHEN x % 50 <= 40 THEN 1 ELSE greatest(0, least(1, (ln((1 - (x % 50 - 40) / 10.0) / ((x % 50 - 40) / 10.0)) + 5) / 10)) END",
    "logit_jump": "CASE WHEN x % 40 <= 10 THEN 0 WHEN x % 40 < 20 THEN greatest(0, least(1, (ln(((x % 40 - 10) / 10.0) / (1 - (x % 40 - 10) / 10.0)) + 5) / 10)) ELSE 1 END",
}.items()) + " FROM (SELECT unnest(range(0, 200)) AS x)")
def more_schedules(n, e, p, spark, sf):
    s = F.col("id")
    return spark.range(200).select(s.alias("step"), C.linear_cycle(s, 10, 10, 20, down=False).alias("linear_jump"), C.logit_cycle(s, 10, 10, 20).alias("logit"), C.logit_cycle(s, 10, 10, 20, down=False).alias("logit_jump"))


@query("""
SELECT plan_id, round(n + below, 9) AS partial_district, round(CASE WHEN below < 0.4 THEN n ELSE n + 10 * (below - 0.4) END, 9) AS next_highest_close, round(CASE WHEN n = 0 THEN 0 ELSE n + (1 - above) / 0.5 END, 9) AS maximum_over, round(CASE WHEN n = 0 THEN 0 ELSE n + (1 - mean) / 0.5 END, 9) AS average_over
FROM (SELECT plan_id, CAST(count(*) FILTER (share >= 0.5) AS DOUBLE) AS n, max(share) FILTER (share < 0.5) AS below, max(share) FILTER (share >= 0.5) AS above, avg(share) FILTER (share >= 0.5) AS mean FROM v GROUP BY 1)""")
def opportunity_scores(n, e, p, *_):
    o = C.opportunity(F.col("share"), 0.5)
    return S.two_party(S.election(n, p, PARTIES)).groupBy("plan_id").agg(*[o[k].alias(k) for k in ("partial_district", "next_highest_close", "maximum_over", "average_over")])


@query("""
, s AS (SELECT a.plan_id, a.part, x.county, e.src AS a, e.dst AS b FROM e JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst AND a.plan_id = b.plan_id JOIN n x ON x.node_id = src JOIN n y ON y.node_id = dst WHERE a.part = b.part AND x.county = y.county),
u AS (SELECT plan_id, a, b FROM s UNION ALL SELECT plan_id, b, a FROM s), r AS (SELECT plan_id, node_id AS a, node_id AS b FROM p UNION SELECT r.plan_id, r.a, u.b FROM r JOIN u ON u.a = r.b AND u.plan_id = r.plan_id)
SELECT plan_id, count(DISTINCT b) AS num_pieces FROM (SELECT plan_id, a, min(b) AS b FROM r GROUP BY ALL) GROUP BY 1""")
def num_pieces(n, e, p, *_):
    return S.pieces(S.components(n, e, p, within="county"), "county")


STATES = """
, x AS (SELECT 0 AS step, county, count(DISTINCT part) > 1 AS split FROM p5 JOIN n USING (node_id) GROUP BY ALL UNION ALL SELECT 1, county, count(DISTINCT part) > 1 FROM q JOIN n USING (node_id) GROUP BY ALL),
z AS (SELECT step, county, CASE WHEN NOT split THEN 'not_split' WHEN step = 0 OR lag(split) OVER (PARTITION BY county ORDER BY step) THEN 'old_split' ELSE 'new_split' END AS state FROM x)
"""


def _states(n, spark, sf):
    """Two steps of a chain: the bands, and what the flip log makes of them."""
    steps = [S.counties(n, x, "county").withColumn("step", F.lit(i)) for i, x in enumerate((G.bands(n, 5), flipped(spark, sf, n)))]
    return S.county_states(steps[0].unionAll(steps[1]).withColumn("plan_id", F.lit("chain")), "county")


@query(STATES + "SELECT step, county, state FROM z")
def county_states(n, e, p, spark, sf):
    return _states(n, spark, sf).select("step", "county", "state")


@query(STATES + "SELECT step, count(*) FILTER (state = 'new_split') = 0 AS valid FROM z GROUP BY 1")
def refuse_new_splits(n, e, p, spark, sf):
    return S.refuse_new_splits(_states(n, spark, sf)).select("step", "valid")


@query("""
, ap AS (SELECT 0 AS step, node_id, part FROM p5 UNION ALL SELECT 1, node_id, part FROM q),
ar AS (SELECT step, part, count(*) AS area, sum(bp) AS x FROM ap JOIN n USING (node_id) GROUP BY ALL),
ai AS (SELECT step, part, count(*) AS i FROM (SELECT a.step, unnest([a.part, b.part]) AS part FROM e JOIN ap a ON a.node_id = src JOIN ap b ON b.node_id = dst AND a.step = b.step WHERE a.part <> b.part) GROUP BY ALL),
s AS (SELECT step, count(*) / sum(1 / s) AS harmonic, sum(1 / s) AS reciprocal FROM (SELECT step, 4 * pi() * area / ((x + coalesce(i, 0)) * (x + coalesce(i, 0))) AS s FROM ar LEFT JOIN ai USING (step, part)) GROUP BY 1)
SELECT step, round(harmonic, 9) AS harmonic, harmonic >= first_value(harmonic) OVER (ORDER BY step) AS harmonic_valid, reciprocal <= first_value(reciprocal) OVER (ORDER BY step) AS reciprocal_valid FROM s""")
def no_worse_compactness(n, e, p, spark, sf):
    """Two steps of a chain, as in county_states, held against the first."""
    both = G.bands(n, 5).withColumn("plan_id", F.lit("0")).unionAll(flipped(spark, sf, n).withColumn("plan_id", F.lit("1")))
    c = S.norms(S.compact(n, e, both)).select(F.lit("chain").alias("plan_id"), F.col("plan_id").cast("int").alias("step"), "harmonic", "l1_reciprocal")
    c = S.no_worse_than_first(c, "harmonic", lower=True).withColumnRenamed("valid", "harmonic_valid")
    return S.no_worse_than_first(c, "l1_reciprocal", lower=False).withColumnRenamed("valid", "reciprocal_valid").select("step", "harmonic", "harmonic_valid", "reciprocal_valid")


@query("""
, i AS (SELECT *, avg(CAST(population AS DOUBLE)) OVER (PARTITION BY plan_id) AS ideal FROM t),
d AS (SELECT DISTINCT plan_id, unnest([src, dst]) AS node_id, unnest([ps, pd]) AS own, unnest([pd, ps]) AS part FROM c)
SELECT d.plan_id, node_id, d.part FROM d JOIN n USING (node_id) JOIN i a ON a.plan_id = d.plan_id AND a.part = d.own JOIN i b ON b.plan_id = d.plan_id AND b.part = d.part
WHERE a.population - n.population BETWEEN a.ideal * 0.95::DOUBLE AND a.ideal * 1.05::DOUBLE AND b.population + n.population BETWEEN a.ideal * 0.95::DOUBLE AND a.ideal * 1.05::DOUBLE""")
def valid_flips(n, e, p, *_):
    return S.valid_flips(n, e, p, 0.05)


def _chain(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("plan_id"), F.col("event_id").alias("step"), "value")


FIRST = "FROM (SELECT user_id, event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS f, first_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)"


@query(f"SELECT event_id AS step, value <= f AS below, value >= f - 0.05 AS above, coalesce(value BETWEEN g * (1 - 10.0::DOUBLE / 100) AND g * (1 + 10.0::DOUBLE / 100), true) AS within {FIRST}")
def self_set_bounds(n, e, p, spark, sf):
    c = _chain(spark, sf)
    low = S.no_worse_than_first(c, "value", lower=False).withColumnRenamed("valid", "below")
    high = S.no_worse_than_first(low, "value", lower=True, slack=0.05).withColumnRenamed("valid", "above")
    return S.within_percent_of_first(high, "value", 10.0).withColumnRenamed("valid", "within").select("step", "below", "above", "within")


@query("SELECT event_id AS step, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_value FROM events")
def previous_scores(n, e, p, spark, sf):
    return S.previous(_chain(spark, sf), "value").select("step", "value", "previous_value")


@query("SELECT plan_id, count(DISTINCT part) = 6 AS valid FROM (SELECT plan_id, part FROM p WHERE part < 6) GROUP BY 1")
def no_empty_parts(n, e, p, spark, sf):
    parts = p.select("plan_id").distinct().crossJoin(spark.range(6).select(F.col("id").cast("int").alias("part")))
    return S.no_empty_parts(parts, p)


@query("SELECT plan_id, min(population) >= 0.98::DOUBLE * 300 AND max(population) <= 1.02::DOUBLE * 300 AS near, max(population) <= 400 AS at_most, min(population) >= 150 AS at_least FROM t GROUP BY 1")
def population_limits(n, e, p, *_):
    t = S.tally(n, p, population="population")
    near = S.near_ideal(t, 300, 0.02).withColumnRenamed("valid", "near")
    return near.join(S.at_most(t, "population", 400).withColumnRenamed("valid", "at_most"), "plan_id").join(S.at_least(t, "population", 150).withColumnRenamed("valid", "at_least"), "plan_id")


@query("SELECT plan_id, part, CAST(sum(CASE WHEN col % 7 <> 0 THEN population END) AS DOUBLE) AS real FROM p JOIN n USING (node_id) GROUP BY ALL")
def tally_without_nan(n, e, p, *_):
    return S.tally(n.withColumn("x", F.when(F.col("col") % 7 == 0, float("nan")).otherwise(F.col("population").cast("double"))), p, real="x")


@query("SELECT CAST(sum(population) AS BIGINT) AS population FROM n")
def total_population(n, *_):
    return S.total_population(n)


@query("SELECT part, CAST(sum(population) AS BIGINT) AS population FROM q JOIN n USING (node_id) GROUP BY 1")
def updated_tally(n, e, p, spark, sf):
    old = G.bands(n, 5)
    return S.updated_tally(S.tally(n, old, population="population"), n, S.flows(old, flipped(spark, sf, n)), "population").drop("plan_id")


@query("SELECT src, dst, unnest([ps, pd]) AS part FROM cq")
def updated_cuts(n, e, p, spark, sf):
    old, new = G.bands(n, 5), flipped(spark, sf, n)
    return S.updated_cuts(S.by_part(S.cut_edges(e, old)), S.edge_flows(e, old, new)).drop("plan_id")


MOVED = ", d AS (SELECT node_id, a.part AS was, b.part AS now FROM p5 a JOIN q b USING (node_id) WHERE a.part <> b.part)\n"


@query(MOVED + "SELECT DISTINCT src, dst FROM e JOIN d ON node_id IN (src, dst)")
def neighbour_flips(n, e, p, spark, sf):
    return S.neighbour_flips(e, S.flows(G.bands(n, 5), flipped(spark, sf, n))).drop("plan_id")


@query(MOVED + "SELECT was AS part FROM d UNION SELECT now FROM d")
def affected_parts(n, e, p, spark, sf):
    return S.affected(S.flows(G.bands(n, 5), flipped(spark, sf, n))).drop("plan_id")


@query(REACH + MOVED + "SELECT part, count(DISTINCT component) = 1 AS contiguous FROM w JOIN q USING (node_id) WHERE part IN (SELECT was FROM d) GROUP BY 1")
def flip_contiguous(n, e, p, spark, sf):
    new = flipped(spark, sf, n)
    return S.flip_contiguous(n, e, new, S.flows(G.bands(n, 5), new)).drop("plan_id")


@query("""
, s AS (SELECT src AS a, dst AS b FROM e WHERE src IN (SELECT node_id FROM n WHERE col % 10 <> 4 OR row % 8 = 1) AND dst IN (SELECT node_id FROM n WHERE col % 10 <> 4 OR row % 8 = 1)), u AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), r AS (SELECT 0::BIGINT AS a UNION SELECT u.b FROM r JOIN u ON u.a = r.a)
SELECT a AS node_id FROM r""")
def reachable(n, e, *_):
    return S.reachable(n, e, (F.col("col") % 10 == 4) & (F.col("row") % 8 != 1), 0)


@query("SELECT a.plan_id, a.part, src, dst FROM e JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst AND a.plan_id = b.plan_id WHERE a.part = b.part")
def subgraphs(n, e, p, *_):
    return S.subgraphs(e, p)


@query("SELECT plan_id, part, node_id FROM p JOIN n USING (node_id) WHERE bp > 0")
def boundary_sets(n, e, p, *_):
    return S.boundary_sets(n, p)


@query("SELECT plan_id, part, count(*) AS n_nodes, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS nodes FROM p GROUP BY ALL")
def level_sets(n, e, p, *_):
    return S.level_sets(p).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query("SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY share, part) AS INTEGER) AS rank, round(share, 9) AS share FROM v")
def sorted_shares(n, e, p, *_):
    return S.sorted_shares(S.election(n, p, PARTIES), "d")


@query("SELECT plan_id, part, muni FROM (SELECT plan_id, part, muni, row_number() OVER (PARTITION BY plan_id, part ORDER BY count(*) DESC, muni) AS r FROM p JOIN n USING (node_id) GROUP BY plan_id, part, muni) WHERE r = 1")
def most_common_muni(n, e, p, *_):
    return S.most_common(n, p, "muni")


@query("SELECT plan_id, src, dst, weight FROM (SELECT plan_id, src, dst, (src * 7 + dst * 13) % 101 AS weight, row_number() OVER (PARTITION BY plan_id ORDER BY (src * 7 + dst * 13) % 101 DESC, src, dst) AS r FROM c) WHERE r = 1")
def heaviest_cut(n, e, p, *_):
    return S.heaviest_cut(e, p, (F.col("src") * 7 + F.col("dst") * 13) % 101)


@query("SELECT plan_id, part, round(CAST(votes_d AS DOUBLE) / population, 9) AS share FROM t")
def group_share(n, e, p, *_):
    return S.group_share(n, p, "votes_d", "population")


ZONE = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 END"


@query(f"SELECT node_id, CAST({ZONE} AS INTEGER) AS zone FROM (SELECT node_id, CAST(node_id * 37 % 361 - 180 AS DOUBLE) AS lon, CAST(node_id * 11 % 161 - 80 AS DOUBLE) AS lat FROM n)")
def utm_zones(n, *_):
    lon, lat = (F.col("node_id") * 37 % 361 - 180).cast("double"), (F.col("node_id") * 11 % 161 - 80).cast("double")
    return n.select("node_id", G.utm_zone(lon, lat).alias("zone"))


REGIONS = {"county": 0.5, "muni": 0.2}


@query("""
SELECT plan_id, src, dst, crossed, weight FROM (SELECT plan_id, src, dst, x + y AS crossed, weight, row_number() OVER (PARTITION BY plan_id ORDER BY x + y DESC, 0.5 * x + 0.2 * y DESC, weight DESC, src, dst) AS r FROM (
 SELECT plan_id, src, dst, CAST(a.county IS DISTINCT FROM b.county AS INTEGER) AS x, CAST(a.muni IS DISTINCT FROM b.muni AS INTEGER) AS y, (src * 7 + dst * 13) % 101 AS weight FROM c JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst)) WHERE r = 1""")
def preferred_cut(n, e, p, *_):
    return S.preferred_cut(n, e, p, REGIONS, (F.col("src") * 7 + F.col("dst") * 13) % 101)


@query("""
, y AS (SELECT plan_id, part, part || ':' || chr(10) || '  d: ' || round(CAST(votes_d AS DOUBLE) / (votes_d + votes_r), 4) || chr(10) || '  r: ' || round(CAST(votes_r AS DOUBLE) / (votes_d + votes_r), 4) AS t FROM t)
SELECT plan_id, 'Election Results for election' || chr(10) || string_agg(t, chr(10) ORDER BY part) AS report FROM y GROUP BY 1""")
def election_report(n, e, p, *_):
    return S.election_report(S.election(n, p, PARTIES))


@query("SELECT plan_id, string_agg(node_id || '=' || part, ',' ORDER BY node_id) AS parts FROM p GROUP BY 1")
def plan_map(n, e, p, *_):
    pair = F.transform(F.array_sort(F.map_entries("parts")), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string")))
    return S.plan_map(p).select("plan_id", F.array_join(pair, ",").alias("parts"))


@query("SELECT part, count(*) AS n_nodes FROM q GROUP BY 1")
def node_counts_on_flow(n, e, p, spark, sf):
    old = G.bands(n, 5)
    before = old.groupBy("plan_id", "part").agg(F.count("*").alias("n_nodes"))
    count = lambda x, came, went: F.coalesce(x, F.lit(0)) + F.size(came) - F.size(went)
    return S.on_flow(before, S.flows(old, flipped(spark, sf, n)), F.col("node_id"), "n_nodes", count).drop("plan_id")


@query("SELECT part, CAST(sum(src * 3 + dst) AS BIGINT) AS weight FROM (SELECT src, dst, unnest([ps, pd]) AS part FROM cq) GROUP BY 1")
def cut_weight_on_edge_flow(n, e, p, spark, sf):
    old = G.bands(n, 5)
    item = F.col("src") * 3 + F.col("dst")
    before = S.by_part(S.cut_edges(e, old)).groupBy("plan_id", "part").agg(F.sum(item).alias("weight"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, v: s + v)
    return S.on_flow(before, S.edge_flows(e, old, flipped(spark, sf, n)), item, "weight", lambda x, came, went: F.coalesce(x, F.lit(0)) + add(came) - add(went)).drop("plan_id")


@query("""
, fl AS (SELECT f.* FROM f JOIN p5 USING (node_id)), lg AS (SELECT -1 AS step, node_id, part FROM p5 UNION ALL SELECT * FROM fl),
sp AS (SELECT node_id, part, greatest(step, 0) AS a, coalesce(lead(step) OVER (PARTITION BY node_id ORDER BY step) - 1, (SELECT max(step) FROM fl)) AS b FROM lg),
cs AS (SELECT greatest(x.a, y.a) AS a, least(x.b, y.b) AS b FROM e JOIN sp x ON x.node_id = src JOIN sp y ON y.node_id = dst WHERE x.part <> y.part AND x.a <= y.b AND y.a <= x.b AND x.a <= x.b AND y.a <= y.b),
ce AS (SELECT step, count(*) AS cut_edges FROM fl JOIN cs ON step BETWEEN a AND b GROUP BY 1),
pe AS (SELECT fl.step, z.part, sum(population) AS population FROM fl JOIN (SELECT sp.part, a, b, population FROM sp JOIN n USING (node_id)) z ON fl.step BETWEEN a AND b GROUP BY 1, 2)
SELECT step, any_value(cut_edges) AS cut_edges, CAST(max(population) - min(population) AS BIGINT) AS spread FROM ce JOIN pe USING (step) GROUP BY 1""")
def flip_scores(n, e, p, spark, sf):
    """The events as one chain from the five bands, scored at each step from changes."""
    from .plans import ensemble

    start = G.bands(n, 5)
    flips = G.flip_log(spark, sf).join(start, "node_id", "left_semi").withColumn("chain", F.lit(0).cast("long"))
    steps, spanned = flips.select("chain", "step"), ensemble.spans(flips, start)
    pop = ensemble.tallies(n, spanned, steps).groupBy("chain", "step").agg((F.max("population") - F.min("population")).alias("spread"))
    return ensemble.cut_counts(e, spanned, steps).join(pop, ["chain", "step"]).drop("chain")


def _wide(n: DataFrame) -> DataFrame:
    """Squares of customers, each third one a quarter wider than its place."""
    w = F.when(F.col("node_id") % 3 == 0, 1.25).otherwise(1.0)
    at = lambda dx, dy: F.struct((F.col("col") + dx * w).alias("x"), (F.col("row") + dy * w).alias("y"))
    return n.select("node_id", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


WIDE = ", w AS (SELECT node_id, col AS x1, row AS y1, col + CASE WHEN node_id % 3 = 0 THEN 1.25::DOUBLE ELSE 1 END AS x2, row + CASE WHEN node_id % 3 = 0 THEN 1.25::DOUBLE ELSE 1 END AS y2 FROM n)\n"


@query(WIDE + "SELECT a.node_id AS src, b.node_id AS dst, round((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)), 9) AS area FROM w a JOIN w b ON a.node_id < b.node_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
def overlapping_polygons(n, *_):
    return P.overlaps(_wide(n))


@query(WIDE + "SELECT a.node_id AS src, b.node_id AS dst FROM w a JOIN w b ON a.node_id < b.node_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
def meeting_boxes(n, *_):
    b = P.boxes(_wide(n)).drop("ring")
    return P.range_join(b, b).filter("l_node_id < r_node_id").select(F.col("l_node_id").alias("src"), F.col("r_node_id").alias("dst"))


@query("SELECT node_id, CASE WHEN node_id % 7 = 0 THEN 'Self-intersection' ELSE 'Too few points in geometry component' END AS reason FROM n WHERE node_id % 7 = 0 OR node_id % 11 = 0")
def invalid_polygons(n, *_):
    """Of squares, each seventh one with two corners changed about, each eleventh one with two only."""
    r, i = F.col("ring"), F.col("node_id")
    ring = F.when(i % 7 == 0, F.array(r[0], r[2], r[1], r[3])).when(i % 11 == 0, F.slice(r, 1, 2)).otherwise(r)
    return P.invalid(_squares(n).withColumn("ring", ring))


@query("SELECT node_id, CAST(CASE WHEN node_id % 3 = 0 THEN 1.5625 ELSE 1 END AS DOUBLE) AS area FROM n")
def polygon_areas(n, *_):
    return _wide(n).select("node_id", F.round(G.polygon_area(F.col("ring")), 6).alias("area"))


@query("""SELECT node_id, '{"type":"Polygon","coordinates":[[[' || col::DOUBLE || ',' || row::DOUBLE || '],[' || (col + 1)::DOUBLE || ',' || row::DOUBLE || '],[' || (col + 1)::DOUBLE || ',' || (row + 1)::DOUBLE || '],[' || col::DOUBLE || ',' || (row + 1)::DOUBLE || '],[' || col::DOUBLE || ',' || row::DOUBLE || ']]]}' AS geojson FROM n""")
def geojson(n, *_):
    return _squares(n).select("node_id", P.to_geojson(F.col("ring")).alias("geojson"))


@query(f"""
, z AS (SELECT node_id, lon, lat, CAST({ZONE} AS INTEGER) AS zone FROM (SELECT node_id, CAST(node_id * 37 % 361 - 180 AS DOUBLE) AS lon, CAST(node_id * 11 % 161 - 80 AS DOUBLE) AS lat FROM n)),
kk AS (SELECT (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n),
a AS (SELECT z.*, n, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS lam FROM z, kk),
b AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3 FROM a)
SELECT node_id, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
 round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM b""")
def utm_coordinates(n, *_):
    lon, lat = (F.col("node_id") * 37 % 361 - 180).cast("double"), (F.col("node_id") * 11 % 161 - 80).cast("double")
    x, y = P.to_utm(lon, lat, G.utm_zone(lon, lat))
    return n.select("node_id", F.round(x, 3).alias("easting"), F.round(y, 3).alias("northing"))


@query()
def chain_scores(n, e, p, spark, sf):
    """Four recombination chains from the five bands of all customers, scored as an ensemble."""
    from .plans import ensemble

    start = G.bands(n, 5)
    return ensemble.score_chains(n, e, start, n_chains=4, steps=40, proposal="recom", epsilon=0.2)


@query()
def short_bursts_best(n, e, p, spark, sf):
    from .plans import ensemble

    return ensemble.optimize(n, e, G.bands(n, 5), mode="short_bursts", n_chains=4, steps=60, epsilon=0.2)


@query()
def diversity_stats(n, e, p, spark, sf):
    from .plans import ensemble

    start = G.bands(n, 5)
    flips = ensemble.run_chains(n, e, start, n_chains=2, steps=20, proposal="flip", epsilon=0.5)
    return ensemble.diversity(e, flips.persist(), start)
