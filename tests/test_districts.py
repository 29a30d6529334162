"""Hand-checked values, differential checks of kernels, and parity of all queries with SQL."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardweave import queries as Q
from wardweave.functions import columns as C
from wardweave.operators import scores as S
from wardweave.plans import ensemble
from wardweave.plans import kernels as K
from wardweave.sources import geometry as P
from wardweave.sources import graphs as G

SF = "/root/testdata/sf0.001"


def grid(spark, n=3):
    return G.lattice(spark, n, n)


def plan(spark, parts):
    return spark.createDataFrame([("p", i, p) for i, p in enumerate(parts)], "plan_id string, node_id long, part int")


def test_partisan_golden(spark):
    rows = [("p", "e", i, o, q, v) for i, (b, a) in enumerate(zip([5, 60, 25, 55, 55], [95, 40, 75, 45, 45])) for o, (q, v) in enumerate((("B", b), ("A", a)))]
    d = spark.createDataFrame(rows, "plan_id string, election string, part int, party_ord int, party string, votes long")
    d = d.withColumn("total", F.lit(100)).withColumn("share", F.col("votes") / 100.0)
    r = S.partisan(d).first()
    assert [round(r[k], 9) for k in ("efficiency_gap", "mean_median", "partisan_bias", "partisan_gini")] == [0.3, 0.15, 0.1, 0.12]


def test_localities_golden(spark):
    nodes, edges = grid(spark)
    nodes = nodes.withColumn("county", F.element_at(F.array(*map(F.lit, "abc")), F.col("i") + 1))
    rows = S.localities(nodes, edges, plan(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2]), "county").first()
    assert (rows["num_parts"], rows["naked_boundary"], rows["num_split_localities"]) == (3, 0, 0)
    assert abs(rows["shannon_entropy"]) < 1e-12 and abs(rows["power_entropy"]) < 1e-12 and rows["symmetric_entropy"] == 18
    rows = S.localities(nodes, edges, plan(spark, [0, 1, 2] * 3), "county").first()
    assert (rows["num_parts"], rows["naked_boundary"], rows["num_split_localities"]) == (9, 6, 3)
    assert rows["shannon_entropy"] == pytest.approx(np.log(3)) and rows["power_entropy"] == pytest.approx(9 * (3**0.05 - 1)) and rows["symmetric_entropy"] == pytest.approx(54 / 3**0.5)


def test_perimeters_of_quadrants(spark):
    nodes, edges = grid(spark, 4)
    q = [int(i >= 2) + 2 * int(j >= 2) for i in range(4) for j in range(4)]
    q[2 * 4 + 1] = 3
    p = sorted(r["perimeter"] for r in S.perimeters(nodes, edges, plan(spark, q)).collect())
    assert p == [8, 8, 8, 10]


def test_metagraph_and_contiguity(spark):
    nodes, edges = grid(spark)
    p = plan(spark, [1] * 6 + [2] * 3)
    assert {(r["node_id"], r["part"]) for r in S.metagraph_flips(edges, p).collect()} == {(6, 1), (7, 1), (8, 1), (3, 2), (4, 2), (5, 2)}
    c = S.contiguity(S.components(nodes, edges, plan(spark, [1, 2, 1, 2, 2, 2, 1, 2, 1]))).first()
    assert (c["contiguous_parts"], c["contiguous"]) == (1, False)
    assert S.neighbours(edges, p).select("plan_id").distinct().count() == 6


def test_valid_flips_and_previous(spark):
    nodes, edges = grid(spark)
    p = plan(spark, [1] * 6 + [2] * 3)
    ones = nodes.withColumn("population", F.lit(1).cast("long"))
    assert sorted(map(tuple, S.valid_flips(ones, edges, p, 0.15).collect())) == [("p", 3, 2), ("p", 4, 2), ("p", 5, 2)]
    gap = ones.withColumn("population", F.when(F.col("node_id") != 4, F.col("population")))
    assert sorted(map(tuple, S.valid_flips(gap, edges, p, 0.15).collect())) == [("p", 3, 2), ("p", 5, 2)]
    assert S.valid_flips(ones, edges, p.limit(0), 0.15).count() == 0
    chain = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 5.0), ("a", 2, None), ("a", 1, 2.0)], "plan_id string, step int, v double")
    assert sorted(map(str, S.previous(chain, "v").select("plan_id", "step", "previous_v").collect())) == sorted(map(str, spark.createDataFrame([("a", 0, None), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, None)], "plan_id string, step int, previous_v double").collect()))


def test_spanning_trees_cuts_and_primes(spark):
    nodes, edges = grid(spark)
    net, _ = ensemble.net_of(nodes, edges, plan(spark, [0] * 9))
    assert round(np.exp(K.spanning_trees_log(net, set(range(9))))) == 192
    tree = {v: [] for v in range(9)}
    for a, b in ((0, 1), (1, 2), (1, 4), (3, 4), (4, 5), (3, 6), (6, 7), (6, 8)):
        tree[a].append(b)
        tree[b].append(a)
    assert {tuple(sorted(c[:2])) for c in K.balanced_cuts(tree, np.ones(9), 4.5, 0.5, 4)} == {(1, 4), (3, 4), (3, 6)}
    path = {i: [j for j in (i - 1, i + 1) if 0 <= j < 5] for i in range(5)}
    assert not K.balanced_cuts(path, np.array([4, 4, 3, 3, 3]), 10, 0.1, 0)
    assert [K.largest_prime_factor(2024, c) for c in (20, 1, 2000, -1)] == [11, None, 23, None]


@pytest.mark.parametrize("proposal", sorted(K.PROPOSALS))
def test_proposals_keep_plans_valid(spark, proposal):
    nodes, edges = grid(spark, 6)
    net, first = ensemble.net_of(nodes, edges, G.quadrants(nodes, 6, 6))
    now = first.copy()
    limits = K.Limits(0.5, parts=4)
    for _ in K.chain(net, now, np.random.default_rng(1), K.PROPOSALS[proposal], limits, K.fewer_cuts, 15, epsilon=0.3):
        assert limits.ok(net, now)


def test_chain_log_equals_scores(spark):
    nodes, edges = grid(spark, 6)
    start = G.quadrants(nodes, 6, 6)
    flips = ensemble.run_chains(nodes, edges, start, 2, 12, "recom", epsilon=0.3)
    rows = ensemble.scored(nodes, edges, flips, start).collect()
    assert len(rows) == 24 and all(r["contiguous"] for r in rows)
    assert sorted(map(tuple, flips.fillna(-1).collect())) == sorted(map(tuple, ensemble.run_chains(nodes, edges, start, 2, 12, "recom", epsilon=0.3).fillna(-1).collect()))


@pytest.mark.parametrize("mode", ["short_bursts", "tilted_bursts", "variable_bursts", "tilted", "annealing"])
def test_optimisers_improve(spark, mode):
    nodes, edges = grid(spark, 4)
    start = spark.createDataFrame([(i, p) for i, p in enumerate([0, 1, 1, 1, 0, 0, 0, 1, 2, 2, 3, 3, 2, 2, 3, 3])], "node_id long, part int")
    rows = ensemble.optimize(nodes, edges, start, mode, 1, 60, epsilon=0.01).collect()
    assert len(rows) == 60 and min(r["best"] for r in rows) == 8


def test_seed_plans_are_balanced(spark):
    nodes, edges = grid(spark, 12)
    net, _ = ensemble.net_of(nodes, edges, nodes.select("node_id", F.lit(0).alias("part")))
    for make in (lambda r: K.tree_plan(net, list(range(6)), 0.1, r), lambda r: K.seed_plan(net, 6, 0.2, r)):
        p = make(np.random.default_rng(3))
        assert (abs(np.bincount(p, net.population) - 24) <= 24 * 0.2).all() and K.Limits(0.2, parts=6).ok(net, p)


def test_sources_round_trip(spark, tmp_path):
    nodes, edges = grid(spark)
    G.write_adjacency(nodes, edges, f"{tmp_path}/g")
    n, e = G.read_adjacency(spark, f"{tmp_path}/g")
    assert n.count() == 9 and {tuple(r) for r in e.select("src", "dst").collect()} == {tuple(r) for r in edges.select("src", "dst").collect()}
    (tmp_path / "p.json").write_text('{"idColumn": {"key": "node_id", "name": "x"}, "assignment": {%s}}' % ", ".join(f'"{i}": {i // 3}' for i in range(9)))
    assert {r["node_id"]: r["part"] for r in G.read_plan(spark, f"{tmp_path}/p.json", nodes).collect()} == {i: i // 3 for i in range(9)}
    with pytest.raises(G.GraphError):
        G.read_plan(spark, f"{tmp_path}/p.json", nodes, "nothing")


def test_squares(spark):
    ring = lambda x, y: [(float(x), float(y)), (x + 1.0, float(y)), (x + 1.0, y + 1.0), (float(x), y + 1.0)]
    p = spark.createDataFrame([(i, ring(i % 2, i // 2)) for i in range(4)], "node_id long, ring array<struct<x:double,y:double>>")
    assert G.adjacency(p).count() == 4 and G.adjacency(p, True).count() == 6
    assert p.select(G.polygon_area(F.col("ring"))).distinct().first()[0] == 1


def test_opportunity_golden(spark):
    d = spark.createDataFrame([(x,) for x in (0.2, 0.2, 0.52, 0.52)], "s double")
    r = d.agg(*[v.alias(k) for k, v in C.opportunity(F.col("s"), 0.5).items()]).first()
    assert r["n_districts"] == 2 and r["partial_district"] == pytest.approx(2.2) and r["next_highest_close"] == 2 and r["maximum_over"] == pytest.approx(2.96) and r["average_over"] == pytest.approx(2.96)


def test_county_states(spark):
    d = spark.createDataFrame([("p", s, "a", x) for s, x in enumerate([True, False, True, True])], "plan_id string, step int, county string, split boolean")
    assert [r["state"] for r in S.county_states(d, "county").orderBy("step").collect()] == ["old_split", "not_split", "new_split", "new_split"]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer orders events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({Q.ORACLES[name]})").fetchall())


def test_chain_queries_walk_the_customers(spark):
    keys = [r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()]
    people = Counter(r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect())
    rows = max(keys) // 30 + 1
    part = {k: 5 * (k // 30) // rows for k in keys}
    edges = [(k, k + d) for k in keys for d in (1, 30) if k + d in part and (d == 30 or k % 30 < 29)]
    cuts = sum(part[a] != part[b] for a, b in edges)
    sums = Counter()
    for k in keys:
        sums[part[k]] += people[k]
    scored = Q.QUERIES["chain_scores"](spark, SF).collect()
    assert len(scored) == 4 * 40 and all(r["contiguous"] for r in scored)
    assert {(r["cut_edges"], r["spread"]) for r in scored if r["step"] == 0} == {(cuts, max(sums.values()) - min(sums.values()))}
    bursts = Q.QUERIES["short_bursts_best"](spark, SF).collect()
    assert {r["score"] for r in bursts if r["step"] == 0} == {cuts} and len({r["chain"] for r in bursts}) == 4
    stats = {(r["chain"], r["step"]): r for r in Q.QUERIES["diversity_stats"](spark, SF).collect()}
    assert len(stats) == 2 * 20 and all(stats[c, 0]["unique_districts"] == 5 for c in ("0", "1"))


def test_spanning_trees_of_parts(spark):
    nodes, edges = grid(spark)
    one = {r["part"]: r["log_trees"] for r in S.spanning_trees_log(nodes, edges, plan(spark, [0] * 9)).collect()}
    assert one[0] == pytest.approx(np.log(192))
    two = {r["part"]: r["log_trees"] for r in S.spanning_trees_log(nodes, edges, plan(spark, [0, 0, 1, 0, 0, 2, 1, 1, 2])).collect()}
    assert two[0] == pytest.approx(np.log(4)) and two[2] == pytest.approx(0) and two[1] == -np.inf


def _grid_net(n, seed=None):
    ids = np.arange(n * n)
    a = np.array([i for i in ids if i % n < n - 1] + [i for i in ids if i < n * (n - 1)])
    b = np.r_[[i + 1 for i in ids if i % n < n - 1], [i + n for i in ids if i < n * (n - 1)]]
    people = np.ones(n * n, np.int64) if seed is None else np.random.default_rng(seed).integers(1, 5, n * n)
    return K.Net(ids, people, a, b)


def test_tree_plans_keep_their_tolerance():
    for seed in range(60):
        net = _grid_net(12, seed)
        for k, epsilon in ((6, 0.05), (8, 0.1)):
            for made in (K.tree_plan(net, list(range(k)), epsilon, np.random.default_rng(seed)), K.seed_plan(net, k, epsilon, np.random.default_rng(seed))):
                pop = np.bincount(made, net.population, k)
                assert (np.abs(pop * k / net.population.sum() - 1) <= epsilon + 1e-12).all()
                assert all(K.connected(net, set(np.flatnonzero(made == p).tolist())) for p in range(k))


def test_a_tie_resets_the_stuck_count():
    net = _grid_net(6)
    first = np.repeat([0, 1], 18)
    lengths, rows = [], list(K.bursts(net, first, np.random.default_rng(0), K.PROPOSALS["flip"], K.Limits(0.9), lambda net, plan: 1.0, False, "variable_bursts", 60, buffer=1))
    assert [r[0] for r in rows] == list(range(60))
    # every step ties, so bursts stay two long: each second step starts from the best, without a flip of its own
    lengths = [len(r[3]) for r in rows]
    assert max(lengths) <= 2


def test_chains_take_functions_and_say_why_they_end(spark):
    nodes, edges = grid(spark, 4)
    start = plan(spark, [0] * 8 + [1] * 8)

    def keep_first(net, plan):
        return plan[0] == 0

    rows = ensemble.run_chains(nodes, edges, start, 2, 30, proposal=K.PROPOSALS["flip"], accept=K.always, epsilon=0.5, constraints=(keep_first,)).collect()
    assert {r["chain"] for r in rows} == {0, 1} and not any(r["node_id"] == 0 for r in rows) and all(r["status"] is None for r in rows)

    def stuck(net, plan, rng, **_):
        raise K.TooManyCuts("31")

    rows = ensemble.run_chains(nodes, edges, start, 2, 30, proposal=stuck).collect()
    assert sorted((r["chain"], r["step"], r["status"]) for r in rows if r["status"]) == [(0, None, "TooManyCuts: 31"), (1, None, "TooManyCuts: 31")]
    scored = ensemble.scored(nodes, edges, ensemble.run_chains(nodes, edges, start, 2, 30, proposal=stuck), start).collect()
    assert [(r["step"], r["cut_edges"]) for r in scored] == [(0, 4)] * 2


def test_a_long_straight_border(spark):
    """Sides on one line: a strip of cells against one long side."""
    rows = [(i, [(float(i), 0.0), (i + 1.0, 0.0), (i + 1.0, 1.0), (float(i), 1.0)]) for i in range(40)] + [(99, [(0.0, 1.0), (40.0, 1.0), (40.0, 2.0), (0.0, 2.0)])]
    d = spark.createDataFrame(rows, "node_id long, ring array<struct<x:double,y:double>>")
    got = {(r["src"], r["dst"]): r["shared_perim"] for r in G.adjacency(d).collect()}
    assert got == {(i, i + 1): 1.0 for i in range(39)} | {(i, 99): 1.0 for i in range(40)}


def test_incremental_scores_equal_whole_ones(spark):
    nodes, edges = grid(spark, 4)
    start = plan(spark, [0] * 8 + [1] * 4 + [2] * 4)
    # the last flips empty part 2
    log = [(0, 1, 5, 1), (0, 2, 5, 0), (0, 2, 15, 1), (0, 3, None, None), (0, 4, 0, 2), (0, 5, 0, 0), *[(0, 6, i, 1) for i in (12, 13, 14)], (1, 0, None, None), (1, 1, 7, 1), (1, 1, 12, 1)]
    flips = spark.createDataFrame([(c, s, v, p) for c, s, v, p in log], "chain long, step long, node_id long, part int")
    a, b = (np.array([r[k] for r in edges.select("src", "dst").collect()]) for k in ("src", "dst"))
    net = K.Net(np.arange(16), np.ones(16, np.int64), a, b)
    want = {}
    for c in (0, 1):
        now = np.array([0] * 8 + [1] * 4 + [2] * 4)
        for step in sorted({s for k, s, *_ in log if k == c}):
            for k, s, v, p in log:
                if (k, s) == (c, step) and v is not None:
                    now[v] = p
            pop = np.bincount(now, minlength=3)
            want[c, step] = (len(K.cuts_of(net, now)), int(pop.max() - pop.min()), all(K.connected(net, set(np.flatnonzero(now == p).tolist())) for p in np.unique(now)))
    got = {(r["chain"], r["step"]): (r["cut_edges"], r["spread"], r["contiguous"]) for r in ensemble.scored(nodes, edges, flips, start).collect()}
    assert got == want


def test_record_and_replay(spark, tmp_path):
    nodes, edges = grid(spark, 4)
    start = plan(spark, [0] * 8 + [1] * 8)
    flips = ensemble.run_chains(nodes, edges, start, 2, 12, proposal="flip", epsilon=0.5).cache()
    ensemble.record(flips, f"{tmp_path}/log")
    whole = {tuple(r) for r in ensemble.plans_of(flips, start).collect()}
    assert {tuple(r) for r in ensemble.replay(spark, f"{tmp_path}/log", start).collect()} == whole
    assert {tuple(r) for r in ensemble.replay(spark, f"{tmp_path}/log", start, 7).collect()} == {r for r in whole if r[1] == 7}
    scores = ensemble.scored(nodes, edges, flips, start)
    ensemble.write_scores(scores, f"{tmp_path}/scores")
    assert spark.read.json(f"{tmp_path}/scores").count() == scores.count() == 24


def test_opportunity_runs(spark):
    nodes, edges = grid(spark, 4)
    nodes = nodes.withColumn("group", (F.col("node_id") % 2).cast("long")).withColumn("share", F.col("group") * 0.6)
    start = plan(spark, [0] * 8 + [1] * 8)
    rows = ensemble.opportunity_run(nodes, edges, start, "group", threshold=0.6, kind="partial_district", n_chains=1, steps=30, proposal="flip", epsilon=0.5).collect()
    assert rows[0]["score"] == 0.5 and max(r["score"] for r in rows) == max(r["best"] for r in rows) > 0.5
    shares = ensemble.opportunity_run(nodes, edges, start, share="share", threshold=0.3, n_chains=1, steps=3, proposal="flip", epsilon=0.5).first()
    assert shares["score"] == 2
    with pytest.raises(ValueError):
        ensemble.opportunity_run(nodes, edges, start)
    net = _grid_net(2)
    net.region["g"] = np.array([1, 1, 0, 1])
    two = np.array([0, 0, 1, 1])
    assert [K.opportunity("g", "population", 0.6, k)(net, two) for k in K.OPPORTUNITY] == pytest.approx([1, 1.5, 1, 1, 1])
    assert K.opportunity("g", "population", 0.55, "next_highest_close")(net, two) == pytest.approx(1.5)


def test_cuts_by_contraction_are_the_same():
    for seed in range(30):
        net, rng = _grid_net(6, seed), np.random.default_rng(seed)
        nodes = list(range(36))
        tree = K.random_tree(nodes, K.induced(net, set(nodes)), rng)
        ideal, root = net.population.sum() / 2, int(rng.integers(36))
        one, two = (f(tree, net.population, ideal, 0.2, root) for f in (K.balanced_cuts, K.contracted_cuts))
        assert {c[:2]: frozenset(c[2]) for c in one} == {c[:2]: frozenset(c[2]) for c in two}
        for c in K.contracted_cuts(tree, net.population, ideal / 2, 0.2, root, one_sided=True):
            assert abs(net.population[list(c[2])].sum() - ideal / 2) < 0.1 * ideal


def test_ways_to_cut():
    net = _grid_net(6)
    everything, half = set(range(36)), 18
    net.region = {"row": np.array([i // 18 for i in range(36)], object), "odd": np.array([None] * 36, object)}
    surcharge = {"row": 2.0, "odd": 1.0}
    assert K.regions_by_size_and_sum({"a": 1, "b": 3, "c": 2}) == [("a", "b", "c"), ("b", "c"), ("a", "b"), ("a", "c"), ("b",), ("c",), ("a",)]
    for seed in range(20):
        rng = np.random.default_rng(seed)
        cuts, weights = K.all_cuts(net, everything, half, 0.5, rng, surcharge=surcharge)
        best = K.region_cut(net, cuts, rng, weights, surcharge)
        between = [c for c in cuts if net.region["row"][c[0]] != net.region["row"][c[1]]]
        assert best in (between or cuts) and weights[best[:2]] == max(weights[c[:2]] for c in between or cuts)
        assert weights[K.heaviest_cut(net, cuts, rng, weights)[:2]] == max(weights[c[:2]] for c in cuts)
        made = K.two_parts(net, [3, 4], half, 0.2, rng, repeats=3, find=K.contracted_cuts)
        assert abs(int((made == 3).sum()) - half) <= 0.2 * half
        chunks = K.seed_chunks(net, 3, 6, 0.2, rng)
        assert sorted(v for c in chunks for v in c) == list(range(36)) and all(abs(len(c) - 12) <= 2.4 for c in chunks)
        side = K.bipartition_random(net, everything, half, 0.2, rng)
        assert abs(len(side) - half) <= 3.6
    with pytest.raises(ValueError):
        K.two_parts(net, [1], half, 0.2, rng)
    with pytest.raises(ValueError):
        K.seed_chunks(net, 4, 6, 0.2, rng)


RINGS = "node_id long, ring array<struct<x:double,y:double>>"


def test_validity():
    why = lambda *r: P.ring_fault(*np.array(r, float).T)
    assert why((0, 0), (1, 0), (1, 1), (0, 1)) is None and why((0, 0), (1, 0), (1, 1), (0, 0)) is None
    assert why((0, 0), (1, 0), (2, 0), (2, 2)) is None
    assert why((0, 0), (1, 1), (1, 0), (0, 1)) == why((0, 0), (2, 0), (1, 0), (1, 1)) == why((0, 0), (2, 0), (2, 2), (1, 0), (0, 2)) == "Self-intersection"
    assert why((0, 0), (1, 1)) == P.ring_fault(np.array([]), np.array([])) == "Too few points in geometry component"
    assert why((0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1)) == "Ring Self-intersection"
    assert why((0, 0), (1, float("nan")), (1, 1)) == "Invalid Coordinate"
    # against all pairs of sides
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for seed in range(200):
        p = np.random.default_rng(seed).random((6, 2))
        sides = [(p[i], p[(i + 1) % 6]) for i in range(6)]
        meet = any(cross(*sides[i], sides[j][0]) * cross(*sides[i], sides[j][1]) < 0 and cross(*sides[j], sides[i][0]) * cross(*sides[j], sides[i][1]) < 0 for i in range(6) for j in range(i + 2, 6) if (j + 1) % 6 != i)
        assert (P.ring_fault(p[:, 0], p[:, 1]) is not None) == meet


def test_overlaps_and_holes(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rows = [(1, square(0.0, 0.0, 9.0)), (1, square(3.0, 3.0, 3.0)[::-1]), (2, square(3.0, 3.0, 3.0)), (3, square(8.0, 8.0, 2.0)), (4, [(0.0, 9.0), (1.0, 9.0), (0.5, 8.0)]), (5, None), (6, [])]
    d = spark.createDataFrame(rows, RINGS)
    got = {(r["src"], r["dst"]): r["area"] for r in P.overlaps(d).collect()}
    assert got == pytest.approx({(1, 3): 1.0, (1, 4): 0.5})
    assert {r["node_id"] for r in P.invalid(d).collect()} == {5, 6}
    nodes, edges = P.graph_of(d.filter("node_id < 3"))
    assert {r["node_id"]: r["area"] for r in nodes.collect()} == {1: 72.0, 2: 9.0}
    assert [tuple(r) for r in edges.collect()] == [(1, 2, 12.0)]
    with pytest.raises(G.GraphError):
        P.graph_of(d)
    assert P.without_geometries(d).columns == ["node_id"] and P.overlaps(d.limit(0)).count() == 0


def test_projection(spark):
    """A tower whose grid coordinates are published: zone 17, 630084 m east, 4833438 m north."""
    lon, lat = F.lit(-(79 + 23 / 60 + 13.7 / 3600)), F.lit(43 + 38 / 60 + 33.24 / 3600)
    x, y = P.to_utm(lon, lat, F.lit(17))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), G.utm_zone(lon, lat).alias("z")).first()
    assert r["z"] == 17 and abs(r["x"] - 630084) < 1 and abs(r["y"] - 4833438) < 1
    d = spark.createDataFrame([(1, [(-79.0, -43.0), (-78.0, -43.0), (-78.0, -42.0)])], RINGS)
    p = P.reprojected(d).first()["ring"]
    assert all(5e6 < q["y"] < 6e6 for q in p) and p[0]["x"] < p[1]["x"]


def _shapefile(path, shapes, fields, rows):
    import struct

    body = b""
    for i, rings in enumerate(shapes):
        points = [q for r in rings for q in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        rec = struct.pack("<i", 0) if not rings else struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *q) for q in points)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    (path / "map.shp").write_bytes(b"\0" * 100 + body)
    head = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    size = 1 + sum(w for _, w in fields)
    (path / "map.dbf").write_bytes(struct.pack("<4Bihh", 3, 99, 1, 1, len(rows), 32 + len(head), size) + b"\0" * 20 + head + b"".join(b" " + b"".join(v.encode().ljust(w) for v, (_, w) in zip(r, fields, strict=True)) for r in rows))


def test_vector_files(spark, tmp_path):
    import json

    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    far = [(x + 1, y) for x, y in ring]
    _shapefile(tmp_path, [[ring], [far, [(x + 5, y) for x, y in ring]], []], [("NAME", 6), ("POP", 4)], [("one", "12"), ("two", "7"), ("none", "")])
    attributes, polygons = P.read_shapefile(spark, f"{tmp_path}/map")
    assert [tuple(r) for r in attributes.orderBy("node_id").collect()] == [(0, {"NAME": "one", "POP": "12"}), (1, {"NAME": "two", "POP": "7"}), (2, {"NAME": "none", "POP": None})]
    assert sorted((r["node_id"], r["ring"][0]["x"]) for r in polygons.collect()) == [(0, 0.0), (1, 1.0), (1, 5.0)]
    nodes, edges = P.graph_of(polygons, attributes)
    assert {(r["node_id"], r["area"], r["attributes"]["NAME"]) for r in nodes.collect()} == {(0, 1.0, "one"), (1, 2.0, "two")} and edges.count() == 1
    features = [{"type": "Feature", "properties": {"id": i, "name": n}, "geometry": g} for i, n, g in ((7, "a", {"type": "Polygon", "coordinates": [ring]}), (8, "b", {"type": "MultiPolygon", "coordinates": [[far], [ring]]}), (9, "c", None))]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "lines.geojson").write_text("\n".join(map(json.dumps, features)) + "\n")
    for name in ("one", "lines"):
        attributes, polygons = P.read_geojson(spark, f"{tmp_path}/{name}.geojson", "id", "id long, name string")
        assert sorted(map(tuple, attributes.collect())) == [(7, 7, "a"), (8, 8, "b"), (9, 9, "c")]
        assert sorted((r["node_id"], r["ring"][0]["x"], len(r["ring"])) for r in polygons.collect()) == [(7, 0.0, 5), (8, 0.0, 5), (8, 1.0, 5)]
    assert json.loads(polygons.filter("node_id = 7").select(P.to_geojson(F.col("ring"))).first()[0]) == json.loads(json.dumps(features[0]["geometry"]))


def test_chains_are_scored_as_their_flips(spark):
    """F1: each plan is scored where it is made; the scores are those of the flips."""
    nodes, edges = grid(spark, 6)
    start = plan(spark, [0] * 12 + [1] * 12 + [2] * 12)
    options = dict(n_chains=3, steps=12, proposal="recom", epsilon=0.3)
    rows = lambda d: sorted(map(tuple, d.select("chain", "step", "cut_edges", "spread", "contiguous").collect()))
    got = rows(ensemble.score_chains(nodes, edges, start, **options))
    assert len(got) == 36 and got == rows(ensemble.scored(nodes, edges, ensemble.run_chains(nodes, edges, start, **options), start))


def test_a_tree_in_arrays_has_the_same_cuts():
    """cuts of the same draws, in the same order; no side is gathered before it is asked for."""
    for seed in range(20):
        net, everything = _grid_net(9, seed), np.arange(81)
        one, two = np.random.default_rng(seed), np.random.default_rng(seed)
        tree = K.random_tree(everything.tolist(), K.induced(net, set(range(81))), one)
        for ideal, epsilon, one_sided in ((net.population.sum() / 2, 0.4, False), (net.population.sum() / 4, 0.3, True)):
            made = K.Tree(everything, *net.pairs, np.random.default_rng(seed), net)
            a, b = K.balanced_cuts(tree, net.population, ideal, epsilon, 7, one_sided), made.cuts(net.population, ideal, epsilon, 7, one_sided)
            assert a and [(c[:2], c[2]) for c in a] == [(c[:2], c[2]) for c in b]
        cuts, _ = K.all_cuts(net, everything, net.population.sum() / 2, 0.4, two)
        assert all("side" not in vars(c) for c in cuts)
    # whole graphs and pieces, beyond the size that is walked node by node
    big = _grid_net(60)
    half = (np.arange(3600) >= 1800).astype(int)
    half[0] = 1
    assert K.whole(big, half, 0) and not K.whole(big, half, 1) and not K.whole(big, half, 2)


def test_bursts_of_a_long_strip_gather_one_side_a_step(monkeypatch):
    """a strip has thousands of balanced cuts, of which a step takes one."""
    n, gathered = 6000, []
    ids = np.arange(n)
    net = K.Net(ids, np.ones(n, np.int64), ids[:-1], ids[1:])
    side = K.Cut.side.func
    monkeypatch.setattr(K.Cut, "side", property(lambda c: gathered.append(1) or side(c)))
    rows = list(K.bursts(net, ids // (n // 2), np.random.default_rng(0), K.PROPOSALS["recom"], K.Limits(0.2, parts=2), K.n_cuts, False, "short_bursts", 6, epsilon=0.2))
    assert [r[1] for r in rows] == [1.0] * 6 and len(gathered) == 5


def _random_rings(seed, n=400):
    """Rings of small whole numbers and of random ones: closed, repeated, short, without a number."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        k = int(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 80], p=[0.03, 0.03, 0.04, 0.25, 0.25, 0.2, 0.1, 0.09, 0.01]))
        p = rng.integers(0, 4, (k, 2)).astype(float) if rng.random() < 0.6 else rng.random((k, 2))
        p = p[np.argsort(np.arctan2(p[:, 1] - p[:, 1].mean(), p[:, 0] - p[:, 0].mean()))] if k > 2 and rng.random() < 0.5 else p
        p = np.r_[p, p[:1]] if k and rng.random() < 0.3 else p
        if k and rng.random() < 0.05:
            p[int(rng.integers(len(p))), 0] = np.nan
        yield p


def test_rings_are_checked_side_by_side():
    """many rings at once have the faults that each has alone."""
    for seed in range(5):
        rings = list(_random_rings(seed))
        got = P.ring_faults(np.concatenate([r.reshape(-1, 2) for r in rings]), np.r_[0, np.cumsum([len(r) for r in rings])])
        assert got.tolist() == [P.ring_fault(*r.reshape(-1, 2).T) for r in rings] and len(set(got)) == 5
    assert not len(P.ring_faults(np.empty((0, 2)), np.array([0])))


def test_areas_are_shared_side_by_side():
    """many pairs of rings at once share the areas that each pair shares alone."""
    for seed in range(5):
        rings = [r for r in _random_rings(seed) if len(r) > 2 and np.isfinite(r).all()]
        a, b = rings[:-1], rings[1:]
        flat = lambda d: (np.concatenate(d), np.r_[0, np.cumsum([len(r) for r in d])])
        assert P.shared_areas(flat(a), flat(b)) == pytest.approx([P.shared_area(x, y) for x, y in zip(a, b)], abs=1e-9)


def test_sides_are_made_once(spark):
    """F6, F8, F9: both ends of a join of sides, or corners, read one shuffle, and all queries of a
    map's sides deal its rings out first."""
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    d = spark.createDataFrame([(1, square(0.0, 0.0, 1.0)), (2, square(1.0, 0.0, 1.0)), (3, square(0.0, 1.0, 2.0)), (4, square(1.0 + 1e-12, -5.0, 5.0)), (5, square(2.0, 3.0, 1.0) + [(2.0, 3.0)]), (6, [(8.0, 8.0)] * 4), (7, square(9.0, 9.0, 1e-10))], RINGS)
    rook = {(1, 2): 1.0, (1, 3): 1.0, (2, 3): 1.0, (2, 4): 1.0}
    for queen, want in ((False, rook), (True, {**rook, (3, 5): 0.0})):
        e = G.adjacency(d, queen)
        assert {(r["src"], r["dst"]): r["shared_perim"] for r in e.collect()} == pytest.approx(want)
        text = e._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in text and "round(" not in text
    rows = [r for r in G.boundary_perimeters(d, G.adjacency(d)).collect() if r["node_id"] < 4]
    assert {r["node_id"]: r["boundary_perim"] for r in rows} == pytest.approx({1: 2.0, 2: 1.0, 3: 6.0})


def test_rook_sides_are_shuffled_once(spark):
    """the second end of the join of sides reuses the first one's shuffle."""
    nodes, _ = grid(spark, 4)
    at = lambda x, y: F.struct((F.col("j") + x).cast("double").alias("x"), (F.col("i") + y).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = G.adjacency(nodes.select("node_id", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring")))
        assert len(e.collect()) == 24 and "ReusedExchange" in e._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_running_sums_in_blocks(spark, monkeypatch):
    """sums carry over blocks of steps, also over empty ones and to steps that change nothing."""
    monkeypatch.setattr(ensemble, "BLOCK", 7)
    rng = np.random.default_rng(0)
    change = {(c, s): int(rng.integers(-5, 6)) for c in (0, 1) for s in rng.choice(200, 60, replace=False).tolist() if not 40 <= s < 90}
    steps = sorted({(c, int(s)) for c in (0, 1) for s in rng.choice(210, 80, replace=False)})
    got = ensemble._running(spark.createDataFrame(steps + steps[:9], "chain long, step long"), spark.createDataFrame([(*k, v) for k, v in change.items()], "chain long, step long, d long"), "d", "n").collect()
    assert {(r["chain"], r["step"]): r["n"] for r in got} == {(c, s): sum(v for (d, t), v in change.items() if d == c and t <= s) for c, s in steps} and len(got) == len(steps)


def test_a_net_is_small_and_in_one_order(spark):
    """a net holds no lists of neighbours until they are asked for, positions take 32 bits, and a
    chain is the same however the edges were dealt."""
    nodes, edges = grid(spark, 6)
    start = plan(spark, [0] * 18 + [1] * 18)
    nets = [ensemble.net_of(nodes.withColumn("population", F.lit(1).cast("long")), e, start)[0] for e in (edges, edges.orderBy("dst"), edges.repartition(5))]
    assert all((n.a == nets[0].a).all() and (n.b == nets[0].b).all() for n in nets)
    assert nets[0].a.dtype == nets[0].b.dtype == np.int32 and "near" not in vars(nets[0])


def test_a_tree_is_cut_without_a_walk_node_by_node(monkeypatch):
    """sums, order and sides of cuts come from places on a walk around the tree, as of lists."""
    with pytest.raises(AttributeError):  # no lists of neighbours, node by node
        K.Tree(np.arange(4), *_grid_net(2).pairs, np.random.default_rng(0), _grid_net(2)).near
    for seed in range(4):  # rings of random order, and one that is all in step with its places
        rng = np.random.default_rng(seed)
        order = rng.permutation(5000) if seed else np.r_[np.arange(0, 5000, 2), np.arange(1, 5000, 2)]
        after = np.empty(5003, np.int32)
        after[order], after[5000:] = np.roll(order, -1), [5001, 5002, 5000]
        want = np.full(5003, -1)
        want[order] = (np.arange(5000) - int(np.flatnonzero(order == 17)[0])) % 5000
        assert (K.ranks(after, 17) == want).all()
    n = 3000  # a strip, a star, and random pieces, from roots inside and at the end
    ids, rng = np.arange(n), np.random.default_rng(1)
    for a, b in ((ids[:-1], ids[1:]), (np.zeros(n - 1, int), ids[1:]), (rng.integers(0, ids[1:]), ids[1:]), (ids[5:-1], ids[6:])):
        net = K.Net(ids, rng.integers(0, 3, n), a, b)
        for root in (0, 7, n - 1):
            tree = K.random_tree(ids.tolist(), K.induced(net, set(range(n))), np.random.default_rng(2))
            for share, one_sided in ((2, False), (4, True)):
                args = net.population, net.population.sum() / share, 0.9, root, one_sided
                got, want = K.Tree(ids, *net.pairs, np.random.default_rng(2), net).cuts(*args), K.balanced_cuts(tree, *args)
                assert [c[:2] for c in got] == [c[:2] for c in want] and all(x[2] == y[2] for x, y in zip(got[::97], want[::97]))
    flips = K.Flips(np.array([3, 5]), np.array([1, 0]))
    assert flips == {3: 1, 5: 0} and dict(flips) == {3: 1, 5: 0} and len(flips) == 2 and 4 not in flips
    assert {1, 2, 3} - K.Side(np.array([2, 3])) == {1} and K.Side(np.array([2, 3])) == {2, 3}


def test_diversity_from_changes(spark):
    """distinct plans and districts from what flips change are those of plans written out, also of
    plans seen again, parts that lose all nodes or change names, steps without flips and ends."""
    nodes, edges = grid(spark, 3)
    start = plan(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2])
    log = [(0, 0, None, None), (0, 1, 3, 0), (0, 2, 3, 1), (0, 3, None, None), (0, 5, 3, 0), (0, 6, 4, 0), (0, 6, 5, 0), (0, 8, 3, 1), (0, 8, 4, 1), (0, 8, 5, 1), (1, 0, 4, 4)]
    log += [(2, 1, v, 7) for v in range(9)] + [(2, 2, 0, 0)] + [(3, 1, v, (1, 2, 0)[v // 3]) for v in range(9)] + [(3, 4, 8, 2), (3, 4, 7, 2)]
    flips = spark.createDataFrame([(*r, None) for r in log] + [(1, None, None, None, "Stuck: here"), (5, None, None, None, "Stuck: there")], "chain long, step long, node_id long, part int, status string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    got = ensemble.diversity(edges, flips, start)
    want = S.diversity(ensemble.plans_of(flips, start), edges)
    assert rows(got) == rows(want) and len(rows(got)) == 9 + 1 + 3 + 5 and got.dtypes == want.dtypes
    for proposal in ("flip", "recom"):
        flips = ensemble.run_chains(nodes, edges, start, 3, 40, proposal, epsilon=0.5)
        assert rows(ensemble.diversity(edges, flips, start)) == rows(S.diversity(ensemble.plans_of(flips, start), edges))


def test_a_graph_comes_in_arrow_columns(spark, monkeypatch):
    """no row objects on the way to a net; regions keep None, parts 32 bits."""
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda d: pytest.fail("rows as objects"))
    nodes, edges = grid(spark, 3)
    named = nodes.withColumn("population", F.col("node_id") * 2).withColumn("county", F.when(F.col("node_id") > 2, F.col("node_id"))).withColumn("muni", F.when(F.col("node_id") < 5, F.lit("m")))
    net, first = ensemble.net_of(named.repartition(3), edges, plan(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2]), regions=("county", "muni"))
    assert net.ids.tolist() == list(range(9)) and net.population.tolist() == list(range(0, 18, 2)) and net.population.dtype == np.int64
    assert net.region["county"].tolist() == [None] * 3 + list(range(3, 9)) and net.region["muni"].tolist() == ["m"] * 5 + [None] * 4
    assert first.tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2] and first.dtype == np.int32


def test_sides_are_not_made_anew_by_filters(spark):
    """no filter of sides carries their directions, which it would make anew for each name."""
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    d = spark.createDataFrame([(i, square(float(i))) for i in range(3)], RINGS)
    for e in (G.adjacency(d), G.adjacency(d, True), G.boundary_perimeters(d, G.adjacency(d))):
        filters = [x for x in e._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
        assert filters and not any("SQRT" in x for x in filters)
    assert {tuple(r) for r in G.adjacency(d).collect()} == {(0, 1, 1.0), (1, 2, 1.0)}
    odd = spark.createDataFrame([(1, [(float("nan"), 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, [(1.0, 0.0), (1.0, 1.0), (2.0, 0.5)]), (3, []), (4, None)], RINGS)
    assert [tuple(r) for r in G.adjacency(odd).collect()] == [(1, 2, 1.0)]
