"""Scores of plans. Plans are rows (plan_id, node_id, part); nodes and edges describe one graph.
All plans of an ensemble are scored in one job, keyed by plan and part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import compactness, ratio

KEY = ["plan_id", "part"]


def tally(nodes: DataFrame, plans: DataFrame, **sums: str | list[str]) -> DataFrame:
    """Sums of node columns by part; rows with a NaN in any of a sum's columns are left out."""
    aggs, kinds = [], dict(nodes.dtypes)
    for name, fields in sums.items():
        fields = [fields] if isinstance(fields, str) else fields
        total = sum((F.col(f) for f in fields[1:]), F.col(fields[0]))
        real = [f for f in fields if kinds[f] in ("double", "float")]
        if real:
            bad = F.isnan(real[0])
            for f in real[1:]:
                bad = bad | F.isnan(f)
            total = F.when(~bad, total)
        aggs.append(F.sum(total).alias(name))
    return plans.join(nodes, "node_id").groupBy(*KEY).agg(*aggs)


def sided(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Edges of each plan with the parts of both ends."""
    a, b = (plans.select("plan_id", F.col("node_id").alias(e), F.col("part").alias(f"part_{e}")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, ["plan_id", "dst"])


def cut_edges(edges: DataFrame, plans: DataFrame) -> DataFrame:
    return sided(edges, plans).filter("part_src <> part_dst")


def by_part(cuts: DataFrame) -> DataFrame:
    """Each cut edge under both parts that it touches."""
    return cuts.withColumn("part", F.explode(F.array("part_src", "part_dst")))


def with_parts(plans: DataFrame, scored: DataFrame, columns: list[str]) -> DataFrame:
    """All parts of the plans, with 0 where a score has no row."""
    every = plans.select(*KEY).distinct()
    return every.join(scored, KEY, "left").fillna(0, columns)


def perimeters(nodes: DataFrame, edges: DataFrame, plans: DataFrame) -> DataFrame:
    """exterior, interior and perimeter by part."""
    outer = plans.join(nodes.filter("boundary_node"), "node_id").groupBy(*KEY).agg(F.sum("boundary_perim").alias("exterior"))
    inner = by_part(cut_edges(edges, plans)).groupBy(*KEY).agg(F.sum("shared_perim").alias("interior"))
    both = with_parts(plans, outer, ["exterior"]).join(inner, KEY, "left").fillna(0, ["interior"])
    return both.withColumn("perimeter", F.col("exterior") + F.col("interior"))


def compact(nodes: DataFrame, edges: DataFrame, plans: DataFrame) -> DataFrame:
    p = perimeters(nodes, edges, plans).join(tally(nodes, plans, area="area"), KEY)
    return p.withColumn("polsby_popper", compactness(F.col("area"), F.col("perimeter")))


def norms(scored: DataFrame, column: str = "polsby_popper") -> DataFrame:
    """L1, L2, harmonic mean and L1 of reciprocals, by plan."""
    x = F.col(column)
    return scored.groupBy("plan_id").agg(F.sum(x).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), (F.count("*") / F.sum(1 / x)).alias("harmonic"), F.sum(1 / x).alias("l1_reciprocal"))


def deviation(scored: DataFrame, column: str = "population") -> DataFrame:
    ideal = F.avg(F.col(column).cast("double")).over(W.partitionBy("plan_id"))
    return scored.withColumn("deviation", (F.col(column) - ideal) / ideal)


# ------------------------------------------------------------------------------- elections


def election(nodes: DataFrame, plans: DataFrame, parties: dict[str, str], name: str = "election") -> DataFrame:
    """Votes, shares and winners, a row for each plan, part and party, parties in order. A part is
    won by strictly more votes than any other party has."""
    t = tally(nodes, plans, **parties)
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("party_ord"), F.lit(p).alias("party"), F.col(p).cast("long").alias("votes")) for i, p in enumerate(parties)])).alias("v")
    v = t.select(*KEY, stack).select(*KEY, F.lit(name).alias("election"), "v.*")
    here = W.partitionBy("plan_id", "part")
    total, best = F.sum("votes").over(here), F.max("votes").over(here)
    ties = F.sum((F.col("votes") == F.col("best")).cast("int")).over(here)
    v = v.withColumn("total", total).withColumn("share", ratio(F.col("votes"), F.col("total"))).withColumn("best", best)
    return v.withColumn("won", (F.col("votes") == F.col("best")) & (ties == 1)).drop("best")


def seats(results: DataFrame) -> DataFrame:
    out = results.groupBy("plan_id", "election", "party").agg(F.count_if("won").alias("seats"), F.sum("votes").cast("long").alias("votes"), F.sum("total").alias("_t"))
    return out.withColumn("share", F.col("votes").cast("double") / F.col("_t").cast("double")).drop("_t")


def wasted(v1: Column, v2: Column) -> tuple[Column, Column]:
    """Wasted votes of two parties; a tie wastes none of the second's."""
    half = (v1 + v2).cast("double") / 2
    return F.when(v1 > v2, v1 - half).otherwise(v1.cast("double")), F.when(v1 > v2, v2.cast("double")).otherwise(v2 - half)


def two_party(results: DataFrame) -> DataFrame:
    """A row for each plan and part: votes of the first two parties and the first's share."""
    pick = lambda i, c: F.max(F.when(F.col("party_ord") == i, F.col(c)))
    return results.groupBy("plan_id", "election", "part").agg(pick(0, "votes").alias("v1"), pick(1, "votes").alias("v2"), pick(0, "share").alias("share"))


def partisan(results: DataFrame) -> DataFrame:
    """Six measures of a two-party election, a row for each plan: shares are the first party's."""
    d = two_party(results)
    w1, w2 = wasted(F.col("v1"), F.col("v2"))
    d = d.withColumn("gap", w2 - w1).withColumn("mean", F.avg("share").over(W.partitionBy("plan_id", "election")))
    n = F.size("s")
    g = d.groupBy("plan_id", "election").agg(
        F.sort_array(F.collect_list("share")).alias("s"), F.avg("share").alias("mean"), F.median("share").alias("median"), F.sum("gap").alias("gap"), F.sum(F.col("v1") + F.col("v2")).cast("double").alias("total"),
        F.sum("v1").cast("double").alias("first"), (F.count_if(F.col("share") > F.col("mean")).cast("double") / F.count("*") - 0.5).alias("partisan_bias"),
    )
    # seat curve by falling share: overall - s + 1/2, against its mirror image
    overall = F.col("first") / F.col("total")
    curve = F.transform(F.reverse("s"), lambda x: overall - x + 0.5)
    pairs = F.zip_with(curve, F.reverse(curve), lambda a, b: F.abs(a - (1 - b)))
    return g.select(
        "plan_id", "election", (F.col("median") - F.col("mean")).alias("mean_median"), (F.element_at("s", F.bround(n / F.lit(3.0)).cast("int") + 1) - F.col("mean")).alias("mean_thirdian"),
        (F.col("gap") / F.col("total")).alias("efficiency_gap"), "partisan_bias", (F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / n).alias("partisan_gini"),
    )


# ------------------------------------------------------------------------------ localities


def counties(nodes: DataFrame, plans: DataFrame, field: str) -> DataFrame:
    """For each plan and county: its parts and whether they are several."""
    return plans.join(nodes, "node_id").groupBy("plan_id", field).agg(F.array_sort(F.collect_set("part")).alias("parts"), F.count("*").alias("n_nodes")).withColumn("split", F.size("parts") > 1)


def county_states(chain: DataFrame, field: str) -> DataFrame:
    """States of (plan_id, step, county, split): a split is new if the step before had none there;
    those of the first step are old, and a new one that stays is new still."""
    w = W.partitionBy("plan_id", field).orderBy("step")
    run = F.sum((~F.col("split")).cast("int")).over(w)
    since = F.min("step").over(W.partitionBy("plan_id", field, "_run"))
    first = F.min("step").over(W.partitionBy("plan_id", field))
    c = chain.withColumn("_run", run)
    c = c.withColumn("state", F.when(~F.col("split"), "not_split").when((F.col("_run") == 0) & (since == first), "old_split").otherwise("new_split"))
    return c.drop("_run")


def region_splits(nodes: DataFrame, edges: DataFrame, plans: DataFrame, field: str) -> DataFrame:
    """Regions with a cut edge inside, by plan."""
    r = nodes.select("node_id", field)
    e = cut_edges(edges, plans).join(r.withColumnsRenamed({"node_id": "src", field: "a"}), "src").join(r.withColumnsRenamed({"node_id": "dst", field: "b"}), "dst")
    n = e.filter("a = b").groupBy("plan_id").agg(F.countDistinct("a").alias("n"))
    return plans.select("plan_id").distinct().join(n, "plan_id", "left").select("plan_id", F.coalesce("n", F.lit(0).cast("long")).alias("split_regions"))


def localities(nodes: DataFrame, edges: DataFrame, plans: DataFrame, field: str, alpha: float = 0.05) -> DataFrame:
    """Split scores by plan: parts, split localities, naked boundary and three entropies. Two of
    those count nodes, the symmetric one weighs population."""
    c = plans.join(nodes, "node_id").groupBy("plan_id", field, "part").agg(F.count("*").cast("double").alias("n"), F.sum("population").cast("double").alias("p"))
    by = lambda *k: W.partitionBy("plan_id", *k)
    c = c.withColumns({"nl": F.sum("n").over(by(field)), "all": F.sum("n").over(by()), "pl": F.sum("p").over(by(field)), "pd": F.sum("p").over(by("part")), "k": F.count("*").over(by(field))})
    share, q = F.col("n") / F.col("nl"), F.col("nl") / F.col("all")
    c = c.withColumns({"shannon": q * share * F.ln(1 / share), "power": F.pow(share, F.lit(1 - alpha)) / q, "sym": F.when(F.col("p") > 0, F.sqrt(F.col("p") * F.col("pd")) + F.sqrt(F.col("p") * F.col("pl"))).otherwise(F.lit(0.0)), "one": 1 / F.col("k"), "base": 1 / q / F.col("k")})
    s = c.groupBy("plan_id").agg(
        F.count("*").alias("num_parts"), F.sum("shannon").alias("shannon_entropy"), (F.sum("power") - F.sum("base")).alias("power_entropy"), F.sum("sym").alias("symmetric_entropy"), F.countDistinct(F.when(F.col("k") > 1, F.col(field))).alias("num_split_localities"),
    )
    r = nodes.select("node_id", field)
    e = cut_edges(edges, plans).join(r.withColumnsRenamed({"node_id": "src", field: "a"}), "src").join(r.withColumnsRenamed({"node_id": "dst", field: "b"}), "dst")
    naked = e.filter("a = b").groupBy("plan_id").agg(F.count("*").alias("naked"))
    return s.join(naked, "plan_id", "left").withColumn("naked_boundary", F.coalesce("naked", F.lit(0).cast("long"))).drop("naked")


def allowed_pieces(nodes: DataFrame, plans: DataFrame, field: str) -> DataFrame:
    """ceil of a locality's population over the ideal one of a part."""
    k = plans.groupBy("plan_id").agg(F.countDistinct("part").alias("k"))
    p = plans.join(nodes, "node_id").groupBy("plan_id", field).agg(F.sum("population").alias("p")).join(k, "plan_id")
    return p.select("plan_id", field, F.ceil(F.col("p") * F.col("k") / F.sum("p").over(W.partitionBy("plan_id"))).alias("allowed_pieces"))


# ---------------------------------------------------------------------------- connectivity


def components(nodes: DataFrame, edges: DataFrame, plans: DataFrame, within: str | None = None) -> DataFrame:
    """(plan_id, part, [within,] node_id, component): the least node that can be reached inside the
    part, and inside the locality if `within` names one. Each part is solved in a task of its
    own, by Arrow batches: districts are small against an ensemble."""
    import pyarrow as pa

    e = sided(edges, plans).filter("part_src = part_dst")
    keys = [*KEY]
    base = plans
    if within:
        r = nodes.select("node_id", within)
        e = e.join(r.withColumnsRenamed({"node_id": "src", within: "a"}), "src").join(r.withColumnsRenamed({"node_id": "dst", within: "b"}), "dst").filter("a = b")
        base = plans.join(r, "node_id")
    solo = base.select("plan_id", "part", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    links = e.select("plan_id", F.col("part_src").alias("part"), "src", "dst").unionAll(solo)

    def solve(t: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(t["src"].to_pylist(), t["dst"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        ids = list(up)
        return pa.table({"plan_id": pa.array([t["plan_id"][0].as_py()] * len(ids), pa.string()), "part": pa.array([t["part"][0].as_py()] * len(ids), pa.int32()), "node_id": pa.array(ids, pa.int64()), "component": pa.array([find(i) for i in ids], pa.int64())})

    out = links.groupBy(*keys).applyInArrow(solve, "plan_id string, part int, node_id long, component long")
    return out.join(nodes.select("node_id", within), "node_id") if within else out


def contiguity(comps: DataFrame) -> DataFrame:
    """By plan: its contiguous parts, and whether all are."""
    c = comps.groupBy(*KEY).agg(F.countDistinct("component").alias("n"))
    return c.groupBy("plan_id").agg(F.count_if(F.col("n") == 1).alias("contiguous_parts"), F.count("*").alias("parts")).withColumn("contiguous", F.col("contiguous_parts") == F.col("parts"))


def pieces(comps: DataFrame, field: str) -> DataFrame:
    return comps.groupBy("plan_id").agg(F.countDistinct("part", field, "component").alias("num_pieces"))


# ----------------------------------------------------------------------------- constraints


def within_bounds(scored: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return scored.groupBy("plan_id").agg(((F.min(column) >= low) & (F.max(column) <= high)).alias("valid"))


def near_ideal(scored: DataFrame, ideal: float, fraction: float = 0.01, column: str = "population") -> DataFrame:
    return within_bounds(scored, column, (1 - fraction) * ideal, (1 + fraction) * ideal)


def within_tolerance(scored: DataFrame, column: str = "population", fraction: float = 0.1) -> DataFrame:
    """The spread is at most that fraction of the least; 1 and above count as per cent."""
    fraction = fraction / 100 if fraction >= 1 else fraction
    return scored.groupBy("plan_id").agg((F.max(column) - F.min(column) <= fraction * F.min(column)).alias("valid"))


def no_worse_than_first(chain: DataFrame, column: str, lower: bool, slack: float = 0.0) -> DataFrame:
    """Chain scores (plan_id, step, column) against the first step's."""
    first = F.first(column).over(W.partitionBy("plan_id").orderBy("step"))
    return chain.withColumn("valid", F.col(column) >= first - slack if lower else F.col(column) <= first + slack)


def no_empty_parts(parts: DataFrame, plans: DataFrame) -> DataFrame:
    n = parts.join(plans.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left")
    return n.groupBy("plan_id").agg((F.min(F.coalesce("n", F.lit(0).cast("long"))) > 0).alias("valid"))


# ------------------------------------------------------------------- flips, ensembles, meta


def plan_at(initial: DataFrame, flips: DataFrame, step: int) -> DataFrame:
    """The plan after all flips up to a step: the last one of a node holds."""
    last = flips.filter(F.col("step") <= step).groupBy("node_id").agg(F.max_by("part", "step").alias("new"))
    return initial.join(last, "node_id", "left").select("plan_id", "node_id", F.coalesce("new", "part").alias("part"))


def flows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(plan_id, part, node_id, direction) of nodes that changed parts."""
    j = old.withColumnRenamed("part", "was").join(new.select("plan_id", "node_id", F.col("part").alias("now")), ["plan_id", "node_id"]).filter("was <> now")
    return j.select("plan_id", "node_id", F.explode(F.array(F.struct(F.col("was").alias("part"), F.lit("out").alias("direction")), F.struct(F.col("now").alias("part"), F.lit("in").alias("direction")))).alias("f")).select("plan_id", "f.part", "node_id", "f.direction")


def edge_flows(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(plan_id, part, src, dst, direction): cut edges that left or came to a part."""
    was, now = (by_part(cut_edges(edges, p)).select("plan_id", "part", "src", "dst") for p in (old, new))
    key = ["plan_id", "part", "src", "dst"]
    return was.join(now, key, "left_anti").withColumn("direction", F.lit("out")).unionAll(now.join(was, key, "left_anti").withColumn("direction", F.lit("in")))


def changed_cuts(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(plan_id, src, dst, change): cut edges that are new or obsolete."""
    was, now = (cut_edges(edges, p).select("plan_id", "src", "dst") for p in (old, new))
    key = ["plan_id", "src", "dst"]
    return now.join(was, key, "left_anti").withColumn("change", F.lit("new")).unionAll(was.join(now, key, "left_anti").withColumn("change", F.lit("obsolete")))


def running_best(chain: DataFrame, column: str, maximize: bool = True) -> DataFrame:
    """Best score so far and the step that has it; a tie goes to the later step."""
    w = W.partitionBy("plan_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    score = F.col(column) if maximize else -F.col(column)
    return chain.withColumn("best_step", F.max(F.struct(score.alias("v"), F.col("step").alias("s"))).over(w)["s"]).withColumn("best", (F.max if maximize else F.min)(column).over(w))


def diversity(ensemble: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct plans and districts seen up to each step of (plan_id, step, node_id, part): a plan is
    its set of cut edges, a district its set of nodes, whatever the labels."""
    flat = ensemble.select(F.concat_ws("/", "plan_id", F.col("step").cast("string")).alias("plan_id"), "node_id", "part", F.col("plan_id").alias("chain"), "step")
    names = flat.select("plan_id", "chain", "step").distinct()
    cut = cut_edges(edges, flat.select("plan_id", "node_id", "part")).groupBy("plan_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "src", "dst"))), ","), 256).alias("key"))
    plans = names.join(cut, "plan_id", "left").fillna("", ["key"])
    dist = flat.groupBy("chain", "step", "part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ","), 256).alias("key"))
    return first_seen(names.select("chain", "step"), plans, dist)


def first_seen(names: DataFrame, plans: DataFrame, districts: DataFrame) -> DataFrame:
    """Up to each step (chain, step), the distinct keys of plans and of districts (chain, step, key)."""
    first = lambda d: d.groupBy("chain", "key").agg(F.min("step").alias("step")).groupBy("chain", "step").agg(F.count("*").alias("n"))
    w = W.partitionBy("chain").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    steps = names.join(first(plans).withColumnRenamed("n", "np"), ["chain", "step"], "left").join(first(districts).withColumnRenamed("n", "nd"), ["chain", "step"], "left").fillna(0, ["np", "nd"])
    return steps.select("chain", "step", F.sum("np").over(w).alias("unique_plans"), F.sum("nd").over(w).alias("unique_districts"), F.row_number().over(W.partitionBy("chain").orderBy("step")).cast("long").alias("steps_taken"))


def metagraph_flips(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, node_id, part): both moves of each cut edge, repeats kept."""
    two = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("part_dst").alias("part")), F.struct(F.col("dst").alias("node_id"), F.col("part_src").alias("part")))).alias("f")
    return cut_edges(edges, plans).select("plan_id", two).select("plan_id", "f.*")


def neighbours(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans one flip away, as plans of their own: `plan_id` names plan, node and new part."""
    f = metagraph_flips(edges, plans).distinct().withColumnsRenamed({"node_id": "moved", "part": "to"})
    out = plans.join(f, "plan_id")
    return out.select(F.concat_ws("/", "plan_id", F.col("moved").cast("string"), F.col("to").cast("string")).alias("plan_id"), "node_id", F.when(F.col("node_id") == F.col("moved"), F.col("to")).otherwise(F.col("part")).alias("part"))


def valid_flips(nodes: DataFrame, edges: DataFrame, plans: DataFrame, fraction: float) -> DataFrame:
    """(plan_id, node_id, part): the distinct single moves that leave both parts within a fraction of
    the mean population. Only moves and part totals are met, no plan is written out; nulls count 0."""
    people = nodes.select("node_id", F.coalesce("population", F.lit(0)).alias("moved"))
    t = tally(nodes, plans, population="population").select(*KEY, F.coalesce("population", F.lit(0)).alias("population"))
    t = t.withColumn("ideal", F.avg(F.col("population").cast("double")).over(W.partitionBy("plan_id")))
    moves = metagraph_flips(edges, plans).distinct().join(plans.select("plan_id", "node_id", F.col("part").alias("own")), ["plan_id", "node_id"]).join(people, "node_id")
    left = t.select("plan_id", F.col("part").alias("own"), F.col("population").alias("from"), "ideal")
    both = moves.join(left, ["plan_id", "own"]).join(t.select(*KEY, F.col("population").alias("into")), KEY)
    inside = lambda x: (x >= F.col("ideal") * (1 - fraction)) & (x <= F.col("ideal") * (1 + fraction))
    return both.filter(inside(F.col("from") - F.col("moved")) & inside(F.col("into") + F.col("moved"))).select("plan_id", "node_id", "part")


def previous(chain: DataFrame, *columns: str) -> DataFrame:
    """Chain scores beside those of the step before, null at a chain's first: `previous_<column>`."""
    w = W.partitionBy("plan_id").orderBy("step")
    return chain.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def metagraph_degree(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """How many moves each plan has; plans without a cut edge have 0."""
    n = cut_edges(edges, plans).groupBy("plan_id").agg((2 * F.count("*")).alias("n"))
    return plans.select("plan_id").distinct().join(n, "plan_id", "left").select("plan_id", F.coalesce("n", F.lit(0).cast("long")).alias("degree"))


# ------------------------------------------------------------------------- incremental updates


def updated_tally(before: DataFrame, nodes: DataFrame, flowed: DataFrame, column: str) -> DataFrame:
    """A tally (plan_id, part, column) after flows: what came in is added, what went out taken away.
    Parts that flows bring into being start from 0."""
    sign = F.when(F.col("direction") == "in", 1).otherwise(-1)
    change = flowed.join(nodes.select("node_id", F.col(column).alias("v")), "node_id").groupBy(*KEY).agg(F.sum(sign * F.col("v")).alias("d"))
    both = before.join(change, KEY, "full")
    return both.select(*KEY, (F.coalesce(column, F.lit(0)) + F.coalesce("d", F.lit(0))).alias(column))


def updated_cuts(before: DataFrame, flowed: DataFrame) -> DataFrame:
    """Cut edges by part (plan_id, part, src, dst) after edge flows."""
    key = ["plan_id", "part", "src", "dst"]
    gone, come = (flowed.filter(F.col("direction") == d).select(*key) for d in ("out", "in"))
    return before.select(*key).join(gone, key, "left_anti").unionAll(come)


def on_flow(before: DataFrame, flowed: DataFrame, item: Column, previous: str, update) -> DataFrame:
    """A score of parts (plan_id, part, `previous`) after flows of nodes or edges: `update` makes the
    new value from the column of the old one and the arrays of items that came in and went out.
    Parts without flows keep their value; those that flows bring into being have a null before."""
    pick = lambda d: F.collect_list(F.when(F.col("direction") == d, item)).alias(f"_{d}")
    both = before.select(*KEY, previous).join(flowed.groupBy(*KEY).agg(pick("in"), pick("out")), KEY, "full")
    changed = update(F.col(previous), F.col("_in"), F.col("_out"))
    return both.select(*KEY, F.when(F.col("_in").isNull(), F.col(previous)).otherwise(changed).alias(previous))


def neighbour_flips(edges: DataFrame, flowed: DataFrame) -> DataFrame:
    """(plan_id, src, dst): edges with an end that changed parts, once each."""
    moved = flowed.select("plan_id", "node_id").distinct()
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.join(moved, "node_id").select("plan_id", "src", "dst").distinct()


def affected(flowed: DataFrame) -> DataFrame:
    """(plan_id, part): parts that a flip has left or come to."""
    return flowed.select(*KEY).distinct()


def flip_contiguous(nodes: DataFrame, edges: DataFrame, new: DataFrame, flowed: DataFrame) -> DataFrame:
    """(plan_id, part, contiguous) of the parts that nodes have left: the others stay whole."""
    lost = flowed.filter("direction = 'out'").select(*KEY).distinct()
    comps = components(nodes, edges, new.join(lost, KEY, "left_semi"))
    return comps.groupBy(*KEY).agg((F.countDistinct("component") == 1).alias("contiguous"))


def reachable(nodes: DataFrame, edges: DataFrame, avoid: Column, source: int) -> DataFrame:
    """(node_id): what a source reaches over nodes that `avoid` does not name. One task walks it: the
    graph of a map is small."""
    open_ = nodes.filter(~avoid).select(F.lit("").alias("plan_id"), "node_id", F.lit(0).alias("part"))
    c = components(nodes, edges, open_)
    return c.join(c.filter(F.col("node_id") == source).select("component"), "component").select("node_id")


# ------------------------------------------------------------------------------ sets and ranks


def subgraphs(edges: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, part, src, dst): the edges inside each part."""
    return sided(edges, plans).filter("part_src = part_dst").select("plan_id", F.col("part_src").alias("part"), "src", "dst")


def boundary_sets(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, part, node_id): each part's nodes on the map's outer boundary."""
    return plans.join(nodes.filter("boundary_node").select("node_id"), "node_id").select("plan_id", "part", "node_id")


def level_sets(plans: DataFrame) -> DataFrame:
    """(plan_id, part, n_nodes, nodes): each part's nodes, ascending; districts are small."""
    return plans.groupBy(*KEY).agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list("node_id")).alias("nodes"))


def sorted_shares(results: DataFrame, party: str) -> DataFrame:
    """(plan_id, rank, share): a party's shares, ascending, for plots of ensembles."""
    order = F.row_number().over(W.partitionBy("plan_id").orderBy("share", "part"))
    return results.filter(F.col("party") == party).select("plan_id", order.alias("rank"), "share")


def most_common(nodes: DataFrame, plans: DataFrame, field: str) -> DataFrame:
    """(plan_id, part, field): the commonest value in each part; of equal ones the least."""
    n = plans.join(nodes.select("node_id", field), "node_id").groupBy(*KEY, field).agg(F.count("*").alias("n"))
    return n.groupBy(*KEY).agg(F.min_by(field, F.struct(-F.col("n"), F.col(field))).alias(field))


def heaviest_cut(edges: DataFrame, plans: DataFrame, weight: Column) -> DataFrame:
    """(plan_id, src, dst, weight): the cut edge of most weight; of equal ones the first."""
    c = cut_edges(edges, plans).withColumn("weight", weight)
    best = F.max_by(F.struct("src", "dst", "weight"), F.struct("weight", -F.col("src"), -F.col("dst"))).alias("e")
    return c.groupBy("plan_id").agg(best).select("plan_id", "e.*")


def preferred_cut(nodes: DataFrame, edges: DataFrame, plans: DataFrame, surcharge: dict[str, float], weight: Column) -> DataFrame:
    """(plan_id, src, dst, crossed, weight): the cut edge that crosses most of the named regions; of
    equal numbers those of most surcharge, then of most weight, then the first. Two nodes without a
    region are in one."""
    r = nodes.select("node_id", *surcharge)
    end = lambda e: r.withColumnsRenamed({"node_id": e} | {c: f"{c}_{e}" for c in surcharge})
    c = cut_edges(edges, plans).join(end("src"), "src").join(end("dst"), "dst").withColumn("weight", weight)
    over = {c: (~F.col(f"{c}_src").eqNullSafe(F.col(f"{c}_dst"))).cast("int") for c in surcharge}
    c = c.withColumns({"crossed": sum(over.values(), F.lit(0)), "extra": sum((x * surcharge[k] for k, x in over.items()), F.lit(0.0))})
    best = F.max_by(F.struct("src", "dst", "crossed", "weight"), F.struct("crossed", "extra", "weight", -F.col("src"), -F.col("dst"))).alias("e")
    return c.groupBy("plan_id").agg(best).select("plan_id", "e.*")


def election_report(results: DataFrame) -> DataFrame:
    """(plan_id, report): an election as text, a heading, then each part with its parties' shares to
    four places."""
    line = F.concat(F.lit("  "), "party", F.lit(": "), F.coalesce(F.round("share", 4).cast("string"), F.lit("nan")))
    part = results.groupBy("plan_id", "election", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("party_ord", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "t"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":\n"), x["t"])), "\n")
    return part.groupBy("plan_id", "election").agg(parts.alias("t")).select("plan_id", F.concat(F.lit("Election Results for "), "election", F.lit("\n"), "t").alias("report"))


def plan_map(plans: DataFrame) -> DataFrame:
    """(plan_id, parts): each plan as one map from nodes to parts, for export; a map's nodes are few."""
    return plans.groupBy("plan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", "part")))).alias("parts"))


def group_share(nodes: DataFrame, plans: DataFrame, group: str, total: str) -> DataFrame:
    """(plan_id, part, share): a group's share of each part."""
    t = tally(nodes, plans, g=group, t=total)
    return t.select(*KEY, ratio(F.col("g"), F.col("t")).alias("share"))


def total_population(nodes: DataFrame, column: str = "population") -> DataFrame:
    return nodes.agg(F.sum(column).alias(column))


# ------------------------------------------------------------------------- more constraints


def at_most(scored: DataFrame, column: str, bound: float) -> DataFrame:
    return scored.groupBy("plan_id").agg((F.max(column) <= bound).alias("valid"))


def at_least(scored: DataFrame, column: str, bound: float) -> DataFrame:
    return scored.groupBy("plan_id").agg((F.min(column) >= bound).alias("valid"))


def within_percent_of_first(chain: DataFrame, column: str, percent: float) -> DataFrame:
    """Chain scores (plan_id, step, column): within so many per cent of the first that is not 0."""
    first = F.first(F.when(F.col(column) != 0, F.col(column)), ignorenulls=True).over(W.partitionBy("plan_id").orderBy("step"))
    low, high = first * (1 - percent / 100), first * (1 + percent / 100)
    return chain.withColumn("valid", F.coalesce((F.col(column) >= low) & (F.col(column) <= high), F.lit(True)))


def refuse_new_splits(states: DataFrame) -> DataFrame:
    """(plan_id, step, valid) of county states: no county is newly split."""
    return states.groupBy("plan_id", "step").agg((F.count_if(F.col("state") == "new_split") == 0).alias("valid"))


def spanning_trees_log(nodes: DataFrame, edges: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, part, log_trees): log of how many spanning trees each part has, by the determinant
    of its Laplacian without a row; a part a task, dense, as districts are small. A part of several
    pieces has none: minus infinity."""
    import numpy as np
    import pandas as pd

    inner = subgraphs(edges, plans)
    solo = plans.select("plan_id", "part", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(d[["src", "dst"]].to_numpy())
        real = d[d["src"] != d["dst"]]
        a, b = np.searchsorted(ids, real["src"]), np.searchsorted(ids, real["dst"])
        m = np.diag(np.bincount(np.r_[a, b], minlength=len(ids)).astype(float))
        m[a, b] -= 1
        m[b, a] -= 1
        return pd.DataFrame({"plan_id": [d["plan_id"].iloc[0]], "part": [d["part"].iloc[0]], "log_trees": [float(np.linalg.slogdet(m[1:, 1:])[1]) if len(ids) > 1 else 0.0]})

    return inner.unionAll(solo).groupBy(*KEY).applyInPandas(solve, "plan_id string, part int, log_trees double")
