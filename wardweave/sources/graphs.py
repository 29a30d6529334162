"""Graphs as node and edge tables: lattices, adjacency JSON, district-plan JSON, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphError(ValueError):
    """A graph, plan or table that doesn't fit."""


def lattice(spark: SparkSession, m: int, n: int, diagonals: bool = False) -> tuple[DataFrame, DataFrame]:
    """An m by n rook lattice: nodes with place, unit population and area, and boundary sides;
    edges of unit length, diagonals of length 0."""
    i, j = F.col("i"), F.col("j")
    sides = (i == 0).cast("int") + (i == m - 1).cast("int") + (j == 0).cast("int") + (j == n - 1).cast("int")
    edge = (i == 0) | (i == m - 1) | (j == 0) | (j == n - 1)
    corner = i.isin(0, m - 1) & j.isin(0, n - 1)
    nodes = spark.range(m * n).select(F.col("id").alias("node_id"), F.floor(F.col("id") / n).cast("int").alias("i"), F.pmod("id", F.lit(n)).cast("int").alias("j"))
    nodes = nodes.withColumns({"population": F.lit(1).cast("long"), "area": F.lit(1.0), "boundary_node": edge, "boundary_perim": F.when(corner, 2.0).when(edge, 1.0).otherwise(F.lit(0.0)), "sides": sides})
    steps = [(0, 1, 1.0), (1, 0, 1.0)] + ([(1, 1, 0.0), (1, -1, 0.0)] if diagonals else [])
    parts = [nodes.filter((i + a < m) & (j + b < n) & (j + b >= 0)).select(F.col("node_id").alias("src"), (F.col("node_id") + a * n + b).alias("dst"), F.lit(w).alias("shared_perim")) for a, b, w in steps]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionAll(p)
    return nodes.drop("sides"), edges


def quadrants(nodes: DataFrame, m: int, n: int) -> DataFrame:
    """Plan of four quarters."""
    return nodes.select("node_id", ((F.col("i") >= m // 2).cast("int") + 2 * (F.col("j") >= n // 2).cast("int")).alias("part"))


def halves(nodes: DataFrame, at: int) -> DataFrame:
    return nodes.select("node_id", F.when(F.col("i") <= at, 0).otherwise(1).alias("part"))


def matrix(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each column j: the parts by i."""
    return nodes.join(plan, "node_id").groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]).alias("parts"))


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (once each, lower id first) of an adjacency JSON file."""
    raw = spark.read.option("multiLine", True).json(path)
    pairs = raw.select(F.explode(F.arrays_zip("nodes", "adjacency")).alias("x"))
    nodes = pairs.select("x.nodes.*").withColumnRenamed("id", "node_id")
    to = pairs.select(F.col("x.nodes.id").alias("src"), F.explode("x.adjacency").alias("e")).select("src", F.col("e.id").alias("dst"), "e.*").drop("id")
    return nodes, to.filter("src < dst")


def write_adjacency(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A JSON file with each edge under both its ends; geometries are left out by the caller."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    both = edges.select("src", "dst", *extra).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))
    near = both.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("id"), *extra))).alias("adj"))
    attrs = [c for c in nodes.columns if c != "node_id"]
    rows = nodes.join(near, "node_id", "left").select(F.struct(F.col("node_id").alias("id"), *attrs).alias("node"), F.to_json(F.coalesce("adj", F.from_json(F.lit("[]"), near.schema["adj"].dataType))).alias("adj"), "node_id")
    one = rows.agg(F.array_sort(F.collect_list(F.struct("node_id", F.to_json("node").alias("node"), "adj"))).alias("r"))
    join = lambda f: F.array_join(F.transform("r", lambda x: x[f]), ",")
    one.select(F.concat(F.lit('{"directed":false,"multigraph":false,"graph":[],"nodes":['), join("node"), F.lit('],"adjacency":['), join("adj"), F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def read_plan(spark: SparkSession, path: str, nodes: DataFrame, key: str | None = None) -> DataFrame:
    """A plan from JSON `{idColumn: {key}, assignment: {id: part}}`, joined on the id as text."""
    raw = spark.read.schema("idColumn struct<key:string,name:string>, assignment map<string,int>").option("multiLine", True).json(path)
    key = key or raw.first()["idColumn"]["key"]
    if key not in nodes.columns:
        raise GraphError(f"the nodes have no column {key}")
    plan = raw.select(F.explode("assignment").alias("_id", "part"))
    out = nodes.select("node_id", F.col(key).cast("string").alias("_id")).join(plan, "_id", "left").select("node_id", "part")
    if not out.filter("part is null").isEmpty():
        raise GraphError("the plan leaves nodes without a part")
    return out


def join_table(nodes: DataFrame, table: DataFrame, left: str, right: str, columns: list[str] | None = None) -> DataFrame:
    """Nodes with a table's columns; each node needs one row, rows without a node are ignored."""
    columns = columns or [c for c in table.columns if c != right]
    t = table.select(F.col(f"`{right}`").alias("_key"), *[F.col(f"`{c}`") for c in columns])
    if not t.groupBy("_key").count().filter("count > 1").join(nodes.select(F.col(left).alias("_key")), "_key", "left_semi").isEmpty():
        raise GraphError(f"{right} is not unique")
    if not nodes.join(t, nodes[left] == t["_key"], "left_anti").isEmpty():
        raise GraphError("nodes without a row")
    return nodes.drop(*columns).join(t, nodes[left] == t["_key"]).drop("_key")


def islands(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.join(ends, "node_id", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def missing_values(nodes: DataFrame) -> DataFrame:
    """Nulls and NaNs by column."""
    kinds = dict(nodes.dtypes)
    counts = [F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))).alias(c) for c in nodes.columns]
    return nodes.agg(*counts).unpivot([], nodes.columns, "column", "n_missing")


def check_plan(nodes: DataFrame, plan: DataFrame) -> None:
    """Raise unless the plan gives each node one part."""
    if not plan.groupBy("node_id").count().filter("count > 1").isEmpty():
        raise GraphError("a node is in two parts")
    if not nodes.join(plan, "node_id", "left_anti").isEmpty() or not plan.join(nodes, "node_id", "left_anti").isEmpty():
        raise GraphError("plan and graph have different nodes")


# ------------------------------------------------------------- the driver's tables as a graph

WIDTH = 30


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ragged lattice of customers, 30 a row, with order counts as population and votes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("population"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"votes_{p}") for s, p in (("F", "d"), ("O", "r"), ("P", "o"))])
    n = c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("node_id"), F.floor(F.col("c_custkey") / WIDTH).alias("row"), F.pmod("c_custkey", F.lit(WIDTH)).alias("col"),
        *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("population", "votes_d", "votes_r", "votes_o")], F.col("c_nationkey").alias("county"), F.col("c_mktsegment").alias("muni"), F.lit(1.0).alias("area"),
    )
    ids = c.select(F.col("c_custkey").alias("dst"))
    k = F.col("c_custkey")
    e = c.filter(F.pmod(k, F.lit(WIDTH)) < WIDTH - 1).select(k.alias("src"), (k + 1).alias("dst")).unionAll(c.select(k.alias("src"), (k + WIDTH).alias("dst")))
    edges = e.join(ids, "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("shared_perim"))
    d = degrees(n, edges)
    n = n.join(d, "node_id").withColumn("boundary_perim", (4 - F.col("degree")).cast("double")).withColumn("boundary_node", F.col("boundary_perim") > 0).drop("degree")
    return n, edges


def bands(nodes: DataFrame, k: int) -> DataFrame:
    """A plan of k horizontal bands."""
    rows = nodes.agg((F.max("row") + 1).alias("n"))
    return nodes.select("node_id", "row").crossJoin(F.broadcast(rows)).select(F.lit(f"bands{k}").alias("plan_id"), "node_id", F.floor(k * F.col("row") / F.col("n")).cast("int").alias("part"))


def flip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flips (step, node_id, part)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return e.select((F.col("event_id") + 0).alias("step"), (F.col("user_id") * 10 + F.pmod("event_id", F.lit(10))).alias("node_id"), F.pmod(F.floor("value"), F.lit(5)).cast("int").alias("part"))


def polygon_area(ring: Column) -> Column:
    """Shoelace area of a closed or open ring of (x, y)."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def made_once(d: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """Columns behind a generator of one row, which filters and later columns are not carried through:
    each would make them anew, for every time that it names them."""
    return d.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def segments(polygons: DataFrame) -> DataFrame:
    """(node_id, x1, y1, x2, y2): sides of rings, lower end first."""
    ring = F.col("ring")
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    s = polygons.select("node_id", F.explode(F.arrays_zip(ring.alias("p"), after.alias("q"))).alias("s"))
    s = made_once(s, ["node_id"], a=F.least("s.p", "s.q"), b=F.greatest("s.p", "s.q")).filter("a <> b")
    return s.select("node_id", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def dealt(polygons: DataFrame) -> DataFrame:
    """Rings dealt anew by node, in as many partitions as shuffles have: a map's few files, and the few
    partitions that small rows are merged to, would leave its sides to a few tasks."""
    return polygons.select("node_id", "ring").repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node_id")


def adjacency(polygons: DataFrame, queen: bool = False) -> DataFrame:
    """Edges between polygons (node_id, ring) of a planar map: shared_perim sums the overlaps of
    sides on one line, which meet by an equi-join on that line and a cell of it, as long as a mean
    side; an overlap counts in the cell where it begins. queen adds shared corners, 0 long. Both
    sides of a join are the same rows, so they are made and shuffled once."""
    polygons = dealt(polygons)
    s = segments(polygons)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    norm = F.sqrt(dx * dx + dy * dy)
    r = lambda c: F.rint(c * 1e9) / 1e9 + 0.0  # noqa: E731  # F.round goes by decimals, which is slow
    line = s.withColumn("norm", norm).withColumns({"ux": r(dx / F.col("norm")), "uy": r(dy / F.col("norm"))})
    line = made_once(line, ["node_id", "x1", "y1", "x2", "y2"], ux=F.col("ux"), uy=F.col("uy"))
    line = made_once(line, ["node_id", "ux", "uy"], off=r(F.col("x1") * F.col("uy") - F.col("y1") * F.col("ux")), lo=F.col("x1") * F.col("ux") + F.col("y1") * F.col("uy"), hi=F.col("x2") * F.col("ux") + F.col("y2") * F.col("uy"))
    cell = line.agg(F.greatest(F.avg(F.col("hi") - F.col("lo")), F.lit(1e-9)).alias("cell"))
    place = lambda c: F.floor(c / F.col("cell"))
    # an overlap longer than 1e-9 begins before the side's last 1e-9
    line = line.filter("hi - lo > 1e-9").crossJoin(F.broadcast(cell)).withColumn("at", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi") - 1e-9))))
    line = line.withColumn("first", place(F.col("lo")) == F.col("at"))
    a, b = (line.select("ux", "uy", "off", "at", F.col("node_id").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"), F.col("first").alias(f"first_{n}")) for n in ("src", "dst"))
    over = F.least("hi_src", "hi_dst") - F.greatest("lo_src", "lo_dst")
    sides = a.join(b, ["ux", "uy", "off", "at"]).filter("src < dst").filter("first_src or first_dst").select("src", "dst", over.alias("w")).filter("w > 1e-9")
    if queen:
        # a corner that two rings of a node share comes twice, which adds another 0
        p = polygons.select("node_id", F.explode(F.array_distinct("ring")).alias("p"))
        p, q = p.select(F.col("node_id").alias("src"), "p"), p.select(F.col("node_id").alias("dst"), "p")
        sides = sides.unionAll(p.join(q, "p").filter("src < dst").select("src", "dst", F.lit(0.0).alias("w")))
    return sides.groupBy("src", "dst").agg(F.sum("w").alias("shared_perim"))


def boundary_perimeters(polygons: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, perimeter, boundary_perim, boundary_node): what of a ring no neighbour shares, and
    whether it has such a stretch or touches one at a corner."""
    polygons = dealt(polygons)
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    whole = segments(polygons).groupBy("node_id").agg(F.sum(length).alias("perimeter"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "shared_perim").groupBy("node_id").agg(F.sum("shared_perim").alias("inner"))
    t = whole.join(ends, "node_id", "left").withColumn("boundary_perim", F.round(F.col("perimeter") - F.coalesce("inner", F.lit(0.0)), 9))
    outer = t.filter("boundary_perim > 0").select("node_id")
    corner = polygons.join(outer, "node_id").select(F.explode("ring").alias("p"))
    one = segments(polygons).groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).filter("n = 1").select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).join(corner, "p", "left_semi").distinct()
    touch = polygons.select("node_id", F.explode("ring").alias("p")).join(one, "p", "left_semi").select("node_id").distinct().withColumn("touch", F.lit(True))
    return t.join(touch, "node_id", "left").select("node_id", "perimeter", "boundary_perim", ((F.col("boundary_perim") > 0) | F.coalesce("touch", F.lit(False))).alias("boundary_node"))


def utm_zone(lon: Column, lat: Column) -> Column:
    """The zone number of a point: six degrees each, but for the south-west of Norway (32) and
    Svalbard (31, 33, 35, 37)."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    north = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when(norway, 32).when(north, svalbard).otherwise(plain).cast("int")


def common_zone(points: DataFrame) -> DataFrame:
    """(zone): that of most points (lon, lat); of equal ones the least."""
    n = points.groupBy(utm_zone(F.col("lon"), F.col("lat")).alias("zone")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("zone", F.struct("n", -F.col("zone"))).alias("zone"))
