"""Polygons of maps: vector files, validity, overlaps, range joins of boxes, projection.

A polygon is one row (node_id, ring) for each of its rings, an array of (x, y); multipolygons and
holes are further rows of a node. Rings may be open or closed. Null or empty rings have no sides.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import GraphError, adjacency, boundary_perimeters, common_zone, join_table, polygon_area

RING = "array<struct<x:double,y:double>>"

# ------------------------------------------------------------------------------ vector files


def _rings(points: Column) -> Column:
    return F.transform(points, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def rings_of(geometry: Column) -> Column:
    """All rings of a GeoJSON geometry text, of polygons and multipolygons; null for other types."""
    kind = F.get_json_object(geometry, "$.type")
    at = F.get_json_object(geometry, "$.coordinates")
    one = _rings(F.from_json(at, "array<array<array<double>>>"))
    many = _rings(F.flatten(F.from_json(at, "array<array<array<array<double>>>>")))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def read_geojson(spark: SparkSession, path: str, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(attributes, polygons) of GeoJSON features, one a line, or of a collection in one file.
    `schema` names the properties, `key` that one which is the node's id."""
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", "features array<string>")["features"].alias("f"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    f = whole.select(F.explode(F.coalesce("f", lines)).alias("f"))
    f = f.select(F.from_json(F.get_json_object("f", "$.properties"), schema).alias("p"), F.get_json_object("f", "$.geometry").alias("g"))
    attributes = f.select(F.col(f"p.{key}").alias("node_id"), "p.*")
    return attributes, f.select(F.col(f"p.{key}").alias("node_id"), F.explode(rings_of(F.col("g"))).alias("ring"))


def to_geojson(ring: Column) -> Column:
    """A ring as the text of a GeoJSON polygon, closed."""
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def without_geometries(nodes: DataFrame) -> DataFrame:
    """The nodes without the columns that hold rings."""
    return nodes.drop(*[c for c, t in nodes.dtypes if t == RING])


def shape_rings(data: bytes):
    """(record, rings) of a shapefile's polygons: each ring an (n, 2) array; null shapes have none."""
    at, record = 100, 0
    while at + 12 <= len(data):
        _, words = struct.unpack_from(">ii", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        rings = []
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<ii", data, at + 44)
            starts = np.frombuffer(data, "<i4", n_parts, at + 52).tolist() + [n_points]
            points = np.frombuffer(data, "<f8", 2 * n_points, at + 52 + 4 * n_parts).reshape(-1, 2)
            rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind:
            raise GraphError(f"shape type {kind} is no polygon")
        yield record, rings
        at += 8 + 2 * words
        record += 1


def table_rows(data: bytes, encoding: str = "utf-8"):
    """Rows of a shapefile's attribute table, as dicts of stripped text; blanks are None."""
    n, head, size = struct.unpack_from("<ihh", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[at : at + width].decode(encoding, "replace").strip(" \0") or None
            at += width
        yield row


def read_shapefile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(attributes, polygons) of `path`.shp and `path`.dbf: node_id is the record's number from 0, the
    attributes a map of text. A format of at most 2 GB a file, so each is read in one task."""

    def shapes(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = [(i, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, rings in shape_rings(data) for ring in rings]
                yield pd.DataFrame(rows, columns=["node_id", "ring"])

    def table(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame(enumerate(table_rows(data)), columns=["node_id", "attributes"])

    read = lambda end: spark.read.format("binaryFile").load(f"{path}.{end}").select("content")
    return read("dbf").mapInPandas(table, "node_id long, attributes map<string,string>"), read("shp").mapInPandas(shapes, f"node_id long, ring {RING}")


def graph_of(polygons: DataFrame, attributes: DataFrame | None = None, queen: bool = False, ignore_errors: bool = False, project: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes with area, boundary and attributes, and rook or queen edges, of a map's polygons. Invalid
    rings are an error unless ignored; `project` takes longitudes and latitudes to metres first."""
    if not ignore_errors and (bad := invalid(polygons).limit(10).collect()):
        raise GraphError("invalid rings: " + ", ".join(f"{r['node_id']} ({r['reason']})" for r in bad))
    polygons = reprojected(polygons) if project else polygons
    edges = adjacency(polygons, queen)
    turn = F.when(signed_area(F.col("ring")) > 0, -1).otherwise(1)
    # holes run against their outer ring, which is the larger one
    area = polygons.select("node_id", (turn * polygon_area(F.col("ring"))).alias("a")).groupBy("node_id").agg(F.abs(F.sum("a")).alias("area"))
    nodes = area.join(boundary_perimeters(polygons, edges), "node_id", "left")
    return (join_table(nodes, attributes, "node_id", "node_id") if attributes is not None else nodes), edges


# -------------------------------------------------------------------------- validity, overlaps


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if the ring runs against the clock."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def ring_fault(x: np.ndarray, y: np.ndarray) -> str | None:
    """Why a ring is invalid: too few points, a coordinate that is no number, or sides that meet
    elsewhere than at a shared corner. Sides are met in order of their left ends."""
    p = np.stack([x, y], 1).astype(float)
    if not np.isfinite(p).all():
        return "Invalid Coordinate"
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    p = p[np.r_[True, (p[1:] != p[:-1]).any(1)]] if len(p) else p
    if len(p) < 3:
        return "Too few points in geometry component"
    if len(np.unique(p, axis=0)) < len(p):
        return "Ring Self-intersection"
    q = np.roll(p, -1, 0)
    n, left, right = len(p), np.minimum(p[:, 0], q[:, 0]), np.maximum(p[:, 0], q[:, 0])
    order = np.argsort(left, kind="stable")
    ends = np.searchsorted(left[order], right, side="right")
    turn = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    within = lambda a, b, c: (np.minimum(a, b) <= c).all(-1) & (c <= np.maximum(a, b)).all(-1)
    for rank, i in enumerate(order.tolist()):
        js = order[rank + 1 : ends[i]]
        if not len(js):
            continue
        a, b, c, d = p[i], q[i], p[js], q[js]
        t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        next_, before = js == (i + 1) % n, js == (i - 1) % n
        far = ~(next_ | before)
        meet = (t1 * t2 < 0) & (t3 * t4 < 0) | (t1 == 0) & within(a, b, c) | (t2 == 0) & within(a, b, d) | (t3 == 0) & within(c, d, a) | (t4 == 0) & within(c, d, b)
        if (far & meet).any():
            return "Self-intersection"
        # neighbours share a corner; they fault only where one folds back on the other
        fold = next_ & (t2 == 0) & (((d - b) * (a - b)).sum(-1) > 0) | before & (t1 == 0) & (((c - a) * (b - a)).sum(-1) > 0)
        if fold.any():
            return "Self-intersection"
    return None


#: Rings of up to this many corners are checked side by side; of longer ones each is swept alone.
SHORT = 64


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All corners of rings, one after the other, and where each ring begins; null rings are empty."""
    n = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten())
    return np.stack([x, y], 1), np.r_[0, np.cumsum(n)]


def _sides_meet(p: np.ndarray) -> np.ndarray:
    """Which of many rings (m, n, 2) have sides that meet elsewhere than at a shared corner; as
    `ring_fault`, over all pairs of sides whose ranges of x meet."""
    n, q = p.shape[1], np.roll(p, -1, 1)
    order = np.argsort(np.minimum(p[..., 0], q[..., 0]), axis=1, kind="stable")
    p, q = (np.take_along_axis(c, order[..., None], 1) for c in (p, q))
    r, t = np.triu_indices(n, 1)
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((c[:, k, 0], c[:, k, 1]) for k, c in ((r, p), (r, q), (t, p), (t, q)))
    turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    within = lambda ax, ay, bx, by, cx, cy: (np.minimum(ax, bx) <= cx) & (cx <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= cy) & (cy <= np.maximum(ay, by))
    t1, t2, t3, t4 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy), turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    i, j = order[:, r], order[:, t]
    next_, before = j == (i + 1) % n, j == (i - 1) % n
    meet = (t1 * t2 < 0) & (t3 * t4 < 0) | (t1 == 0) & within(ax, ay, bx, by, cx, cy) | (t2 == 0) & within(ax, ay, bx, by, dx, dy) | (t3 == 0) & within(cx, cy, dx, dy, ax, ay) | (t4 == 0) & within(cx, cy, dx, dy, bx, by)
    fold = next_ & (t2 == 0) & ((dx - bx) * (ax - bx) + (dy - by) * (ay - by) > 0) | before & (t1 == 0) & ((cx - ax) * (bx - ax) + (cy - ay) * (by - ay) > 0)
    near = np.minimum(cx, dx) <= np.maximum(ax, bx)
    return (near & (~(next_ | before) & meet | fold)).any(1)


def ring_faults(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`ring_fault` of many rings, whose corners lie one after the other."""
    m = len(starts) - 1
    ring, n = np.repeat(np.arange(m), np.diff(starts)), np.diff(starts)
    why = np.full(m, None, object)
    bad = np.zeros(m, bool)
    bad[ring[~np.isfinite(points).all(1)]] = True
    why[bad] = "Invalid Coordinate"
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != points[:-1]).any(1) | (ring[1:] != ring[:-1])
    many = np.flatnonzero(n > 1)
    first, last = starts[:-1][many], starts[1:][many] - 1
    keep[last[(points[first] == points[last]).all(1)]] = False
    points, n = points[keep], np.bincount(ring[keep], minlength=m)
    starts = np.r_[0, np.cumsum(n)]
    why[~bad & (n < 3)] = "Too few points in geometry component"
    for k in np.unique(n[~bad & (n >= 3)]).tolist():
        same = np.flatnonzero(~bad & (n == k))
        if k > SHORT:
            for i in same.tolist():
                why[i] = ring_fault(*points[starts[i] : starts[i + 1]].T)
            continue
        size = max(1, 1_000_000 // (k * k))
        for at in (same[i : i + size] for i in range(0, len(same), size)):
            p = points[starts[at][:, None] + np.arange(k)]
            r, t = np.triu_indices(k, 1)
            twice = (p[:, r] == p[:, t]).all(-1).any(1)
            why[at[_sides_meet(p)]] = "Self-intersection"
            why[at[twice]] = "Ring Self-intersection"
    return why


def invalid(polygons: DataFrame) -> DataFrame:
    """(node_id, reason) of invalid rings."""

    def run(batches):
        for batch in batches:
            why = pa.array(ring_faults(*_points(batch["ring"])), pa.string())
            yield pa.RecordBatch.from_arrays([batch["node_id"], why], ["node_id", "reason"]).filter(pc.is_valid(why))

    return polygons.select(F.col("node_id").cast("long"), "ring").mapInArrow(run, "node_id long, reason string")


def boxes(polygons: DataFrame) -> DataFrame:
    """(node_id, x1, y1, x2, y2) of each ring."""
    lo = lambda c: F.array_min(F.transform("ring", lambda p: p[c]))
    hi = lambda c: F.array_max(F.transform("ring", lambda p: p[c]))
    return polygons.select("node_id", lo("x").alias("x1"), lo("y").alias("y1"), hi("x").alias("x2"), hi("y").alias("y2"), *[c for c in polygons.columns if c != "node_id"])


def range_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) that meet, borders included, with all columns under `l_` and
    `r_`. Boxes are dealt to the cells of a grid as wide as their mean side, the pair is made in the
    cell where its common part begins, so it comes once and no cell holds all boxes."""
    side = F.greatest(F.avg(F.col("x2") - F.col("x1")), F.avg(F.col("y2") - F.col("y1")), F.lit(1e-9))
    cell = left.select("x1", "y1", "x2", "y2").unionAll(right.select("x1", "y1", "x2", "y2")).agg(side.alias("_cell"))
    place = lambda c: F.floor(F.col(c) / F.col("_cell"))

    def dealt(d: DataFrame, tag: str) -> DataFrame:
        d = d.crossJoin(F.broadcast(cell)).withColumn("_i", F.explode(F.sequence(place("x1"), place("x2")))).withColumn("_j", F.explode(F.sequence(place("y1"), place("y2"))))
        return d.withColumnsRenamed({c: f"{tag}_{c}" for c in d.columns if c not in ("_i", "_j")})

    j = dealt(left, "l").join(dealt(right, "r"), ["_i", "_j"])
    meet = (F.col("l_x1") <= F.col("r_x2")) & (F.col("r_x1") <= F.col("l_x2")) & (F.col("l_y1") <= F.col("r_y2")) & (F.col("r_y1") <= F.col("l_y2"))
    begin = lambda c: F.floor(F.greatest(f"l_{c}1", f"r_{c}1") / F.col("l__cell"))
    return j.filter(meet & (begin("x") == F.col("_i")) & (begin("y") == F.col("_j"))).drop("_i", "_j", "l__cell", "r__cell")


def _clip(subject: list, triangle: np.ndarray) -> float:
    """Area of a convex polygon inside a triangle that runs against the clock."""
    for k in range(3):
        (ax, ay), (bx, by) = triangle[k], triangle[(k + 1) % 3]
        out, sides = [], [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        for i, (p, s) in enumerate(zip(subject, sides, strict=True)):
            q, t = subject[i - 1], sides[i - 1]
            if s * t < 0:
                f = t / (t - s)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        subject = out
        if len(subject) < 3:
            return 0.0
    return abs(sum(subject[i - 1][0] * y - x * subject[i - 1][1] for i, (x, y) in enumerate(subject))) / 2


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two simple rings have in common: each is the signed sum of triangles from one point,
    so the area is the signed sum over pairs of triangles."""
    o = (np.minimum(a.min(0), b.min(0)) + np.maximum(a.max(0), b.max(0))) / 2

    def fan(r):
        r = r - o
        for p, q in zip(r, np.roll(r, -1, 0), strict=True):
            s = p[0] * q[1] - p[1] * q[0]
            if s:
                t = np.array([(0.0, 0.0), p, q] if s > 0 else [(0.0, 0.0), q, p])
                yield np.sign(s), t, t.min(0), t.max(0)

    other = list(fan(b))
    total = sum(s * t * _clip([tuple(v) for v in x], y) for s, x, l1, h1 in fan(a) for t, y, l2, h2 in other if (l1 <= h2).all() and (l2 <= h1).all())
    whole = np.prod(np.ptp(b, axis=0))
    return abs(total) if abs(total) > 1e-12 * abs(whole) else 0.0


def _clip_many(subject: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """`_clip` of many triangles (m, 3, 2), each by its own one."""
    m, count = len(subject), np.full(len(subject), 3)
    for k in range(3):
        a, b = triangle[:, k, None], triangle[:, (k + 1) % 3, None]
        width = subject.shape[1]
        real = np.arange(width) < count[:, None]
        side = (b[..., 0] - a[..., 0]) * (subject[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (subject[..., 0] - a[..., 0])
        back = np.where(np.arange(width) > 0, np.arange(width) - 1, np.maximum(count[:, None] - 1, 0))
        q, t = np.take_along_axis(subject, back[..., None], 1), np.take_along_axis(side, back, 1)
        cross = real & (side * t < 0)
        f = np.divide(t, t - side, out=np.zeros_like(t), where=cross)
        both = np.stack([q + f[..., None] * (subject - q), subject], 2).reshape(m, 2 * width, 2)
        keep = np.stack([cross, real & (side >= 0)], 2).reshape(m, 2 * width)
        count = keep.sum(1)
        row, slot = np.nonzero(keep)
        subject = np.zeros((m, max(1, int(count.max(initial=0))), 2))
        subject[row, (np.cumsum(keep, 1) - 1)[row, slot]] = both[row, slot]
    width = subject.shape[1]
    back = np.where(np.arange(width) > 0, np.arange(width) - 1, np.maximum(count[:, None] - 1, 0))
    q = np.take_along_axis(subject, back[..., None], 1)
    each = np.where(np.arange(width) < count[:, None], q[..., 0] * subject[..., 1] - subject[..., 0] * q[..., 1], 0.0)
    return np.where(count < 3, 0.0, np.abs(each.sum(1)) / 2)


def _shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`shared_area` of many pairs of rings, (m, n, 2) and (m, k, 2)."""
    o = (np.minimum(a.min(1), b.min(1)) + np.maximum(a.max(1), b.max(1))) / 2

    def fan(r):
        p = r - o[:, None]
        q = np.roll(p, -1, 1)
        s = np.sign(p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0])
        turned = (s > 0)[..., None]
        t = np.stack([np.zeros_like(p), np.where(turned, p, q), np.where(turned, q, p)], 2)
        return s, t, t.min(2), t.max(2)

    (s, x, l1, h1), (t, y, l2, h2) = fan(a), fan(b)
    sign = s[:, :, None] * t[:, None]
    near = (l1[:, :, None] <= h2[:, None]).all(-1) & (l2[:, None] <= h1[:, :, None]).all(-1)
    m, i, j = np.nonzero(near & (sign != 0))
    total = np.abs(np.bincount(m, sign[m, i, j] * _clip_many(x[m, i], y[m, j]), len(a)))
    return np.where(total > 1e-12 * np.abs(np.prod(np.ptp(b, axis=1), axis=1)), total, 0.0)


def shared_areas(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`shared_area` of pairs of rings, both as corners one after the other and where rings begin.
    Pairs of as many corners are met together, pairs of long rings one by one."""
    (p, f), (q, g) = a, b
    n, k = np.diff(f), np.diff(g)
    area = np.zeros(len(n))
    for u, v in np.unique(np.stack([n, k], 1), axis=0).tolist():
        same = np.flatnonzero((n == u) & (k == v))
        if u * v > SHORT * SHORT:
            for i in same.tolist():
                area[i] = shared_area(p[f[i] : f[i + 1]], q[g[i] : g[i + 1]])
            continue
        size = max(1, 100_000 // max(1, u * v))
        for at in (same[i : i + size] for i in range(0, len(same), size)):
            area[at] = _shared_areas(p[f[at][:, None] + np.arange(u)], q[g[at][:, None] + np.arange(v)])
    return area


def overlaps(polygons: DataFrame) -> DataFrame:
    """(src, dst, area): pairs of nodes, src below dst, whose rings share more than a border. Holes
    run against the rings around them, so what a hole covers is taken off again."""

    def run(batches):
        for batch in batches:
            area = shared_areas(_points(batch["l_ring"]), _points(batch["r_ring"])) * batch["sign"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["l_node_id"], batch["r_node_id"], pa.array(area)], ["src", "dst", "area"])

    b = boxes(polygons.select(F.col("node_id").cast("long"), "ring").filter(F.size("ring") > 2))
    # boxes that only touch share no area
    inner = "l_node_id < r_node_id and l_x1 < r_x2 and r_x1 < l_x2 and l_y1 < r_y2 and r_y1 < l_y2"
    pairs = range_join(b, b).filter(inner).select("l_node_id", "r_node_id", "l_ring", "r_ring", (F.signum(signed_area(F.col("l_ring"))) * F.signum(signed_area(F.col("r_ring")))).alias("sign"))
    area = pairs.mapInArrow(run, "src long, dst long, area double").groupBy("src", "dst").agg(F.abs(F.sum("area")).alias("area"))
    return area.filter("area > 1e-9")


# ------------------------------------------------------------------------------- projection

# fixed values: the WGS 84 ellipsoid and the grid's scale and false origin
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in a zone, by the third-order series of the transverse Mercator projection
    (to well under a millimetre inside a zone). `south` adds the southern false northing; without
    it each point's own latitude decides."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), eta)
    north = sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), xi)
    return EAST + SCALE * radius * east, F.when(lat < 0 if south is None else south, SOUTH).otherwise(0.0) + SCALE * radius * north


def reprojected(polygons: DataFrame) -> DataFrame:
    """Rings of longitudes and latitudes in metres of the zone that most rings' middles lie in; the
    map is southern if its middle is."""
    middle = lambda c: F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size("ring")
    points = polygons.filter(F.size("ring") > 0).select(middle("x").alias("lon"), middle("y").alias("lat"))
    one = common_zone(points).crossJoin(points.agg((F.avg("lat") < 0).alias("south")))
    d = polygons.crossJoin(F.broadcast(one).withColumnsRenamed({"zone": "_zone", "south": "_south"}))

    def project(p):
        x, y = to_utm(p["x"], p["y"], F.col("_zone"), F.col("_south"))
        return F.struct(x.alias("x"), y.alias("y"))

    return d.withColumn("ring", F.transform("ring", project)).drop("_zone", "_south")

