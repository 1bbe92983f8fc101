"""Planar geometry as column arithmetic and grid-cell equi-joins.

Points are (x, y), links are segments (x1, y1, x2, y2), polygons are arrays of
struct(x, y). Candidates share a grid cell; the exact predicate follows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, salted_join, scalar_join
from ..session import pin
from .filters import in_box

C = F.col


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def segment_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the row's segment."""
    dx, dy = C("x2") - C("x1"), C("y2") - C("y1")
    along = F.try_divide((x - C("x1")) * dx + (y - C("y1")) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return distance(x, y, C("x1") + t * dx, C("y1") + t * dy)


def hausdorff(x: Column, y: Column) -> Column:
    """Largest distance from a point to the row's segment."""
    return F.greatest(distance(x, y, C("x1"), C("y1")), distance(x, y, C("x2"), C("y2")))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size))


def _box_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float
               ) -> DataFrame:
    return (df.withColumn("_cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size))))
            .withColumn("_cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size)))))


def segment_cells(links: DataFrame, reach: float, size: float) -> DataFrame:
    """Grid cells within ``reach`` of each segment, one row per (link, cell).

    Column by column of the grid, only the rows of cells beside the part of the segment that
    runs through the column are made, so cells are linear in the length of a segment.
    """
    lo_x, hi_x = F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach
    columns = links.withColumn("_cx", F.explode(F.sequence(_cell(lo_x, size), _cell(hi_x, size))))
    dx, dy = C("x2") - C("x1"), C("y2") - C("y1")

    def place(x: Column) -> Column:
        """Where the segment passes ``x``, from 0 to 1; a vertical one is all there."""
        return F.least(F.greatest(F.try_divide(x - C("x1"), dx), F.lit(0.0)), F.lit(1.0))
    a, b = place(C("_cx") * size - reach), place((C("_cx") + 1) * size + reach)
    ends = [F.when(dx == 0, y).otherwise(C("y1") + t * dy) for t, y in ((a, C("y1")), (b, C("y2")))]
    cells = columns.withColumn("_cy", F.explode(F.sequence(
        _cell(F.least(*ends) - reach, size), _cell(F.greatest(*ends) + reach, size))))
    center = (C("_cx") + 0.5) * size, (C("_cy") + 0.5) * size
    return cells.where(segment_distance(*center) <= reach + size * math.sqrt(0.5) + 1e-9)


def points_near_links(points: DataFrame, links: DataFrame, reach: float,
                      size: float | None = None, link: Sequence[str] = ("u", "v")) -> DataFrame:
    """All (link, point) rows with the point within ``reach`` of the link.

    A reach of 0 matches nothing. ``points`` keep their columns; ``dist`` is added.
    """
    if reach <= 0:  # before any cell is made: their number grows as the reach shrinks
        keys = [F.lit(None).cast(links.schema[k].dataType).alias(k) for k in link]
        return points.where(F.lit(False)).select(*points.columns, *keys, F.lit(0.0).alias("dist"))
    size = float(size or 4.0 * reach)
    seg = segment_cells(links.select(*link, "x1", "y1", "x2", "y2"), float(reach), size)
    placed = (points.withColumn("_cx", _cell(C("x"), size))
              .withColumn("_cy", _cell(C("y"), size)))
    near = lookup(placed, seg, ["_cx", "_cy"], "inner")
    near = near.withColumn("dist", segment_distance(C("x"), C("y")))
    return (near.where(C("dist") <= float(reach))
            .drop("_cx", "_cy", "x1", "y1", "x2", "y2"))


def count_near_links(points: DataFrame, links: DataFrame, reach: float, out: str,
                     link: Sequence[str] = ("u", "v"), size: float | None = None) -> DataFrame:
    """Number of points within ``reach`` of every link, 0 when none."""
    hits = points_near_links(points, links, reach, size, link)
    n = hits.groupBy(*link).agg(F.count(F.lit(1)).alias(out))
    return links.select(*link).join(n, list(link), "left").na.fill(0, [out])


def _cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"),
                                                       b.x.alias("bx"), b.y.alias("by")))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""
    def crosses(e: Column) -> Column:
        straddles = (e.ay > y) != (e.by > y)
        at = (e.bx - e.ax) * F.try_divide(y - e.ay, e.by - e.ay) + e.ax
        return F.when(straddles & (x < at), 1).otherwise(0)
    total = F.aggregate(F.transform(_edges(ring), crosses), F.lit(0), lambda s, k: s + k)
    return total % 2 == 1


def segment_meets_ring(ring: Column) -> Column:
    """The row's segment has an end inside the ring or crosses one of its edges."""
    x1, y1, x2, y2 = C("x1"), C("y1"), C("x2"), C("y2")

    def crosses(e: Column) -> Column:
        d1 = _cross(e.ax, e.ay, e.bx, e.by, x1, y1)
        d2 = _cross(e.ax, e.ay, e.bx, e.by, x2, y2)
        d3 = _cross(x1, y1, x2, y2, e.ax, e.ay)
        d4 = _cross(x1, y1, x2, y2, e.bx, e.by)
        boxes = ((F.greatest(x1, x2) >= F.least(e.ax, e.bx))
                 & (F.greatest(e.ax, e.bx) >= F.least(x1, x2))
                 & (F.greatest(y1, y2) >= F.least(e.ay, e.by))
                 & (F.greatest(e.ay, e.by) >= F.least(y1, y2)))
        return boxes & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)

    return (point_in_ring(x1, y1, ring) | point_in_ring(x2, y2, ring)
            | F.exists(_edges(ring), crosses))


def links_in_polygons(links: DataFrame, blocks: DataFrame, attrs: Sequence[str], size: float,
                      block_id: str = "block_id", link: Sequence[str] = ("u", "v"),
                      scale: float = 1.0) -> DataFrame:
    """Attributes of the polygon a link touches, the largest ``block_id`` winning.

    Values are multiplied by ``scale``; links without a polygon get the mean of all
    polygons.
    """
    low = lambda f: F.array_min(F.transform("ring", lambda p: p[f]))
    high = lambda f: F.array_max(F.transform("ring", lambda p: p[f]))
    tiles = _box_cells(blocks, low("x"), low("y"), high("x"), high("y"), size)
    seg = segment_cells(links.select(*link, "x1", "y1", "x2", "y2"), 0.0, size)
    # cells only pair ids; each pair is tested once, and rings are not copied to cells
    pairs = lookup(seg.select(*link, "_cx", "_cy"), tiles.select(block_id, "_cx", "_cy"), ["_cx", "_cy"], "inner")
    pairs = pairs.select(*link, block_id).distinct()
    ends = salted_join(pairs, blocks.select(block_id, "ring", *attrs), [block_id], "inner")
    hit = ends.join(links.select(*link, "x1", "y1", "x2", "y2"), list(link)).where(segment_meets_ring(C("ring")))
    best = hit.groupBy(*link).agg(*[F.max_by(C(a) * F.lit(float(scale)), C(block_id)).alias(a)
                                    for a in attrs])
    out = links.select(*link).join(best, list(link), "left")
    out = scalar_join(out, {f"_m_{a}": F.avg(C(a) * F.lit(float(scale))) for a in attrs}, blocks)
    for a in attrs:
        out = out.withColumn(a, F.coalesce(a, f"_m_{a}")).drop(f"_m_{a}")
    return out


def cardinal(links: DataFrame) -> DataFrame:
    """Direction letters, length and share of each axis in the extent of a link."""
    dx, dy = C("x2") - C("x1"), C("y2") - C("y1")
    span = F.abs(dx) + F.abs(dy)
    return (links.withColumn("ns", F.when(dy > 0, "N").otherwise("S"))
            .withColumn("ew", F.when(dx > 0, "E").otherwise("W"))
            .withColumn("crs_distance", F.sqrt(dx * dx + dy * dy))
            .withColumn("ns_confidence", F.coalesce(F.try_divide(F.abs(dy), span), F.lit(0.0)))
            .withColumn("ew_confidence", F.coalesce(F.try_divide(F.abs(dx), span), F.lit(0.0))))


def match_segments(links: DataFrame, segments: DataFrame, reach: float,
                   link: Sequence[str] = ("u", "v"), size: float | None = None) -> DataFrame:
    """Probe segment near a link's middle that runs most clearly in its direction.

    ``segments`` have segment_id, bearing and x1..y2. Ties go to the smaller id; links
    without a match keep NULL.
    """
    mids = cardinal(links).select(
        *link, "ns", "ew", "ns_confidence", "ew_confidence",
        ((C("x1") + C("x2")) / 2).alias("x"), ((C("y1") + C("y2")) / 2).alias("y"))
    near = points_near_links(mids, segments.withColumnRenamed("segment_id", "_seg"), reach,
                             size, ["_seg", "bearing"])
    conf = F.when(C("bearing") == C("ns"), C("ns_confidence")).when(
        C("bearing") == C("ew"), C("ew_confidence"))
    near = near.withColumn("confidence", conf).where(C("confidence") > 0)
    best = near.groupBy(*link).agg(F.min(F.struct((-C("confidence")).alias("c"),
                                                  C("_seg").alias("s"))).alias("_b"))
    best = best.select(*link, C("_b.s").alias("segment_id"), (-C("_b.c")).alias("confidence"))
    return links.select(*link).join(best, list(link), "left")


def _finite(*names: str) -> Column:
    """All of the columns are numbers: not NULL, NaN or infinite."""
    good = F.lit(True)
    for n in names:
        good = good & C(n).isNotNull() & ~F.isnan(C(n).cast("double")) & (F.abs(n) < float("inf"))
    return good


def nearest_link(stations: DataFrame, links: DataFrame, first_reach: float,
                 station: str = "station_id", link: Sequence[str] = ("u", "v")) -> DataFrame:
    """Link with the smallest Hausdorff distance to each station, without all pairs.

    A link's middle is never farther than its Hausdorff distance, so a station whose
    best candidate within the reach lies within the reach is settled; the rest search
    again at twice the reach. Stations and links without finite coordinates are left out,
    so a reach beyond all of the others ends the search.
    """
    links = links.where(_finite("x1", "y1", "x2", "y2"))
    mids = links.select(*link, "x1", "y1", "x2", "y2",
                        ((C("x1") + C("x2")) / 2).alias("_mx"),
                        ((C("y1") + C("y2")) / 2).alias("_my"))
    placed = stations.select(station, "x", "y").where(_finite("x", "y"))
    todo, reach, found = placed, float(first_reach), None
    if links.limit(1).count() == 0:
        raise ValueError("no links to match")
    while True:
        tiles = (todo.withColumn("_cx", F.explode(F.sequence(_cell(C("x"), reach) - 1,
                                                             _cell(C("x"), reach) + 1)))
                 .withColumn("_cy", F.explode(F.sequence(_cell(C("y"), reach) - 1,
                                                         _cell(C("y"), reach) + 1))))
        at = mids.withColumn("_cx", _cell(C("_mx"), reach)).withColumn("_cy",
                                                                      _cell(C("_my"), reach))
        near = lookup(tiles, at, ["_cx", "_cy"], "inner").withColumn(
            "dist", hausdorff(C("x"), C("y"))).where(C("dist") <= reach)
        best = near.groupBy(station).agg(
            F.min(F.struct("dist", *link)).alias("_b")).select(station, "_b.*")
        best = pin(best)
        found = best if found is None else found.unionByName(best)
        todo = pin(todo.join(best.select(station), station, "left_anti"))
        if todo.limit(1).count() == 0:
            break
        reach *= 2.0
    return found


def match_stations(stations: DataFrame, links: DataFrame, first_reach: float,
                   station: str = "station_id", link: Sequence[str] = ("u", "v")) -> DataFrame:
    """One link per station and one station per link: the closest pair wins on each side."""
    near = nearest_link(stations, links, first_reach, station, link)
    best = near.groupBy(*link).agg(F.min(F.struct("dist", station)).alias("_b"))
    return best.select(C(f"_b.{station}").alias(station), *link, C("_b.dist").alias("dist"))


def inside_extent(points: DataFrame, links: DataFrame) -> DataFrame:
    """Points strictly inside the bounding box of all link ends."""
    box = {"_x0": F.min(F.least("x1", "x2")), "_x1": F.max(F.greatest("x1", "x2")),
           "_y0": F.min(F.least("y1", "y2")), "_y1": F.max(F.greatest("y1", "y2"))}
    out = scalar_join(points, box, links)
    return out.where((C("x") > C("_x0")) & (C("x") < C("_x1"))
                     & (C("y") > C("_y0")) & (C("y") < C("_y1"))).drop(*box)


def mirror(nodes: DataFrame, axis: str) -> DataFrame:
    """Reflect one coordinate around its maximum."""
    out = scalar_join(nodes, {"_top": F.max(axis)})
    return out.withColumn(axis, 2 * C("_top") - C(axis)).drop("_top")


def rotate(nodes: DataFrame, degrees: float, origin: tuple[float, float] = (0.0, 0.0),
           box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Turn counter-clockwise around ``origin``, only inside ``box`` when given."""
    # right angles are exact
    exact = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    a = math.radians(degrees)
    cos, sin = exact.get(degrees % 360, (math.cos(a), math.sin(a)))
    ox, oy = map(float, origin)
    rx, ry = C("x") - ox, C("y") - oy
    nx, ny = rx * cos - ry * sin + ox, rx * sin + ry * cos + oy
    if box is not None:
        hit = in_box("x", "y", box)
        nx, ny = F.when(hit, nx).otherwise(C("x")), F.when(hit, ny).otherwise(C("y"))
    return nodes.withColumns({"x": nx, "y": ny})


def rescale(nodes: DataFrame, factor: float) -> DataFrame:
    return nodes.withColumns({"x": C("x") * float(factor), "y": C("y") * float(factor)})


def shift_to_base(nodes: DataFrame, base_node: int, target: tuple[float, float],
                  box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Move nodes so that ``base_node`` lands on ``target``, only inside ``box`` when given."""
    base = nodes.where(C("node") == base_node)
    out = scalar_join(nodes, {"_bx": F.first("x"), "_by": F.first("y")}, base)
    nx, ny = C("x") + float(target[0]) - C("_bx"), C("y") + float(target[1]) - C("_by")
    if box is not None:
        hit = in_box("x", "y", box)
        nx, ny = F.when(hit, nx).otherwise(C("x")), F.when(hit, ny).otherwise(C("y"))
    return out.withColumns({"x": nx, "y": ny}).drop("_bx", "_by")


def nodes_from_links(links: DataFrame) -> DataFrame:
    """Node positions from link ends; an end position wins over a start position."""
    ends = links.select(F.explode(F.array(
        F.struct(C("u").alias("node"), F.lit(0).alias("rank"), C("x1").alias("x"),
                 C("y1").alias("y")),
        F.struct(C("v").alias("node"), F.lit(1).alias("rank"), C("x2").alias("x"),
                 C("y2").alias("y")))).alias("e")).select("e.*")
    top = ends.groupBy("node").agg(F.max(F.struct("rank", "x", "y")).alias("_t"))
    return top.select("node", "_t.x", "_t.y")


# Zone of the projected system used for buffers in feet: GRS80 ellipsoid, two standard
# parallels, false origin in metres, US survey foot. Fixed values of EPSG 2228.
ZONE = {"a": 6378137.0, "f": 1 / 298.257222101, "lat1": 37.25, "lat2": 36.0,
        "lat0": 35.0 + 1.0 / 3.0, "lon0": -119.0, "fe": 2000000.0, "fn": 500000.0,
        "unit": 1200.0 / 3937.0}


def project(points: DataFrame, lon: str = "lon", lat: str = "lat",
            zone: dict[str, float] = ZONE) -> DataFrame:
    """Longitude and latitude in degrees to projected x, y (Lambert conformal conic)."""
    e = math.sqrt(2 * zone["f"] - zone["f"] ** 2)

    def m_(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t_(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p1, p2, p0 = (math.radians(zone[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m_(p1)) - math.log(m_(p2))) / (math.log(t_(p1)) - math.log(t_(p2)))
    big = m_(p1) / (n * t_(p1) ** n)
    rho0 = zone["a"] * big * t_(p0) ** n
    s = F.lit(e) * F.sin(F.radians(lat))
    t = F.tan(F.lit(math.pi / 4) - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho = F.lit(zone["a"] * big) * F.pow(t, F.lit(n))
    turn = F.lit(n) * F.radians(C(lon) - F.lit(zone["lon0"]))
    return points.withColumns({
        "x": (F.lit(zone["fe"]) + rho * F.sin(turn)) / F.lit(zone["unit"]),
        "y": (F.lit(zone["fn"]) + F.lit(rho0) - rho * F.cos(turn)) / F.lit(zone["unit"])})


def points_from_lonlat(df: DataFrame, lon: str, lat: str, projected: bool = False) -> DataFrame:
    """Point columns from text or numeric degrees; unreadable ones become NULL."""
    out = df.withColumns({"x": C(lon).try_cast("double"), "y": C(lat).try_cast("double")})
    return project(out, "x", "y") if projected else out


def edge_lengths(links: DataFrame, nodes: DataFrame, link: Sequence[str] = ("u", "v")) -> DataFrame:
    """Straight length of each link from its node positions."""
    a = nodes.select(C("node").alias("u"), C("x").alias("x1"), C("y").alias("y1"))
    b = nodes.select(C("node").alias("v"), C("x").alias("x2"), C("y").alias("y2"))
    both = lookup(lookup(links.select(*link), a, "u", "inner"), b, "v", "inner")
    return both.select(*link, distance(C("x1"), C("y1"), C("x2"), C("y2")).alias("euclidean"))


def as_line_text(links: DataFrame, out: str = "wkt") -> DataFrame:
    return links.withColumn(out, F.format_string("LINESTRING(%.6f %.6f, %.6f %.6f)",
                                                 "x1", "y1", "x2", "y2"))


def as_point_text(nodes: DataFrame, out: str = "wkt") -> DataFrame:
    return nodes.withColumn(out, F.format_string("POINT(%.6f %.6f)", "x", "y"))
