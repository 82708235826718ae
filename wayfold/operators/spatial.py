"""Spatial operators and line matching: grids, regions, snapping, traversals and leaderboards.

Points meet lines and regions on cells of a grid, by equi joins, never all with all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, ray_crosses, segment_distance, segment_fraction
from ..functions.lineage import cut
from .tracks import so_far, track


def grid_cells(points: DataFrame, metres: float, ref_lat: float | None = None) -> DataFrame:
    """Cells of points: rounded with the point's own latitude, or floored with a fixed one."""
    north = F.col("lat") * (3.141592653589793 * EARTH_M / 180) / metres
    if ref_lat is None:
        east = F.col("lon") * (3.141592653589793 * EARTH_M / 180) * F.cos(F.radians("lat")) / metres
        return points.withColumns({"cn": F.rint(north).cast("long"), "ce": F.rint(east).cast("long")})
    east = F.col("lon") * (3.141592653589793 * EARTH_M / 180) * F.cos(F.radians(F.lit(ref_lat))) / metres
    return points.withColumns({"cn": F.floor(north), "ce": F.floor(east)})


def cell_sets(points: DataFrame, metres: float, ref_lat: float, stride: int = 1) -> DataFrame:
    return grid_cells(points.where(F.col("seq") % stride == 0), metres, ref_lat).select("activity_id", "cn", "ce").distinct()


def centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("activity_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (min_lat, min_lon, max_lat, max_lon), in square degrees."""
    h, w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(h, F.lit(0.0)) * F.greatest(w, F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(both / F.nullif(area(a) + area(b) - both, F.lit(0.0)), F.lit(0.0))


def ring_edges(regions: DataFrame) -> DataFrame:
    """Edges of ``regions(region_id, ring array<struct<lat,lon>>)``, the last to the first."""
    r = regions.where(F.size("ring") > 0).select("region_id", "ring", F.posexplode("ring").alias("i", "a"))
    b = F.element_at("ring", (F.col("i") + 1) % F.size("ring") + 1)
    return r.select("region_id", "i", F.col("a.lat").alias("alat"), F.col("a.lon").alias("alon"), b["lat"].alias("blat"), b["lon"].alias("blon"))


ACROSS = 32  #: cells of the finest level along the longer side of a region's box, at most and about
LEVELS = -4, 11  #: coarsest and finest level: a cell of level k has a side of 4 ** -k degrees


def _side(level: Column) -> Column:
    return F.pow(F.lit(4.0), -level)


def edge_rows(edges: DataFrame) -> DataFrame:
    """``edges`` of rings with the finest ``level`` of their region, and each row ``ci`` of its cells that they come near to."""
    box = edges.groupBy("region_id").agg(F.greatest(F.max("alat") - F.min("alat"), F.max("alon") - F.min("alon")).alias("long"))
    fine = F.floor(F.log(ACROSS / F.greatest("long", F.lit(1e-12))) / F.log(F.lit(4.0)))
    e = edges.join(box.select("region_id", F.least(F.greatest(fine, F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int").alias("level")), "region_id")
    side = _side(F.col("level"))
    row = lambda lat: F.floor(lat / side)
    return e.withColumn("ci", F.explode(F.sequence(row(F.least("alat", "blat") - 0.01 * side), row(F.greatest("alat", "blat") + 0.01 * side))))


def region_cover(edges: DataFrame) -> DataFrame:
    """Cells that cover each region: ``region_id, level, ci, cj, inner``; of ring edges as by ``ring_edges``.

    The finest cells of a region are 8 to 32 along the longer side of its box,
    whatever its size and its number of edges.  Those that an edge comes near
    to are edge cells.  Any other one is all inside or all outside, as its
    centre is by the parity of a ray, which meets the edges of its own row
    alone.  Sixteen inner cells of one parent become that parent.
    """
    rows = edge_rows(edges)
    side, ci = _side(F.col("level")), F.col("ci")
    slope = (F.col("blon") - F.col("alon")) / F.nullif(F.col("blat") - F.col("alat"), F.lit(0.0))
    south, north = F.least("alat", "blat"), F.greatest("alat", "blat")
    here = lambda lat: F.col("alon") + (F.greatest(south, F.least(north, lat)) - F.col("alat")) * slope
    one, two = F.coalesce(here((ci - 0.01) * side), "alon"), F.coalesce(here((ci + 1.01) * side), "blon")
    column = lambda lon: F.floor(lon / side)
    touched = rows.select("region_id", "level", "ci", F.explode(F.sequence(column(F.least(one, two) - 0.01 * side), column(F.greatest(one, two) + 0.01 * side))).alias("cj")).distinct()
    # cells between the first and the last edge cell of a row; beyond, all is outside
    spans = touched.groupBy("region_id", "level", "ci").agg(F.min("cj").alias("from"), F.max("cj").alias("to"))
    between = spans.select("region_id", "level", "ci", F.explode(F.sequence("from", "to")).alias("cj")).join(touched, ["region_id", "level", "ci", "cj"], "left_anti")
    centre = (ci + 0.5) * side, (F.col("cj") + 0.5) * side
    crossing = ray_crosses(*centre, F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    inner = between.join(rows, ["region_id", "level", "ci"]).groupBy("region_id", "level", "ci", "cj").agg(F.count_if(crossing).alias("n")).where("n % 2 = 1").drop("n")
    # by parent and its parent; the keys of the one hold those of the other, so that one shuffle does for both
    above = {f"{c}{k}": F.floor(F.col(f"c{c}") / 4**k) for c in "ij" for k in (1, 2)}
    second, first = ["region_id", "i2", "j2"], ["region_id", "i2", "j2", "i1", "j1"]
    counted = inner.withColumns(above).withColumns({"n1": F.count("*").over(Window.partitionBy(*first)), "n2": F.count("*").over(Window.partitionBy(*second))})
    up = F.when(F.col("n2") == 256, 2).when(F.col("n1") == 16, 1).otherwise(0)
    pick = lambda c: F.when(F.col("up") == 2, F.col(f"{c}2")).when(F.col("up") == 1, F.col(f"{c}1")).otherwise(F.col(f"c{c}")).alias(f"c{c}")
    inner = counted.withColumn("up", up).select("region_id", (F.col("level") - F.col("up")).alias("level"), pick("i"), pick("j")).distinct()
    return inner.withColumn("inner", F.lit(True)).unionByName(touched.withColumn("inner", F.lit(False)))


def points_in_regions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points inside each region, by the parity of a ray's crossings.

    A point meets the cells of the regions' covers, of each size that occurs.
    In an inner cell that is all; in an edge cell its ray meets the edges of
    the cell's row.
    """
    edges = edges.select("region_id", "alat", "alon", "blat", "blon")
    cover = cut(region_cover(edges))
    levels = sorted(r.level for r in cover.select("level").distinct().collect())  # twenty at most
    if not levels:
        return points.select("activity_id", "seq").withColumn("region_id", F.lit(None).cast(edges.schema["region_id"].dataType)).where("false")
    p = points.select("activity_id", "seq", "lat", "lon").withColumn("level", F.explode(F.array(*(F.lit(k).cast("int") for k in levels))))
    side = _side(F.col("level"))
    p = p.withColumns({"ci": F.floor(F.col("lat") / side), "cj": F.floor(F.col("lon") / side)})
    met = p.join(cover, ["level", "ci", "cj"])
    crossing = ray_crosses(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    near = met.where("NOT inner").join(edge_rows(edges), ["region_id", "level", "ci"]).groupBy("activity_id", "seq", "region_id").agg(F.count_if(crossing).alias("n")).where("n % 2 = 1")
    return met.where("inner").select("activity_id", "seq", "region_id").unionByName(near.drop("n"))


def region_tags(points: DataFrame, edges: DataFrame, share: float = 0.15) -> DataFrame:
    """Regions that hold max(1, int(n * share)) points of a track or more."""
    inside = points_in_regions(points, edges).groupBy("activity_id", "region_id").agg(F.count("*").alias("inside"))
    total = points.groupBy("activity_id").agg(F.count("*").alias("total"))
    return inside.join(total, "activity_id").where(F.col("inside") >= F.greatest(F.lit(1), F.floor(F.col("total") * share))).select("activity_id", "region_id", "inside")


_DEGREE = 3.141592653589793 * EARTH_M / 180


def _band(lat: Column, side: float) -> Column:
    return F.floor(lat / side)


def _narrowest(band: Column, side: float, reach: float) -> Column:
    """Cosine of the latitude, within ``reach`` degrees of a band, that is nearest to a pole."""
    return F.cos(F.radians(F.least((F.greatest(F.abs(band), F.abs(band + 1))) * side + reach, F.lit(89.9))))


def registered(segments: DataFrame, metres: float) -> DataFrame:
    """``segments(..., alat, alon, blat, blon)`` with each cell ``ci, cj``, of twice ``metres``, that a point within ``metres`` of the segment can be in.

    A segment is registered along its course: in each band of latitude that it
    comes near to, in the cells of the part of it that runs there, so that a
    long oblique one has as many cells as it has length, not as its box has area.
    """
    side, reach = 2 * metres / _DEGREE, metres / _DEGREE
    at = lambda pick, c: pick(f"a{c}", f"b{c}")
    s = segments.withColumn("ci", F.explode(F.sequence(_band(at(F.least, "lat") - reach, side), _band(at(F.greatest, "lat") + reach, side))))
    slope = (F.col("blon") - F.col("alon")) / F.nullif(F.col("blat") - F.col("alat"), F.lit(0.0))
    here = lambda edge: F.col("alon") + (F.greatest(at(F.least, "lat"), F.least(at(F.greatest, "lat"), edge)) - F.col("alat")) * slope
    one, two = F.coalesce(here(F.col("ci") * side - reach), "alon"), F.coalesce(here((F.col("ci") + 1) * side + reach), "blon")
    cosine = _narrowest(F.col("ci"), side, reach)
    cell = lambda lon: F.floor(lon * cosine / side)
    # the reach once more, for the rounding of the interpolation
    return s.withColumn("cj", F.explode(F.sequence(cell(F.least(one, two) - 1.01 * reach / cosine), cell(F.greatest(one, two) + 1.01 * reach / cosine))))


def _placed(points: DataFrame, metres: float) -> DataFrame:
    """``points`` that have a place, with their cell as by ``registered``, and the metres of a degree of longitude there."""
    side, reach = 2 * metres / _DEGREE, metres / _DEGREE
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("ci", _band(F.col("lat"), side)).withColumn("cj", F.floor(F.col("lon") * _narrowest(F.col("ci"), side, reach) / side))
    return p.withColumn("_k", F.cos(F.radians("lat")) * F.lit(_DEGREE))


def _met(placed: DataFrame, segments: DataFrame, metres: float, *within: str, radius: Column | None = None) -> DataFrame:
    """Pairs that may be within ``metres``, or within ``radius``, which is less, by plain arithmetic: the segment's box, and a cross product for the distance from its whole line.

    What a segment alone decides is computed there, and no place is null: what
    is left for a pair must stay so short that the JVM compiles it.
    """
    s = registered(segments.where("alat IS NOT NULL AND alon IS NOT NULL AND blat IS NOT NULL AND blon IS NOT NULL"), metres)
    s = s.withColumns({"_dx": F.col("blon") - F.col("alon"), "_dy": F.col("blat") - F.col("alat"), "_s": F.least("alat", "blat"), "_n": F.greatest("alat", "blat"), "_w": F.least("alon", "blon"), "_e": F.greatest("alon", "blon")})
    k, m, far = F.col("_k"), F.lit(_DEGREE), 1.01 * (F.lit(metres) if radius is None else radius)
    cross = ((F.col("alon") - F.col("lon")) * F.col("_dy") - (F.col("alat") - F.col("lat")) * F.col("_dx")) * k * m
    size = (F.col("_dx") * k) * (F.col("_dx") * k) + (F.col("_dy") * m) * (F.col("_dy") * m)
    tall = ((F.col("_s") - F.col("lat")) * m <= far) & ((F.col("lat") - F.col("_n")) * m <= far)
    wide = ((F.col("_w") - F.col("lon")) * k <= far) & ((F.col("lon") - F.col("_e")) * k <= far)
    return placed.join(s, ["ci", "cj", *within]).where(tall & wide & (F.abs(cross) <= F.sqrt(size) * far))


def segment_pairs(points: DataFrame, segments: DataFrame, metres: float, *within: str) -> DataFrame:
    """Pairs, of equal ``within``, of ``points(..., lat, lon)`` and ``segments(..., alat, alon, blat, blon)`` with their distance ``d`` on the plane at the point and the fraction ``t`` of the segment where it is: all within ``metres``, and few beyond.

    They meet on cells of twice the distance; the distance itself is computed
    once, for those that pass ``_met``.
    """
    d, t = _apart()
    return _met(_placed(points, metres), segments, metres, *within).withColumns({"d": d, "t": t}).drop("ci", "cj", "alat", "alon", "blat", "blon", "_k", "_dx", "_dy", "_s", "_n", "_w", "_e")


def _apart() -> tuple[Column, Column]:
    """Distance of a pair on the plane at its point, and the fraction of the segment."""
    # the cosine first: many points lie on a line or its end to the last bits, and the nearest of several lines hangs on them
    xy = lambda a: ((F.col(f"{a}lon") - F.col("lon")) * F.cos(F.radians("lat")) * F.lit(_DEGREE), (F.col(f"{a}lat") - F.col("lat")) * F.lit(_DEGREE))
    ends = F.lit(0.0), F.lit(0.0), *xy("a"), *xy("b")
    return segment_distance(*ends), segment_fraction(*ends)


def _flat_square() -> Column:
    """Square of the distance of a pair that ``_met`` leaves, by plain arithmetic: its root is right to far less than a tenth of a millimetre."""
    k, m = F.col("_k"), F.lit(_DEGREE)
    ax, ay, dx, dy = (F.col("alon") - F.col("lon")) * k, (F.col("alat") - F.col("lat")) * m, F.col("_dx") * k, F.col("_dy") * m
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(size, F.lit(0.0))))).otherwise(F.lit(0.0))
    ex, ey = ax + t * dx, ay + t * dy
    return ex * ex + ey * ey


def nearest_segment(points: DataFrame, segments: DataFrame, metres: float, key: list[str], order: list[str], *within: str, at: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key`` of ``points`` with the nearest of ``segments`` within about ``metres``, of equals the first by ``order``, as a struct ``best`` of ``d``, ``order`` and ``at`` of the segment's fraction.

    A minimum of structs would sort all pairs of a point first.  The least
    square is a minimum of numbers, which needs no pair to be kept; distances
    are then computed for the few pairs that come as near, within the
    aggregate, for the code of the join must stay short.  ``key`` holds
    ``within``; points dealt by it need no further shuffle where the segments
    are broadcast.
    """
    near = _met(_placed(points.select(*key, "lat", "lon"), metres), segments, metres, *within)
    least = near.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("lat", "lon", "ci", "cj", "_k")), F.min(_flat_square()).alias("_m"))
    # wider by a tenth of a millimetre, so that rounding loses none that is as near
    bound = least.withColumn("_m", F.sqrt("_m") + 1e-4)
    d, t = _apart()
    best = F.struct(d.alias("d"), *order, *([at(t).alias("at")] if at else []))
    return _met(bound, segments, metres, *within, radius=F.col("_m")).groupBy(*key).agg(F.min(best).alias("best"))


def first_of_line(segments: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of ``segments`` with the same ends (and ``by``) the first in ``order``: all are equally far from any point, so that the others are never the nearest."""
    line = [*by, "alat", "alon", "blat", "blon"]
    rest = [*order, *(c for c in segments.columns if c not in (*line, *order))]
    return segments.groupBy(*line).agg(F.min(F.struct(*rest)).alias("_first")).select(*line, "_first.*")


def snap(points: DataFrame, ways: DataFrame, metres: float = 8.0) -> DataFrame:
    """Nearest way of each unassisted point, nearer than ``metres``; of equally near ones the first in order.

    ``ways(way_pos, name, i, alat, alon, blat, blon)``.  Only keys and
    coordinates go through the join.  Points are dealt by their own key, in a
    number of partitions that adaptive execution keeps (a few small rows of a
    point become many pairs), so that the minimum of a point's pairs needs no
    further shuffle where the ways are broadcast.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.where(~F.col("assisted")).select("activity_id", "seq", "lat", "lon").repartition(parts, "activity_id", "seq")
    lines = first_of_line(ways.select("way_pos", "name", "i", "alat", "alon", "blat", "blon"), "way_pos", "i", "name")
    best = nearest_segment(p, lines, metres, ["activity_id", "seq"], ["way_pos", "i", "name"]).where(F.col("best.d") < metres)
    return points.join(best.select("activity_id", "seq", F.col("best.name").alias("name"), F.col("best.d").alias("d"), F.col("best.way_pos").alias("way_pos")), ["activity_id", "seq"], "left")


def boxed_cells(segments: DataFrame, cell: float = 0.01, pad: float = 0.0002) -> DataFrame:
    """``segments`` with each cell ``ci, cj`` (of ``cell`` degrees) that its padded box touches: an index by boxes, for short segments."""
    span = lambda c: F.sequence(F.floor((F.least(f"a{c}", f"b{c}") - pad) / cell), F.floor((F.greatest(f"a{c}", f"b{c}") + pad) / cell))
    return segments.withColumn("ci", F.explode(span("lat"))).withColumn("cj", F.explode(span("lon")))


def near_any_segment(points: DataFrame, segments: DataFrame, metres: float, *keys: str) -> DataFrame:
    """``keys`` of ``points`` with the distance to the nearest of ``segments``, where that is at most ``metres``."""
    return segment_pairs(points, segments.select("alat", "alon", "blat", "blon").distinct(), metres).groupBy(*keys).agg(F.min("d").alias("d")).where(F.col("d") <= metres)


def majority_kinds(snapped: DataFrame, ways: DataFrame) -> DataFrame:
    """Of each name on each track the kind that most of its points were snapped to; of equals the one seen first."""
    s = snapped.where("name IS NOT NULL").join(ways.select("way_pos", "kind").distinct(), "way_pos")
    g = s.groupBy("activity_id", "name", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    return g.groupBy("activity_id", "name").agg(F.max_by("kind", F.struct("n", -F.col("seen"))).alias("kind"))


def progress(points: DataFrame, chain: DataFrame, metres: float) -> DataFrame:
    """``points(activity_id, name, seq, lat, lon)`` with a ``chain`` of their name and how far along it each is, from 0 to 1: at the nearest segment of any of the name's chains within ``metres``, the first of equals; a point without one has the last before it.

    ``chain(name, chain, place, alat, alon, blat, blon, before_m, length_m, total_m)``.
    A track that comes near to no chain of a name has chain -1 there, and no progress along it: 0.
    """
    key = ["activity_id", "name", "seq"]
    points = cut(points)  # read twice
    at = lambda t: (F.col("before_m") + t * F.col("length_m")) / F.nullif("total_m", F.lit(0.0))
    lines = first_of_line(chain, "chain", "place", by=("name",))
    # dealt as in ``snap``, for a few small rows become many pairs
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = lambda p, m: nearest_segment(p.repartition(parts, *key), lines, m, key, ["chain", "place"], "name", at=at).where(F.col("best.d") <= m)
    # most points lie near their line, and few segments do so; only those that have none there look as far as they may
    best = cut(within(points, metres / 16))
    rest = cut(points.join(best.select(*key), key, "left_anti"))
    if not rest.isEmpty():
        best = best.unionByName(within(rest, metres))
    p = points.join(best.select("activity_id", "name", "seq", F.struct(F.col("best.chain").alias("chain"), F.col("best.at").alias("at")).alias("_at")), ["activity_id", "name", "seq"], "left")
    w = Window.partitionBy("activity_id", "name").orderBy("seq")
    known = F.coalesce(F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    p = p.withColumn("_at", known)
    return p.withColumns({"chain": F.coalesce(F.col("_at.chain").cast("long"), F.lit(-1).cast("long")), "progress": F.coalesce("_at.at", F.lit(0.0))}).drop("_at")


def runs(snapped: DataFrame, least: int = 4) -> DataFrame:
    """Runs of consecutive points on one name, of ``least`` points or more; a point on none breaks them; the end is exclusive."""
    s = snapped.withColumn("new", F.when(F.col("name").eqNullSafe(F.lag("name").over(track())), 0).otherwise(1)).withColumn("run", F.sum("new").over(so_far()))
    out = s.where("name IS NOT NULL").groupBy("activity_id", "run", "name").agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.count("*").alias("n"), (F.max("dist_km") - F.min("dist_km")).alias("ridden_km"))
    return out.where(F.col("n") >= least).select("activity_id", "name", "start", "end", "n", "ridden_km")


def way_lengths(ways: DataFrame, length: Column) -> DataFrame:
    """Length of all ways of a name, and the kind of its longest."""
    per = ways.groupBy("name", "way_pos").agg(F.sum(length).alias("m"), F.first("kind").alias("kind"))
    w = Window.partitionBy("name").orderBy(F.desc("m"), "way_pos")
    return per.withColumn("r", F.row_number().over(w)).groupBy("name").agg(F.sum("m").alias("length_m"), F.max(F.when(F.col("r") == 1, F.col("kind"))).alias("kind"))


def direction(first_ele: Column, last_ele: Column, points: Column, along: Column, loop: Column, least: float = 10.0) -> Column:
    """Up or down by a difference in elevation of ``least`` metres, else forward or reverse as the line runs; around a loop always the latter; mixed for fewer than two points.

    A missing elevation counts as zero.
    """
    d = F.coalesce(last_ele, F.lit(0.0)) - F.coalesce(first_ele, F.lit(0.0))
    way = F.when(along, "forward").otherwise("reverse")
    return F.when(points < 2, "mixed").when(loop, way).when(d >= least, "up").when(d <= -least, "down").otherwise(way)


def match_rates(snapped: DataFrame) -> DataFrame:
    return snapped.groupBy("activity_id").agg(F.count("*").alias("points"), F.count("name").alias("matched"), (F.count("name") / F.count("*")).alias("rate"))


def completion(coverage: Column, both_ends: Column, whole: float = 85.0, part: float = 60.0) -> tuple[Column, Column]:
    """Whether a trail was completed, by coverage alone or by less of it and a touch of both its ends, and whether it took the touch."""
    by_ends = (coverage < whole) & (coverage >= part) & F.coalesce(both_ends, F.lit(False))
    return (coverage >= whole) | by_ends, by_ends


def summary(traversals: DataFrame, lengths: DataFrame, touched: DataFrame, least: float = 5.0) -> DataFrame:
    """Visits, ridden km and coverage (at most 100 %) of each name in each activity, and whether it was completed; below ``least`` % it goes.

    ``touched(activity_id, name, start, a, b)`` tells which ends each visit
    came near to; the ends may be touched on different visits.
    """
    g = traversals.groupBy("activity_id", "name").agg(F.count("*").alias("visits"), F.sum("ridden_km").alias("ridden_km"))
    ends = touched.groupBy("activity_id", "name").agg((F.bool_or("a") & F.bool_or("b")).alias("both_ends"))
    raw = 100 * F.col("ridden_km") / (F.col("length_m") / 1000)
    completed, by_ends = completion(F.col("raw"), F.col("both_ends"))
    rows = g.join(lengths, "name").withColumn("raw", raw).where(F.col("raw") >= least).join(ends, ["activity_id", "name"], "left")
    return rows.select("activity_id", "name", "visits", "ridden_km", F.least(F.lit(100.0), F.col("raw")).alias("coverage"), completed.alias("completed"), by_ends.alias("by_ends"))


def timeline(visits: DataFrame, lengths: DataFrame, touched: DataFrame, least_km: float = 0.05) -> DataFrame:
    """Visits of ``least_km`` or more in their order along the ride, each with its own coverage and completion."""
    raw = 100 * F.col("ridden_km") / (F.col("length_m") / 1000)
    completed, by_ends = completion(F.col("raw"), F.col("a") & F.col("b"))
    v = visits.where(F.col("ridden_km") >= least_km).join(lengths, "name").withColumn("raw", raw).join(touched, ["activity_id", "name", "start"], "left")
    w = Window.partitionBy("activity_id").orderBy("start")
    return v.select(*visits.columns, F.least(F.lit(100.0), F.col("raw")).alias("coverage"), completed.alias("completed"), by_ends.alias("by_ends")).withColumn("place", F.row_number().over(w).cast("long"))


def by_direction(entries: DataFrame) -> DataFrame:
    """Timeline entries by name and direction: visits, completions, km, best and last duration of completed ones."""
    done = lambda v: F.when(F.col("completed"), v)
    return entries.groupBy("activity_id", "name", "direction").agg(F.count("*").alias("visits"), F.count_if("completed").alias("completions"), F.sum("ridden_km").alias("ridden_km"), F.min(done(F.col("duration"))).alias("best"), F.max_by(done(F.col("duration")), done(F.col("start"))).alias("last"))


def leaderboards(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Completed, named attempts ranked by duration, then id, with the number of them."""
    w = Window.partitionBy(*by)
    return attempts.where("completed AND name IS NOT NULL").withColumns({"rank": F.row_number().over(w.orderBy("duration", "activity_id")).cast("long"), "total": F.count("*").over(w)})


def trail_index(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts and the best one of each trail; the first of equals."""
    return attempts.where("completed AND name IS NOT NULL").groupBy(*by).agg(F.count("*").alias("attempts"), F.min("duration").alias("best"), F.min_by("activity_id", F.struct("duration", "activity_id")).alias("best_id"))


def region_cards(index: DataFrame, hidden: DataFrame, lengths: DataFrame) -> DataFrame:
    """Trails of each region with whether they are hidden, and their length."""
    h = hidden.select("name").distinct().withColumn("hidden", F.lit(True))
    return index.join(h, "name", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False))).join(lengths, "name", "left")


def directions(attempts: DataFrame) -> DataFrame:
    return attempts.where("completed").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions"))


def coalesced(timeline: DataFrame, gap: int = 250, seconds: int = 900) -> DataFrame:
    """Entries of the same name, kind and direction that follow each other closely, merged: an out-and-back stays two.

    ``timeline(activity_id, name, kind, direction, start_idx, end_idx, start_t, end_t)``.
    Close is a gap of at most ``gap`` points, and of at most ``seconds`` where
    the merged entry's end and the next one's start have times; without times
    the points alone decide.  The merged end is the last that has one, so it
    depends on what was merged before: windows part what can't be merged in any
    case, and a fold over the few entries of such a run decides the rest.
    """
    w = Window.partitionBy("activity_id").orderBy("start_idx", "end_idx")
    p = lambda c: F.lag(c).over(w)
    same = F.lit(True)
    for c in ("name", "kind", "direction"):
        same = same & F.col(c).eqNullSafe(p(c))
    able = same & (F.col("start_idx") - p("end_idx")).between(0, gap)
    r = timeline.withColumn("new", F.when(F.coalesce(able, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fields = ("start_idx", "end_idx", "start_t", "end_t")
    one = lambda e, **over: F.struct(*(over.get(c, e[c]).alias(c) for c in (*fields, "parts")))
    runs = r.groupBy("activity_id", "run", "name", "kind", "direction").agg(F.array_sort(F.collect_list(F.struct(*fields, F.lit(1).cast("long").alias("parts")))).alias("entries"))

    def step(done: F.Column, e: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        late = F.coalesce(e["start_t"] - last["end_t"] > seconds, F.lit(False))
        joined = one(last, end_idx=e["end_idx"], end_t=F.coalesce(e["end_t"], last["end_t"]), parts=last["parts"] + 1)
        return F.when(late, F.concat(done, F.array(one(e)))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

    rest = F.slice("entries", 2, F.greatest(F.size("entries") - 1, F.lit(1)))
    folded = F.aggregate(rest, F.slice("entries", 1, 1), step)
    out = runs.select("activity_id", "name", "kind", "direction", F.explode(folded).alias("e"))
    return out.select("activity_id", "name", "kind", "direction", *(F.col(f"e.{c}").alias(c) for c in (*fields, "parts")))


def track_coverage(vertices: DataFrame, points: DataFrame, metres: float = 40.0, stride: int = 3) -> DataFrame:
    """Share of each line's every third vertex that has every third point of a track within ``metres``, by activity and line.

    Both meet on cells of that size and their neighbours.
    """
    from .network import close_pairs

    v = vertices.where(F.col("i") % stride == 0)
    p = points.where(F.col("seq") % stride == 0).select("activity_id", F.col("lat").alias("latb"), F.col("lon").alias("lonb"))
    hit = close_pairs(v.withColumnsRenamed({"vlat": "lata", "vlon": "lona"}), p, metres)
    hits = hit.select("activity_id", "line_id", "i").distinct().groupBy("activity_id", "line_id").agg(F.count("*").alias("hit"))
    total = v.groupBy("line_id").agg(F.count("*").alias("n"))
    return hits.join(total, "line_id").select("activity_id", "line_id", (F.col("hit") / F.col("n")).alias("covered"))
