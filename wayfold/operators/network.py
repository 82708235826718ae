"""Line networks and routes: termini, junctions, edges, saved routes and attempts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_of_differences
from ..functions.lineage import cut

_M = 3.141592653589793 * 6371000.0 / 180


def _ends(ways: DataFrame) -> DataFrame:
    """Both ends of each way, numbered in the order of the ways."""
    a = ways.select("name", (F.col("way_pos") * 2).alias("p"), F.col("alat").alias("lat"), F.col("alon").alias("lon"))
    return a.unionByName(ways.select("name", (F.col("way_pos") * 2 + 1).alias("p"), F.col("blat").alias("lat"), F.col("blon").alias("lon")))


def termini(ways: DataFrame) -> DataFrame:
    """The two farthest ends of the ways of each name; the first of equals in the order of the ways.

    Before ends are paired, those go that can't be of a farthest pair: whose
    distance from the farthest corner of the name's box is below that of two
    of the name's extreme ends.
    """
    ends = _ends(ways)
    by = {"n": F.col("lat"), "s": -F.col("lat"), "e": F.col("lon"), "w": -F.col("lon"), "ne": F.col("lat") + F.col("lon"), "sw": -F.col("lat") - F.col("lon"), "nw": F.col("lat") - F.col("lon"), "se": F.col("lon") - F.col("lat")}
    g = ends.groupBy("name").agg(F.min("lat").alias("la"), F.max("lat").alias("lb"), F.min("lon").alias("oa"), F.max("lon").alias("ob"), *(F.max_by(F.struct("lat", "lon"), v).alias(k) for k, v in by.items()))
    apart = lambda x, y: haversine_of_differences(F.col(f"{x}.lat"), F.col(f"{x}.lon"), F.col(f"{y}.lat"), F.col(f"{y}.lon"))
    sure = F.greatest(*(apart(x, y) for x, y in (("n", "s"), ("e", "w"), ("ne", "sw"), ("nw", "se"))))
    corner = F.greatest(*(haversine_of_differences(F.col("lat"), F.col("lon"), F.col(a), F.col(o)) for a in ("la", "lb") for o in ("oa", "ob")))
    # a box of less than a degree is flat enough for corners to be farthest; the share left over covers the rest
    able = ends.join(g.select("name", "la", "lb", "oa", "ob", sure.alias("sure")), "name").where(corner * 1.001 >= F.col("sure")).select("name", "p", "lat", "lon")
    one, two = (able.withColumnsRenamed({c: f"{c}{k}" for c in ("p", "lat", "lon")}) for k in (0, 1))
    pairs = one.join(two, "name").where("p0 < p1").withColumn("d", haversine_of_differences(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))
    return pairs.groupBy("name").agg(F.min(F.struct((-F.col("d")).alias("far"), "p0", "p1")).alias("best")).select("name", "best.p0", "best.p1", (-F.col("best.far")).alias("d"))


def degrees(ways: DataFrame, metres: float = 5.0) -> DataFrame:
    """Names by how many ends of their ways meet, within ``metres``: a name is a loop if no end is free and none meets more than one other, a line if two are free, else messy."""
    # ends of a name at one place are met as one, with their number
    places = _ends(ways).groupBy("name", "lat", "lon").agg(F.count("*").alias("held"))
    side = lambda k: places.select("name", *(F.col(c).alias(f"{c}{k}") for c in ("lat", "lon", "held")))
    near = close_pairs(side("a"), side("b"), metres, within=("name",))
    met = near.groupBy("name", F.col("lata").alias("lat"), F.col("lona").alias("lon")).agg((F.sum("heldb") - 1).alias("n"))
    free = F.sum(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("held")).otherwise(0))
    g = places.join(met, ["name", "lat", "lon"], "left").groupBy("name").agg(free.alias("free"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    kind = F.when((F.col("free") == 0) & (F.col("most") == 1), "loop").when((F.col("free") == 2) & (F.col("most") <= 1), "linear").otherwise("messy")
    return g.select("name", "free", "most", kind.alias("topology"))


def close_pairs(a: DataFrame, b: DataFrame, metres: float, condition: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs, of equal ``within``, of ``a(ida, lata, lona)`` and ``b(idb, latb, lonb)`` within ``metres``, met on cells of twice that size and their neighbours; a band of cells is as wide in degrees of longitude as its end nearer to the pole needs."""
    side = metres / _M * 2
    band = lambda c: F.floor(F.col(c) / side)
    # a pair may reach one band further than its cell's
    pole = F.least((F.greatest(F.abs(F.col("ci")), F.abs(F.col("ci") + 1)) + 1) * side, F.lit(89.9))
    cell = lambda c: F.floor(F.col(c) * F.cos(F.radians(pole)) / side)
    shrink = lambda k: F.cos(F.radians(f"lat{k}")).alias(f"_k{k}")
    left = a.select("*", shrink("a")).withColumn("ci", F.explode(F.array(*(band("lata") + k for k in (-1, 0, 1))))).withColumn("cj", F.explode(F.array(*(cell("lona") + k for k in (-1, 0, 1)))))
    near = left.join(b.select("*", shrink("b")).withColumn("ci", band("latb")).withColumn("cj", cell("lonb")), ["ci", "cj", *within])
    # most pairs of neighbouring cells are too far apart, which the flat shows; sines are left to the others, and to pairs so far east that it does not
    north, east = F.col("lata") - F.col("latb"), F.col("lona") - F.col("lonb")
    flat = (north * north + east * east * F.col("_ka") * F.col("_kb") <= (1.02 * metres / _M) ** 2) | (F.abs(east) > 5) | (F.abs(north) > 5)
    near = near.where(flat).withColumn("d", haversine_of_differences(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb"))).where(F.col("d") <= metres).drop("ci", "cj", "_ka", "_kb")
    return near.where(condition) if condition is not None else near


def leaders(points: DataFrame, metres: float) -> DataFrame:
    """Greedy clusters of ``points(id, lat, lon)`` in the order of ids: each joins the first leader within ``metres``, or leads itself; ``(id, leader)``.

    Whoever has no earlier point near leads; who is near to a leader follows
    the first such; each round settles those whose earlier neighbours are
    settled.  Points meet on cells, so that no group holds them all.
    """
    # points at one place have the leader of the first there
    places = cut(points.groupBy("lat", "lon").agg(F.min("id").alias("id")))
    side = lambda k: places.select(F.col("id").alias(f"id{k}"), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    earlier = cut(close_pairs(side("a"), side("b"), metres, F.col("idb") < F.col("ida")).select("ida", "idb"))
    state = cut(places.select("id", F.lit(None).cast("long").alias("leader")))
    while True:
        known = state.select(F.col("id").alias("idb"), F.col("leader").alias("l"))
        seen = earlier.join(known, "idb").groupBy("ida").agg(F.min(F.when(F.col("l") == F.col("idb"), F.col("idb"))).alias("first"), F.min(F.when(F.col("l").isNull(), F.col("idb"))).alias("open"))
        s = state.join(seen, state["id"] == seen["ida"], "left")
        # the first leader near is sure once no open point comes before it
        follows = F.when(F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("open") > F.col("first"))), F.col("first"))
        leads = F.when(F.col("first").isNull() & F.col("open").isNull(), F.col("id"))
        state = cut(s.select("id", F.coalesce("leader", follows, leads).alias("leader")))
        if state.where("leader IS NULL").isEmpty():
            led = places.join(state, "id").select("lat", "lon", "leader")
            return points.join(led, ["lat", "lon"], "left").select("id", F.coalesce("leader", "id").alias("leader"))


def end_clusters(ways: DataFrame, metres: float = 5.0) -> DataFrame:
    """Clusters of ends of ways that two names or more share: the leading end's place and the names."""
    ends = _ends(ways).withColumnRenamed("p", "id")
    led = ends.join(leaders(ends.select("id", "lat", "lon"), metres), "id")
    g = led.groupBy(F.col("leader").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("names"), F.min_by("lat", "id").alias("lat"), F.min_by("lon", "id").alias("lon"))
    return g.where(F.size("names") >= 2)


def interior_junctions(vertices: DataFrame, segments: DataFrame, metres: float = 8.0) -> DataFrame:
    """Vertices of ``vertices(id, name, lat, lon)`` within ``metres`` of a segment of another name, with the first such name."""
    from .spatial import segment_pairs

    lines = segments.select(F.col("name").alias("other"), "alat", "alon", "blat", "blon").distinct()
    near = segment_pairs(vertices, lines, metres).where((F.col("d") <= metres) & (F.col("name") != F.col("other")))
    first = near.groupBy("id", "name").agg(F.min("other").alias("other"))
    return vertices.join(first.select("id", "other"), "id").select("id", "lat", "lon", F.array_sort(F.array("name", "other")).alias("names"))


def junctions(raw: DataFrame, metres: float = 25.0) -> DataFrame:
    """``raw(id, lat, lon, names)`` in clusters of ``metres``: mean place, all names, and an id from the place, so that a rebuild gives the same."""
    led = raw.join(leaders(raw.select("id", "lat", "lon"), metres), "id")
    g = led.groupBy("leader").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    place = F.concat_ws(",", F.round("lat", 5).cast("string"), F.round("lon", 5).cast("string"))
    return g.select(F.concat(F.lit("j_"), F.substring(F.md5(place), 1, 8)).alias("junction_id"), "lat", "lon", "names")


def pinned(junctions_: DataFrame, vertices: DataFrame, metres: float = 15.0) -> DataFrame:
    """Nodes along each component of ``vertices(name, chain, i, lat, lon)``: its two ends, and the junctions of its name whose nearest vertex is within ``metres`` and no end; one for each vertex.

    Returns ``(name, chain, i, node)``; an end's node is named after its component.
    """
    size = vertices.groupBy("name", "chain").agg(F.max("i").alias("last"))
    j = junctions_.select("junction_id", F.col("lat").alias("lata"), F.col("lon").alias("lona"), F.explode("names").alias("namea"))
    v = vertices.select("name", "chain", "i", F.col("lat").alias("latb"), F.col("lon").alias("lonb"))
    near = close_pairs(j, v, metres, F.col("namea") == F.col("name"))
    best = near.groupBy("junction_id", "name", "chain").agg(F.min(F.struct("d", "i")).alias("b")).select("junction_id", "name", "chain", F.col("b.i").alias("i"))
    inner = best.join(size, ["name", "chain"]).where("i > 0 AND i < last").groupBy("name", "chain", "i").agg(F.min("junction_id").alias("node"))
    end = lambda at, tag: size.select("name", "chain", at.alias("i"), F.concat_ws("|", F.lit(tag), "name", "chain").alias("node"))
    return inner.unionByName(end(F.lit(0).cast("long"), "start")).unionByName(end(F.col("last").cast("long"), "end"))


def edges(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between consecutive nodes of each component, with their length, mid vertex and an id from what they join."""
    w = Window.partitionBy("name", "chain").orderBy("i")
    e = nodes.withColumns({"end_node": F.lead("node").over(w), "end_i": F.lead("i").over(w)}).where("end_i > i")
    back = lambda c: F.lag(c).over(w)
    v = vertices.withColumn("leg", F.coalesce(haversine_of_differences(back("lat"), back("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))
    v = v.withColumn("along", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda tag: v.select("name", "chain", F.col("i").alias(f"{tag}_i"), F.col("along").alias(f"{tag}_m"))
    e = e.withColumnRenamed("i", "start_i").join(at("start"), ["name", "chain", "start_i"]).join(at("end"), ["name", "chain", "end_i"])
    edge = F.concat(F.lit("e_"), F.substring(F.md5(F.concat_ws("|", "name", "chain", "node", "end_node")), 1, 8))
    mid = F.col("start_i") + F.floor((F.col("end_i") - F.col("start_i") + 1) / 2)
    return e.select(edge.alias("edge_id"), "name", "chain", F.col("node").alias("start_node"), "end_node", "start_i", "end_i", mid.alias("mid_i"), (F.col("end_m") - F.col("start_m")).alias("length_m"))


def artifact(edges_: DataFrame) -> DataFrame:
    """Trails of a region with their edges, number of components, length, and a digest by which a rebuild is compared."""
    g = edges_.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("edge_id", "chain", "start_node", "end_node", "length_m"))).alias("edges"), F.count_distinct("chain").alias("components"), F.sum("length_m").alias("length_m"))
    return g.withColumn("digest", F.md5(F.array_join(F.transform("edges", lambda e: e["edge_id"]), ",")))


def edge_lines(edges_: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with their polylines, as arrays of places."""
    e = edges_.withColumn("i", F.explode(F.sequence("start_i", "end_i"))).join(vertices.select("name", "chain", "i", "lat", "lon"), ["name", "chain", "i"])
    g = e.groupBy("name", "chain", "edge_id", "length_m").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("s"))
    return g.select("name", "chain", "edge_id", "length_m", F.transform("s", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("line"))


def node_places(junctions_: DataFrame, edges_: DataFrame, vertices: DataFrame) -> DataFrame:
    """Place of each node: junctions first, then ends of components, of which the later entry of a name holds."""
    j = junctions_.select(F.col("junction_id").alias("node"), "lat", "lon", F.lit(0).alias("pass"))
    at = lambda node, i, tag: edges_.where(F.col(node).startswith(tag)).select(F.col(node).alias("node"), "name", "chain", F.col(i).alias("i")).join(vertices.select("name", "chain", "i", "lat", "lon"), ["name", "chain", "i"]).select("node", "lat", "lon", F.lit(1).alias("pass"))
    both = j.unionByName(at("start_node", "start_i", "start|")).unionByName(at("end_node", "end_i", "end|"))
    return both.groupBy("node").agg(F.max_by(F.struct("lat", "lon"), "pass").alias("p")).select("node", "p.lat", "p.lon")


def split_edges(nodes: DataFrame) -> DataFrame:
    """Edges between consecutive junctions along ``nodes(chain, place, node)``, with a digest of both as id."""
    w = Window.partitionBy("chain").orderBy("place")
    e = nodes.withColumns({"end_node": F.lead("node").over(w), "end_place": F.lead("place").over(w)}).where("end_node IS NOT NULL")
    return e.select("chain", F.col("node").alias("start_node"), "end_node", (F.col("end_place") - F.col("place")).alias("steps"), F.substring(F.md5(F.concat_ws("|", "chain", "node", "end_node")), 1, 12).alias("edge_id"))


def macro_segments(route: DataFrame) -> DataFrame:
    """Consecutive segments of the same name of ``route(route_id, pos, name, ...)`` folded into one."""
    w = Window.partitionBy("route_id").orderBy("pos")
    r = route.withColumn("new", F.when(F.col("name").eqNullSafe(F.lag("name").over(w)), 0).otherwise(1)).withColumn("macro", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("route_id", "macro", "name").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("length_m").alias("length_m"))


def macro_lines(route: DataFrame) -> DataFrame:
    """``macro_segments`` with the nodes where each starts and ends, and its line: that of its segments, one after the other."""
    w = Window.partitionBy("route_id").orderBy("pos")
    r = route.withColumn("new", F.when(F.col("name").eqNullSafe(F.lag("name").over(w)), 0).otherwise(1)).withColumn("macro", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    g = r.groupBy("route_id", "macro", "name").agg(F.min_by("start_node", "pos").alias("start_node"), F.max_by("end_node", "pos").alias("end_node"), parts.alias("s"))
    return g.select("route_id", "macro", "name", "start_node", "end_node", F.flatten(F.transform("s", lambda x: x["line"])).alias("line"))


def stale_routes(segments: DataFrame, edges_: DataFrame) -> DataFrame:
    """Whether a route has a segment whose edge is gone."""
    known = edges_.select("edge_id").distinct().withColumn("_on", F.lit(True))
    return segments.join(known, "edge_id", "left").groupBy("route_id").agg(F.bool_or(F.col("_on").isNull()).alias("stale"))


def resolved(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Saved segments against today's edges: by id (fresh), by the junctions in either order (exact), by name (approximate), or failed; a route has its worst status."""
    ids = edges.select("edge_id", F.lit(True).alias("by_id")).distinct()
    pair = lambda a, b: F.concat_ws("|", "name", F.least(a, b), F.greatest(a, b))
    ends = edges.select(pair("start_node", "end_node").alias("pair"), F.lit(True).alias("by_pair")).distinct()
    names = edges.select("name", F.lit(True).alias("by_name")).distinct()
    s = segments.withColumn("pair", pair("start_node", "end_node")).join(ids, "edge_id", "left").join(ends, "pair", "left").join(names, "name", "left")
    status = F.when(F.col("by_id"), 0).when(F.col("by_pair"), 1).when(F.col("by_name"), 2).otherwise(3)
    s = s.withColumn("rank", status)
    return s.groupBy("route_id").agg(F.max("rank").alias("rank"), F.count("*").alias("segments")).select("route_id", "segments", F.element_at(F.array(*map(F.lit, ("fresh", "exact", "approximate", "failed"))), F.col("rank") + 1).alias("status"))


def route_list(routes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Length, attempts and best time of each route."""
    length = routes.groupBy("route_id").agg(F.sum("length_m").alias("length_m"))
    a = attempts.groupBy("route_id").agg(F.count("*").alias("attempts"), F.min("duration").alias("best"), F.min_by("activity_id", F.struct("duration", "activity_id")).alias("best_id"))
    return length.join(a, "route_id", "left").select("route_id", "length_m", F.coalesce("attempts", F.lit(0)).alias("attempts"), "best", "best_id")


def routes_ridden(attempts: DataFrame) -> DataFrame:
    """Each activity's best attempt of a route, with its rank among all activities."""
    own = attempts.groupBy("route_id", "activity_id").agg(F.min("duration").alias("duration"))
    w = Window.partitionBy("route_id")
    return own.withColumns({"rank": F.row_number().over(w.orderBy("duration", "activity_id")).cast("long"), "total": F.count("*").over(w)}).withColumn("is_best", F.col("rank") == 1)


def _title(names: Column, most: int) -> Column:
    """A chain of names joined; one longer than ``most`` characters gives its first three names and the number of the others."""
    whole = F.array_join(names, " → ")
    short = F.concat(F.array_join(F.slice(names, 1, 3), " → "), F.lit(" → +"), (F.size(names) - 3).cast("string"), F.lit(" more"))
    return F.when(F.length(whole) > most, short).otherwise(whole)


def name_chain(entries: DataFrame, most: int = 80) -> DataFrame:
    """Titles of activities from the names of their entries in order, each once in a row: proposals where there is but one region."""
    one = entries.select("activity_id", F.lit(0).alias("region_id"), F.col("start_idx").alias("pos"), "name")
    return proposals(one, most).select("activity_id", "title")


def proposals(segments: DataFrame, most: int = 80) -> DataFrame:
    """The route that each ride proposes: of the regions whose network resolves its ``segments(activity_id, region_id, pos, name)`` the one with the most, the first of equals, and a title from its chain of names."""
    w = Window.partitionBy("activity_id", "region_id").orderBy("pos")
    s = segments.withColumn("_new", ~F.col("name").eqNullSafe(F.lag("name").over(w)) | F.lag("pos").over(w).isNull())
    g = s.groupBy("activity_id", "region_id").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("pos", "name")))).alias("s"))
    best = g.groupBy("activity_id").agg(F.max_by(F.struct("region_id", "segments", "s"), F.struct("segments", (-F.col("region_id")).alias("r"))).alias("b")).select("activity_id", "b.*")
    return best.select("activity_id", "region_id", "segments", _title(F.transform("s", lambda x: x["name"]), most).alias("title"))


def touches(points: DataFrame, spans: DataFrame, ends: DataFrame, metres: float = 30.0) -> DataFrame:
    """Whether each of ``spans(activity_id, name, start, end)`` comes within ``metres`` of the one and the other terminus of its name (``ends(name, alat, alon, blat, blon)``): columns ``a``, ``b`` and ``both``."""
    s = spans.select("activity_id", "name", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("seq"))
    p = s.join(points.select("activity_id", "seq", "lat", "lon"), ["activity_id", "seq"]).join(ends, "name")
    near = lambda k: F.bool_or(haversine_of_differences(F.col("lat"), F.col("lon"), F.col(f"{k}lat"), F.col(f"{k}lon")) <= metres)
    return p.groupBy("activity_id", "name", "start").agg(near("a").alias("a"), near("b").alias("b")).withColumn("both", F.col("a") & F.col("b"))


def ways_in_region(vertices: DataFrame, inside: DataFrame) -> DataFrame:
    """Ways with a vertex inside a region: ``vertices(line_id, i)``, ``inside`` as points of those ids."""
    return vertices.join(inside.select(F.col("activity_id").alias("line_id"), F.col("seq").alias("i"), "region_id"), ["line_id", "i"]).select("line_id", "region_id").distinct()


def nearest_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Nearest vertex of each point's own line, the first of equals: both have ``line_id``."""
    d = haversine_of_differences(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))
    # the least distance, and then the vertices at it: minima of numbers need no sort of the pairs, which are never kept
    least = points.join(vertices, "line_id").groupBy("line_id", "id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min(d).alias("least"))
    return least.join(vertices, "line_id").where(d.eqNullSafe(F.col("least"))).groupBy("line_id", "id").agg(F.min("i").alias("i"), F.min("least").alias("d"))
