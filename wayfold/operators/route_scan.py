"""Attempts at all saved routes at once: an automaton over the routes' segments, run once along each timeline.

A route is a list of edges, each with the name and kind of its trail.  Routes
that begin alike share the states of a trie.  A timeline is read from its first
entry to its last; at each entry stand the states that wait there for their
next edge, and the routes that may begin there.  What an entry satisfies is
decided once for each edge, however many routes run over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def _close(before: dict, after: dict, most_idx: int = 250, most_s: float = 900.0) -> bool:
    """Whether an entry goes on where the one before stopped: a bounded gap in points and time."""
    return 0 <= after["start_idx"] - before["end_idx"] <= most_idx and after["start_t"] - before["end_t"] <= most_s


def _satisfied(entries: list[dict], at: int, seg: dict) -> int | None:
    """Place after the entries from ``at`` on that together touch both ends of a route's segment, or cover it; the fewest that do."""
    one = two = False
    seen: set[int] = set()
    for k in range(at, len(entries)):
        e = entries[k]
        if (e["name"], e["kind"]) != (seg["name"], seg["kind"]) or (k > at and not _close(entries[k - 1], e)):
            return None
        for part in ("gap", "own") if k > at else ("own",):
            a, b, covered = e["marks"].get((seg["pos"], part), (False, False, ()))
            one, two = one or a, two or b
            seen.update(covered)
        if (one and two) or (seg["vertices"] and len(seen) >= 0.75 * seg["vertices"]):
            return k + 1
    return None


class Automaton:
    """A trie of ``routes``, pairs of an id and its segments (``pos`` of the edge, ``name``, ``kind``, ``vertices``); node 0 is the root."""

    def __init__(self, routes: list[tuple[object, list[dict]]]):
        self.children: list[dict[object, int]] = [{}]
        self.segment: list[dict] = [{}]
        self.above, self.ends, self.under = [0], [set()], [set()]
        self.starts: dict[tuple, list[int]] = {}
        for route, segments in routes:
            node = 0
            for s in segments:
                child = self.children[node].get(s["pos"])
                if child is None:
                    child = self.children[node][s["pos"]] = len(self.segment)
                    self.children.append({})
                    self.segment.append(s)
                    self.above.append(node)
                    self.ends.append(set())
                    self.under.append(set())
                    if node == 0:
                        self.starts.setdefault((s["name"], s["kind"]), []).append(child)
                node = child
                self.under[node].add(route)
            self.ends[node].add(route)

    def attempts(self, entries: list[dict]) -> list[tuple[object, int, int]]:
        """Route, first and last entry of each time that all its segments are satisfied in order, a route at most once at a time.

        Small noise is passed over, and so are entries on the trail of the
        segment before or after that follow the last match closely; anything
        else sends the state's routes back to their beginnings.
        """
        n, found = len(entries), []
        waiting: list[list[tuple[int, int, int, set]]] = [[] for _ in range(n + 1)]  # node that is next, first and last entry, routes
        since: dict[object, int] = {}  # entry from which a route may begin, if that isn't the first
        stops: dict[tuple[int, object], int | None] = {}
        trail = lambda node: (self.segment[node].get("name"), self.segment[node].get("kind")) if node else None

        def stop(k: int, node: int) -> int | None:
            key = k, self.segment[node]["pos"]
            if key not in stops:
                stops[key] = _satisfied(entries, k, self.segment[node])
            return stops[key]

        def advance(node: int, first: int, after: int, routes: set) -> None:
            for r in routes & self.ends[node]:
                found.append((r, first, after - 1))
                since[r] = after
            for child in self.children[node].values():
                if own := routes & self.under[child]:
                    waiting[after].append((child, first, after - 1, own))
                    since.update(dict.fromkeys(own, n + 1))

        for k, e in enumerate(entries):
            on = e["name"], e["kind"]
            for node, first, last, routes in waiting[k]:
                if (after := stop(k, node)) is not None:
                    advance(node, first, after, routes)
                elif e["noise"] or (on in (trail(node), trail(self.above[node])) and _close(entries[last], e)):
                    waiting[k + 1].append((node, first, last, routes))
                else:
                    since.update(dict.fromkeys(routes, k))
            for node in self.starts.get(on, ()):
                routes = {r for r in self.under[node] if since.get(r, 0) <= k}
                if routes and (after := stop(k, node)) is not None:
                    advance(node, k, after, routes)
        return found


def attempts_at(run: list, entries: list[dict], stops: dict[object, list[int | None]], trails: dict[object, tuple]) -> list[tuple[int, int]]:
    """First and last entry of each attempt at one route, the list of its edges: what ``Automaton`` finds for it.

    ``stops`` has, for each edge, the place after the entries that satisfy it
    from each entry on, ``trails`` its name and kind.
    """
    found, at, first, last, k = [], 0, -1, -1, 0
    while k < len(entries):
        after = stops[run[at]][k]
        if after is not None:
            first, last, at, k = k if first < 0 else first, after - 1, at + 1, after
            if at == len(run):
                found.append((first, last))
                at, first = 0, -1
        elif first < 0:
            k += 1
        else:
            e = entries[k]
            if e["noise"] or ((e["name"], e["kind"]) in (trails[run[at - 1]], trails[run[at]]) and _close(entries[last], e)):
                k += 1
            else:
                at, first = 0, -1
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Timelines' own routes are many and mostly alike in length, so that each goes along the stops, which are found once; tries of them took longer to build."""
    for b in batches:
        out = []
        asked = b.column("routes")
        for i in range(b.num_rows):
            entries, near = b.column("entries")[i].as_py(), b.column("near")[i].as_py()
            marks: dict[int, dict] = {}
            segments: dict[int, dict] = {}
            for m in near:
                marks.setdefault(m["entry"], {})[m["pos"], m["part"]] = (m["a"], m["b"], m["covered"])
                segments[m["pos"]] = {k: m[k] for k in ("pos", "name", "kind", "vertices")}
            for e in entries:
                e["marks"] = marks.get(e["entry"], {})
            stops = {p: [_satisfied(entries, k, s) if (e["name"], e["kind"]) == (s["name"], s["kind"]) else None for k, e in enumerate(entries)] for p, s in segments.items()}
            ever = {p for p, v in stops.items() if any(x is not None for x in v)}
            trails = {p: (s["name"], s["kind"]) for p, s in segments.items()}
            routes, activity = asked[i].values, b.column("activity_id")[i].as_py()
            runs = routes.field("run")
            ends = runs.offsets.to_pylist()
            edges = runs.values.slice(ends[0], ends[-1] - ends[0]).to_pylist()
            for route, x, y in zip(routes.field("route_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                run = edges[x - ends[0] : y - ends[0]]
                if ever.issuperset(run):
                    out += [(route, activity, entries[f]["start_idx"], entries[z]["end_idx"], entries[z]["end_t"] - entries[f]["start_t"]) for f, z in attempts_at(run, entries, stops, trails)]
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["route_id", "activity_id", "first_idx", "last_idx", "duration"])


def may_satisfy(marked: DataFrame, known: DataFrame) -> DataFrame:
    """``activity_id, edge`` where all marks of the activity together touch both ends of the edge, or cover it: without that no entries satisfy it.  ``known(pos, vertices)``."""
    g = marked.groupBy("activity_id", "pos").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"))
    g = g.join(known.select("pos", "vertices"), "pos").where("(a AND b) OR (vertices > 0 AND n >= 0.75D * vertices)")
    return g.select("activity_id", F.col("pos").alias("edge"))


def able_routes(met: DataFrame, runs: DataFrame) -> DataFrame:
    """``activity_id, route_id`` where the activity came near to all edges of the route: ``met(activity_id, edge)``, ``runs(route_id, run)``.

    They meet at one edge of the route, that which the fewest activities came
    near to, and only pairs that pass leave the join.
    """
    held = met.groupBy("edge").agg(F.count("*").alias("held"))
    rarest = runs.select("route_id", F.explode("run").alias("edge")).join(held, "edge", "left").groupBy("route_id").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "edge")).alias("least"))
    asking = runs.join(rarest, "route_id").select("route_id", F.col("least.edge").alias("edge"), F.array_distinct("run").alias("run"))
    have = met.groupBy("activity_id").agg(F.collect_set("edge").alias("met"))
    # a few rows become many pairs: a number of partitions that adaptive execution keeps
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.join(have, "activity_id").repartition(parts, "edge").join(asking, "edge").where(F.size(F.array_except("run", "met")) == 0).select("activity_id", "route_id")


def scan_all(timeline: DataFrame, marked: DataFrame, routes: DataFrame, edges: DataFrame, sizes: DataFrame, per_part: int = 1024) -> DataFrame:
    """``route_id, activity_id, first_idx, last_idx, duration`` of every attempt at ``routes(route_id, pos, edge)`` in ``timeline(activity_id, entry, start_idx, end_idx, start_t, end_t, name, kind, noise)``.

    ``marked(activity_id, entry, pos, part, a, b, covered)`` tells which ends
    and vertices of the edge ``pos`` the points of an entry (part ``own``), or
    those just before it (``gap``), come near to; ``sizes(edge, n)`` how many
    vertices an edge has.  Timelines meet routes by ids alone, and only routes
    all of whose edges the activity came near to reach the automaton: in lists
    of at most ``per_part`` routes, as the edges' ids, for what an edge is
    comes with the marks.
    """
    entry = F.struct("start_idx", "entry", "end_idx", "start_t", "end_t", "name", "kind", F.coalesce("noise", F.lit(False)).alias("noise"))
    whole = timeline.groupBy("activity_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    known = edges.select(F.col("edge").alias("pos"), "name", "kind").join(sizes.withColumnRenamed("edge", "pos"), "pos", "left").withColumn("vertices", F.coalesce("n", F.lit(0))).drop("n")
    met = cut(may_satisfy(marked, known))  # two numbers a row, read several times
    near = marked.join(met.withColumnRenamed("edge", "pos"), ["activity_id", "pos"], "left_semi").join(known, "pos").groupBy("activity_id").agg(F.collect_list(F.struct("entry", "pos", "part", "a", "b", "covered", "name", "kind", "vertices")).alias("near"))
    own = routes.join(edges.select("edge"), "edge").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "edge"))).alias("s"))
    runs = cut(own.select("route_id", F.col("s.edge").alias("run")))
    able = able_routes(met, runs)
    w = Window.partitionBy("activity_id").orderBy("route_id")
    able = able.withColumn("part", F.floor((F.row_number().over(w) - 1) / per_part))
    asked = able.join(runs, "route_id").groupBy("activity_id", "part").agg(F.collect_list(F.struct("route_id", "run")).alias("routes"))
    rows = whole.join(near, "activity_id").join(asked.drop("part"), "activity_id")
    return rows.mapInArrow(_scan, "route_id long, activity_id long, first_idx long, last_idx long, duration long")
