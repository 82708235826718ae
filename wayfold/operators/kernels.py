"""Operators whose next step depends on the last decision: greedy scans over one track, in Arrow batches per activity.

A track is one person's activity, some thousands of points; it is the unit of
distribution, and Spark deals activities over the tasks.  Each scan here is a
short loop over positions found by numpy, not by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIST = "activity_id long, seq long"


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.nan_to_num(x))])


def _at(t: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First place of ``t`` at or after each of ``least``; one by one where times run back, as a search among them depends on those before."""
    return np.searchsorted(t, least, "left") if (t[1:] >= t[:-1]).all() else np.array([np.searchsorted(t, x, "left") for x in least], int)


def rising(dt: np.ndarray, dz: np.ndarray, rate: float, gain: float, seconds: float = 60.0, block: float = 30.0) -> np.ndarray:
    """Legs of steady climbs: at least ``seconds`` with ``gain`` metres at ``rate`` metres a minute, extended by blocks at half that rate."""
    n, t, z = len(dt), _sums(dt), _sums(dz)
    flag, past = np.zeros(n, bool), 1  # no leg goes into the first point
    # all legs at once: whether a climb may begin there, and where one that came up to there goes on to
    end, after = _at(t, t[:n] + seconds), np.minimum(n, _at(t, t[:n] + block))
    j = np.minimum(end, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        up, mins = z[j] - z[:n], (t[j] - t[:n]) / 60
        begins = (up >= gain) & (mins > 0) & (up / mins >= rate)
        span = (t[after] - t[:n]) / 60
        goes_on = (after > np.arange(n)) & (span > 0) & ((z[after] - z[:n]) / span >= rate / 2)
    for i in np.flatnonzero(begins | (end > n)):
        if i < past:
            continue
        if end[i] > n:
            break
        k = int(end[i])
        while k < n and goes_on[k]:
            k = int(after[k])
        flag[i:k] = True
        past = k
    return flag


def _metres(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    p, q = np.radians(lat0), np.radians(lat1)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon1 - lon0) / 2) ** 2
    return 12742000.0 * float(np.arcsin(np.sqrt(min(a, 1.0))))


def steady(dt: np.ndarray, dist: np.ndarray, dz: np.ndarray, speed: np.ndarray, lat: np.ndarray, lon: np.ndarray, window: int = 60) -> np.ndarray:
    """Legs of even or straight climbs at the speed of a lift: windows of legs, shorter at the end of the track, whose mean speed is within 6 to 25 km/h, extended while that of the last 20 is.

    Even is a deviation of speeds below 13 km/h, straight a sinuosity of at most 1.15; without positions only the first counts.
    """
    n = len(dt)
    valid = (dt > 0) & (dt < 5) & ~np.isnan(speed)
    v = np.where(valid, speed, 0.0)
    cv, cs, cs2, cz, ct, cd = _sums(valid), _sums(v), _sums(v * v), _sums(dz), _sums(dt), _sums(dist)
    flag, past = np.zeros(n, bool), 1

    def mean(a: int, b: int) -> float:
        k = cv[b] - cv[a]
        return (cs[b] - cs[a]) / k if k else 0.0

    def straight(a: int, b: int) -> bool:
        d = _metres(lat[a], lon[a], lat[b], lon[b])
        return not np.isnan(d) and (d <= 1 or (cd[b + 1] - cd[a]) / d <= 1.15)

    at, end = np.arange(n), np.minimum(np.arange(n) + window, n)
    first = np.maximum(np.arange(n + 1) - 20, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = cv[end] - cv[at]
        m = np.where(k > 0, (cs[end] - cs[at]) / k, 0.0)
        last = cv - cv[first]
        m20 = np.where(last > 0, (cs - cs[first]) / last, 0.0)
    begins = (k >= window // 2) & (cz[end] - cz[at] >= 25) & (6 < m) & (m < 25)
    # where the mean of the last 20 legs leaves the bounds, from each leg on
    stop = np.minimum.accumulate(np.where((6 < m20) & (m20 < 25) & (np.arange(n + 1) < n), n, np.arange(n + 1))[::-1])[::-1]
    for i in map(int, np.flatnonzero(begins)):
        if i < past:
            continue
        j = int(end[i])
        while j < min(n, i + 20) and 6 < mean(i, j) < 25:
            j += 1
        if j >= i + 20:
            j = int(stop[j])
        k = cv[j] - cv[i]
        spread = np.sqrt(max(0.0, (cs2[j] - cs2[i] - k * mean(i, j) ** 2) / (k - 1))) if k > 1 else 0.0
        if cz[j] - cz[i] >= 40 and ct[j] - ct[i] >= 90 and (spread < 13 or straight(i, j - 1)):
            flag[i:j] = True
            past = j
    return flag


def shuttle(dt: np.ndarray, dz: np.ndarray, speed: np.ndarray, seconds: float = 90.0) -> np.ndarray:
    """Legs of fast climbs, as by car: ``seconds`` (half of them at the end of the track) with 50 metres up at a mean speed of 20 km/h or more, extended while the last 30 legs are as fast and don't fall."""
    n, t, z = len(dt), _sums(dt), _sums(dz)
    cv, cs = _sums(~np.isnan(speed)), _sums(speed)
    flag, past = np.zeros(n, bool), 1

    def fast(a: int, b: int) -> bool:
        k = cv[b] - cv[a]
        return bool(k) and (cs[b] - cs[a]) / k >= 20

    end = np.minimum(n, _at(t, t[:n] + seconds))
    for i in map(int, np.flatnonzero((t[end] - t[:n] >= seconds / 2) & (z[end] - z[:n] >= 50))):
        if i >= past and fast(i, int(end[i])):
            j = int(end[i])
            while j < n and fast(max(i, j - 30), j) and z[j] - z[max(i, j - 30)] >= 0:
                j += 1
            flag[i:j] = True
            past = j
    return flag


def gaps(dt: np.ndarray, dz: np.ndarray) -> np.ndarray:
    return (dt >= 200) & (dz >= 100)


#: Detectors over legs: name to function of (dt, dist, ele_delta, speed, lat, lon).  ``lift`` and ``bike`` are candidates, which ``lifts.detected`` completes.
DETECTORS: dict[str, Callable[..., np.ndarray]] = {
    "time_gap": lambda t, s, z, v, y, x: gaps(t, z),
    "speed_sinuosity": lambda t, s, z, v, y, x: steady(t, s, z, v, y, x),
    "elevation_rate": lambda t, s, z, v, y, x: rising(t, z, 5.0, 25.0),
    "elevation_rate_high": lambda t, s, z, v, y, x: rising(t, z, 15.0, 40.0),
    "shuttle": lambda t, s, z, v, y, x: shuttle(t, z, v),
    "heuristic": lambda t, s, z, v, y, x: gaps(t, z) | steady(t, s, z, v, y, x),
    "lift": lambda t, s, z, v, y, x: rising(t, z, 5.0, 25.0) | gaps(t, z),
    "bike": lambda t, s, z, v, y, x: rising(t, z, 15.0, 40.0) | gaps(t, z) | shuttle(t, z, v),
}


def _leg_columns(track: pa.Table) -> list[np.ndarray]:
    return [track.column(c).to_numpy().astype(float) if c in track.column_names else np.full(track.num_rows, np.nan) for c in ("dt", "dist", "ele_delta", "speed", "lat", "lon")]


def detect(legs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A flag column for each detector, for each point of ``legs(activity_id, seq, dt, dist, ele_delta, speed)``, which may have ``lat`` and ``lon``.

    All detectors run in one pass over a track; where tracks are filtered, filter before.
    """
    names = names or list(DETECTORS)

    def kernel(track: pa.Table) -> pa.Table:
        track = track.take(np.argsort(track.column("seq").to_numpy(), kind="stable"))
        cols = _leg_columns(track)
        flags = {k: DETECTORS[k](*cols) for k in names if k != "heuristic"}
        if "heuristic" in names:  # of two that are often asked for as well
            parts = [flags[k] if k in flags else DETECTORS[k](*cols) for k in ("time_gap", "speed_sinuosity")]
            flags["heuristic"] = parts[0] | parts[1]
        return pa.table({"activity_id": track.column("activity_id").cast(pa.int64()), "seq": track.column("seq").cast(pa.int64())} | {k: pa.array(flags[k]) for k in names})

    schema = ASSIST + "".join(f", {k} boolean" for k in names)
    given = [c for c in ("activity_id", "seq", "dt", "dist", "ele_delta", "speed", "lat", "lon") if c in legs.columns]
    return legs.select(*given).groupBy("activity_id").applyInArrow(kernel, schema)


def flagged_segments(flag: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each flagged run; a run begins with the point before it."""
    turn = np.flatnonzero(flag[1:] != np.concatenate([[False], flag[1:-1]])) + 1 if len(flag) > 1 else np.zeros(0, int)
    at = [int(k) for k in turn] + [len(flag)] * (len(turn) % 2)
    return [(a - 1, b - 1) for a, b in zip(at[::2], at[1::2], strict=True)]


def _trim_to_cable_speed(start: int, end: int, speed: np.ndarray) -> tuple[int, int]:
    trim = min(45, (end - start) // 4)
    fast = np.nan_to_num(speed) >= 6.0
    head, tail = np.flatnonzero(fast[start : start + trim]), np.flatnonzero(fast[end - trim + 1 : end + 1])
    return start + int(head[0]) if len(head) else start, end - trim + 1 + int(tail[-1]) if len(tail) else end


def _trim_to_slowest(start: int, end: int, speed: np.ndarray) -> tuple[int, int]:
    def slowest(a: int, b: int, other: int) -> int:
        part = speed[a:b]
        return a + int(np.nanargmin(part)) if len(part) and not np.isnan(part).all() else other

    first = slowest(start, min(start + 30, end), start)
    return first, slowest(max(end - 30, first), end + 1, end)


#: Detectors with known lifts: the flags whose union they start from, and how a segment that no lift matches is trimmed.
COMPOSED: dict[str, tuple[tuple[str, ...], Callable[[int, int, np.ndarray], tuple[int, int]]]] = {
    "speed_osm": (("speed_sinuosity", "time_gap"), _trim_to_cable_speed),
    "smart": (("elevation_rate", "speed_sinuosity", "time_gap"), _trim_to_cable_speed),
    "lift": (("elevation_rate", "time_gap"), _trim_to_slowest),
    "bike": (("elevation_rate_high", "time_gap", "shuttle", "osm"), lambda start, end, speed: (start, end)),
}


def candidate_segments(legs: DataFrame, names: list[str], gain: float = 50.0) -> DataFrame:
    """Segments of the union of flags of each of ``names`` in ``COMPOSED`` that climb ``gain`` metres, with their ends as trimmed; ``legs`` has ``lat``, ``lon`` and ``osm`` too."""

    out = pa.schema([("algorithm", pa.string()), *((c, pa.int64()) for c in ("activity_id", "start", "end", "from", "to"))])

    def kernel(track: pa.Table) -> pa.Table:
        seq = track.column("seq").to_numpy()
        order = np.argsort(seq, kind="stable")
        seq, of = seq[order], lambda c: track.column(c).to_numpy()[order]
        cols = [of(c).astype(float) for c in ("dt", "dist", "ele_delta", "speed", "lat", "lon")]
        flags = {"osm": of("osm").astype(bool)} | {k: DETECTORS[k](*cols) for k in sorted({p for n in names for p in COMPOSED[n][0]} - {"osm"})}
        z, rows = _sums(cols[2]), []
        for name in names:
            parts, trim = COMPOSED[name]
            for a, b in flagged_segments(np.logical_or.reduce([flags[p] for p in parts])):
                if z[b + 1] - z[a] >= gain:
                    lo, hi = trim(a, b, cols[3])
                    rows.append((name, track.column("activity_id")[0].as_py(), int(seq[a]), int(seq[b]), int(seq[lo]), int(seq[hi])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(out), out, strict=True)], schema=out)

    # dealt in a number of partitions that adaptive execution keeps (one more than usual, or Spark leaves the exchange out after another by track): rows are small, what is done with them is not
    parts = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    legs = legs.select("activity_id", "seq", "dt", "dist", "ele_delta", "speed", "lat", "lon", "osm").repartition(parts + 1, "activity_id")
    return legs.groupBy("activity_id").applyInArrow(kernel, "algorithm string, activity_id long, start long, end long, `from` long, `to` long")


def rides_between(stops: DataFrame, least_s: float = 60, most_s: float = 1800, gain: float = 50.0) -> DataFrame:
    """Rides of ``stops(activity_id, lift, seq, t_s, up, stop)`` from a lift's one station to the other, in either direction: from the first point near the one after the last ride to the first near the other within the time, if ``up``, the climb so far, grows by ``gain``."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        key, stop, seqs = pdf["lift"].to_numpy(), pdf["stop"].to_numpy() == "b", pdf["seq"].to_numpy()
        order = np.lexsort((seqs, stop, key))  # words take long to sort
        key, stop, seqs = key[order], stop[order], seqs[order]
        rows, activity = [], int(pdf["activity_id"].iloc[0])
        times, ups = (pdf[c].to_numpy(float)[order] for c in ("t_s", "up"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (stop[1:] != stop[:-1])) + 1
        sides = [slice(x, y) for x, y in zip([0, *cuts], [*cuts, len(key)], strict=True)]
        both = [(x, y) for x, y in zip(sides[:-1], sides[1:], strict=True) if key[x.start] == key[y.start]]
        for low, high in [*both, *((y, x) for x, y in both)]:
            if seqs[low.start] >= seqs[high.stop - 1]:
                continue  # all of the one come after the other
            s0, t0, u0, s1, t1, u1 = seqs[low], times[low], ups[low], seqs[high], times[high], ups[high]
            far = np.maximum(np.searchsorted(t1, t0 + least_s, "left"), np.searchsorted(s1, s0, "right"))
            past = np.searchsorted(s0, s1, "right")
            able = (far < len(s1)) & (t1[np.minimum(far, len(s1) - 1)] - t0 <= most_s)
            i = 0
            for k in np.flatnonzero(able):
                if k < i:
                    continue
                j = far[k]
                i = past[j]
                if u1[j] - u0[k] >= gain:
                    rows.append((activity, int(key[low.start]), int(s0[k]), int(s1[j])))
        return pd.DataFrame(rows, columns=["activity_id", "lift", "start", "end"])

    return stops.groupBy("activity_id").applyInPandas(kernel, "activity_id long, lift long, start long, end long")


Part = tuple[int, int, bool]  #: first place, place after the last, and whether it runs forward


def _split_linear(progress: np.ndarray, turn: float = 0.2) -> list[Part]:
    """Parts of a ride along a line, split where it turns back by ``turn`` of the length; the turning point belongs to both parts.

    The first way is that of the first rise of ``turn`` above the least value
    so far, or of a single drop of as much below it; without either all is one
    part.  A turn is noticed once the ride is ``turn`` behind its farthest
    point; it lies where the steady return up to there began.
    """
    n = len(progress)
    if n < 4:
        return [(0, n, True)]
    moved = progress[1:] - np.minimum.accumulate(progress)[:-1]
    first = np.flatnonzero(np.abs(moved) >= turn)
    if not len(first):
        return [(0, n, bool(progress[-1] >= progress[0]))]
    ahead, parts, start = bool(moved[first[0]] > 0), [], 0
    far = progress[0]
    for k in range(1, n):
        gone = progress[k] - far if ahead else far - progress[k]
        if gone > 0:
            far = progress[k]
        elif -gone >= turn:
            at = k - 1
            while at > start and (progress[at - 1] > progress[at] if ahead else progress[at - 1] < progress[at]):
                at -= 1
            parts.append((start, at + 1, ahead))
            start, ahead, far = at, not ahead, progress[k]
    return [*parts, (start, n, ahead)]


def _split_loop(angle: np.ndarray) -> list[Part]:
    """Laps of a ride around a loop; what is left after the last one counts from an eighth of a turn on, or if it is all."""
    if len(angle) < 4:
        return [(0, len(angle), True)]
    parts, start = [], 0
    for k in range(len(angle)):
        moved = angle[k] - angle[start]
        if abs(moved) >= 2 * np.pi:
            parts.append((start, k + 1, bool(moved > 0)))
            start = k
    rest = angle[-1] - angle[start]
    return [*parts, (start, len(angle), bool(rest >= 0))] if abs(rest) > np.pi / 4 or not parts else parts


def _fold_short(parts: list[Part], least: int) -> list[Part]:
    """Parts of fewer than ``least`` points with the longer of their neighbours, the one before of equals, whose way they take."""
    size = lambda p: p[1] - p[0]
    while len(parts) > 1 and (k := next((i for i, p in enumerate(parts) if size(p) < least), None)) is not None:
        before = k > 0 and (k == len(parts) - 1 or size(parts[k - 1]) >= size(parts[k + 1]))
        i = k - 1 if before else k
        one, two = parts[i], parts[i + 1]
        parts[i : i + 2] = [(one[0], two[1], one[2] if before else two[2])]
    return parts


def _median(x: np.ndarray, window: int) -> np.ndarray:
    """Centred upper median, over what there is at the ends."""
    if len(x) < 3:
        return x
    half, n = window // 2, len(x)
    padded = np.sort(np.stack([np.concatenate([np.full(max(0, -d), np.inf), x[max(0, d) : n + min(0, d)], np.full(max(0, d), np.inf)]) for d in range(-half, half + 1)]), 0)
    count = np.minimum(np.arange(n), half) + np.minimum(np.arange(n)[::-1], half) + 1
    return padded[count // 2, np.arange(n)]


_KINDS = {"activity_id": pa.int64(), "name": pa.string(), "chain": pa.int64(), "part": pa.int32(), "start": pa.int64(), "end": pa.int64(), "along": pa.bool_(), "moved": pa.float64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for c, n in zip(columns, names, strict=True)], names)


def traversals(points: DataFrame, loop: bool = False, least: int = 8, turn: float = 0.2, window: int = 9) -> DataFrame:
    """Traversals of ``points(activity_id, name, seq, progress)``: each run, smoothed, split where it turns back (or, around a loop, comes round), parts of fewer than ``least`` points with a neighbour.

    With a column ``loop`` each name's own says which it is, with a column ``chain`` each chain of a name has its own traversals.
    """
    chained = "chain" in points.columns
    keys = ["activity_id", "name", *(["chain"] if chained else [])]
    points = points.select(*keys, "seq", "progress", "loop" if "loop" in points.columns else F.lit(loop).alias("loop"))

    names = [*keys, "part", "start", "end", "along", "moved"]

    def rows(run: pa.Table) -> list[tuple]:
        x, seq = _median(run.column("progress").to_numpy().astype(float), window), run.column("seq").to_numpy()
        parts = _fold_short(_split_loop(x) if run.column("loop")[0].as_py() else _split_linear(x, turn), least)
        key = [run.column(c)[0].as_py() for c in keys]
        return [(*key, k, int(seq[a]), int(seq[b - 1]), ahead, float(x[b - 1] - x[a])) for k, (a, b, ahead) in enumerate(parts)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come one after the other, many in a batch; the last one of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in keys:
                v = batch.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
                new[0] |= bool(held) and held[-1].column(c)[-1] != batch.column(c)[0]
            cuts = np.flatnonzero(new)
            if not len(cuts):
                held.append(batch)
                continue
            out = []
            if held or cuts[0]:
                out += rows(pa.Table.from_batches([*held, batch.slice(0, cuts[0])]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += rows(pa.Table.from_batches([batch.slice(a, b - a)]))
            held = [batch.slice(cuts[-1])]
            yield _batch(out, names)
        if held:
            yield _batch(rows(pa.Table.from_batches(held)), names)

    # dealt by track in a number of partitions that adaptive execution keeps: a call for each run would cost more than what is done in it
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.repartition(parts, "activity_id").sortWithinPartitions(*keys, "seq")
    return dealt.mapInArrow(kernel, "activity_id long, name string" + ", chain long" * chained + ", part int, start long, end long, along boolean, moved double")


def coalesce_runs(runs: DataFrame, gap: float = 120.0, detour: float = 60.0) -> DataFrame:
    """Runs of ``runs(activity_id, name, start_t, end_t, ridden_km)`` merged: of the same name within ``gap`` seconds, and around another one of at most ``detour`` seconds, which goes."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [list(r) for r in pdf[["activity_id", "name", "start_t", "end_t", "ridden_km"]].sort_values("start_t").itertuples(index=False)]
        out, after = rows[:1], rows[1:][::-1]

        def join(row: list) -> None:
            out[-1][3], out[-1][4] = row[3], out[-1][4] + row[4]

        while after:
            row = after.pop()
            if row[1] == out[-1][1] and row[2] - out[-1][3] <= gap:
                join(row)
            elif after and after[-1][1] == out[-1][1] != row[1] and row[3] - row[2] <= detour:
                join(after.pop())
            else:
                out.append(row)
        return pd.DataFrame(out, columns=["activity_id", "name", "start_t", "end_t", "ridden_km"])

    return runs.groupBy("activity_id").applyInPandas(kernel, "activity_id long, name string, start_t long, end_t long, ridden_km double")


def chains(ways: DataFrame, groups: DataFrame, metres: float = 5.0) -> DataFrame:
    """Ways of the same name linked end to end: for each the chain (its first way), its place in it and whether it runs backwards there; greedily from the first way on.

    ``ways(name, way_pos, ax, ay, bx, by)``, ends in metres; ``groups(way_pos, c)``
    has the ways that hang together, outside which no chain can reach, so
    that a name with many ways is no single task.  Ends are found on cells.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.sort_values("way_pos")[["way_pos", "ax", "ay", "bx", "by"]].to_numpy()
        ends = {int(r[0]): ((r[1], r[2]), (r[3], r[4])) for r in ids}
        near = lambda p, q: np.hypot(p[0] - q[0], p[1] - q[1]) <= metres
        # a little wider than what is near, for rounding
        cell = lambda p: (int(p[0] // (1.01 * metres)), int(p[1] // (1.01 * metres)))
        cells: dict[tuple[int, int], list] = {}
        for v, pair in ends.items():
            for p in pair:
                cells.setdefault(cell(p), []).append((v, p))

        def found(p: tuple[float, float]) -> int | None:
            """First way left with an end near to ``p``; a cell is read no further than to the first found so far, and ways that are gone leave it once they are half of what was read."""
            x, y = cell(p)
            first = None
            for c in [(i, j) for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1)]:
                gone = 0
                for k, (v, q) in enumerate(cells.get(c, ())):
                    if first is not None and v >= first:
                        break
                    if v not in ends:
                        gone += 1
                    elif near(p, q):
                        first = v
                        break
                if gone > 16 and 2 * gone > k:
                    cells[c] = [e for e in cells[c] if e[0] in ends]
            return first

        rows = []
        for first in [int(r[0]) for r in ids]:
            if first not in ends:
                continue
            head, tail = ends.pop(first)
            chain = [(first, False)]
            while True:
                after, before = found(tail), found(head)
                if after is None and before is None:
                    break
                if before is None or (after is not None and after <= before):
                    a, b = ends.pop(after)
                    back = not near(tail, a)
                    chain.append((after, back))
                    tail = a if back else b
                else:
                    a, b = ends.pop(before)
                    back = near(head, a)
                    chain.insert(0, (before, back))
                    head = b if back else a
            rows += [(pdf["name"].iloc[0], v, first, i, back) for i, (v, back) in enumerate(chain)]
        return pd.DataFrame(rows, columns=["name", "way_pos", "chain", "place", "back"])

    return ways.join(groups, "way_pos").groupBy("name", "c").applyInPandas(kernel, "name string, way_pos long, chain long, place int, back boolean")
