"""Complete radius joins on the sphere: Voronoi cells around pivots in levels, replication by the triangle inequality, and a
vantage-point tree per cell with the exact great-circle metric.

Pivots are sampled in proportion to the places and arranged in a tree (pivots of pivots), so that a leaf cell holds about as many places
at every size, and a place is compared with a few dozen pivots a level. A partner within reach of a place lies, at every level,
no more than twice the reach farther from the place's own pivot than from its nearest: it is sent to all such cells, and the join is complete.
Equal places are joined once and expanded at the end. Only a cell that its pivots could not divide is cut into blocks that meet
pairwise, so that no task's input grows with a hot place. Places are told apart by their coordinates, never by a hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut

RADIUS_M = 6_371_000.0
#: Metres by which a chord computed in double precision and the haversine formula may differ, with room to spare.
SLACK_M = 0.01
#: The same for distances to pivots, which may be half the globe away.
LEVEL_SLACK_M = 1.0
#: Left places that a cell should hold, places of either side in one task at most, and pivots at most.
LEAF, BLOCK, MOST_PIVOTS = 1500, 6000, 200_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees, on a sphere; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point_of(geom: Column) -> tuple[Column, Column]:
    """(lon, lat) of a point in WKT (with or without SRID, Z, blanks) or GeoJSON; nulls unless it is usable.

    Usable: longitude within 180, latitude within 90 degrees of zero, and not 0 0. Empty, null and other geometries are not.
    """
    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
    wkt = r"(?i)^\s*(?:srid\s*=\s*\d+\s*;)?\s*point\s*(?:zm|z|m)?\s*\(\s*" + number + r"\s+" + number + r"(?:\s+[^()]*)?\)\s*$"
    plain = F.regexp_replace(geom, r"\s+", " ")
    is_point = geom.rlike(r'(?i)"type"\s*:\s*"point"')
    json = r'(?i)"coordinates"\s*:\s*\[\s*' + number + r"\s*,\s*" + number

    def part(n: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(plain, wkt, n), F.lit("")), F.when(is_point, F.nullif(F.regexp_extract(plain, json, n), F.lit("")))).try_cast("double")

    lon, lat = part(1), part(2)
    usable = lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))
    return F.when(usable, lon), F.when(usable, lat)


def _unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def _metres(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Great-circle metres from every row of `vectors` to every row of `to`."""
    chord = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ to.T)))
    # the dot product loses short distances; those are taken from the difference
    near = np.argwhere(chord < 1e-3)
    if len(near):
        i, j = near[:, 0], near[:, 1]
        chord[i, j] = np.sqrt(((vectors[i] - to[j]) ** 2).sum(axis=1))
    return 2.0 * RADIUS_M * np.arcsin(np.minimum(1.0, chord / 2.0))


class PivotTree:
    """Pivots in levels: every node has up to FAN of them, each with a node of its own below; the lowest level's pivots are the cells."""

    FAN = 48

    def __init__(self, pivots: np.ndarray) -> None:
        self.cells = 0
        self.root = self._build(pivots)

    def _build(self, pivots: np.ndarray):
        if len(pivots) <= self.FAN:
            first = self.cells
            self.cells += len(pivots)
            return pivots, first, None
        top = pivots[: self.FAN]
        home = np.concatenate([_metres(pivots[i : i + 4096], top).argmin(axis=1) for i in range(0, len(pivots), 4096)])
        if np.bincount(home).max() == len(pivots):  # nothing tells them apart
            first = self.cells
            self.cells += 1
            return top[:1], first, None
        there = [k for k in range(len(top)) if (home == k).any()]
        return top[there], -1, [self._build(pivots[home == k]) for k in there]

    def assign(self, vectors: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home). Without reach every row goes to its home cell; with it, also to every cell that a partner within `reach`
        metres may call home: at each level d(row, pivot) - d(row, nearest) <= 2 reach."""
        rows, cells, homes = [], [], []
        stack = [(self.root, np.arange(len(vectors)), np.ones(len(vectors), bool))]
        while stack:
            (pivots, first, below), own, home = stack.pop()
            d = _metres(vectors[own], pivots)
            nearest = d.argmin(axis=1)
            if reach is None:
                i, j = np.arange(len(own)), nearest
            else:
                i, j = np.nonzero(d - d.min(axis=1)[:, None] <= 2.0 * (reach[own][:, None] + LEVEL_SLACK_M))
            at_home = home[i] & (j == nearest[i])
            if below is None:
                rows.append(own[i]), cells.append(first + j), homes.append(at_home)
                continue
            order = np.argsort(j, kind="stable")
            i, j, at_home = i[order], j[order], at_home[order]
            edges = np.searchsorted(j, np.arange(len(pivots) + 1))
            stack += [(below[k], own[i[edges[k] : edges[k + 1]]], at_home[edges[k] : edges[k + 1]]) for k in range(len(pivots)) if edges[k] < edges[k + 1]]
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def choose_pivots(places: DataFrame, leaf: int = LEAF, most: int = MOST_PIVOTS, seed: int = 7) -> PivotTree:
    """A tree of about one pivot per `leaf` places, `most` at most: a bounded sample by hash, the same on every run."""
    n = max(1, min(most, math.ceil(places.count() / leaf)))
    order = F.xxhash64("lat", "lon", F.lit(seed))
    rows = places.select("lat", "lon", order.alias("h")).orderBy("h", "lat", "lon").limit(n).toPandas()
    if rows.empty:
        rows = pd.DataFrame({"lat": [0.0], "lon": [0.0]})
    return PivotTree(_unit_vectors(rows.lat.to_numpy(float), rows.lon.to_numpy(float)))


class VantageTree:
    """A vantage-point tree over unit vectors; queries descend in groups, node by node."""

    LEAF = 48

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.LEAF:
            return rows
        point = self.vectors[rows[:1]]
        d = _metres(self.vectors[rows], point)[:, 0]
        middle = float(np.median(d))
        inner = d <= middle
        if inner.all():
            return rows
        return point, middle, self._build(rows[inner]), self._build(rows[~inner])

    def within(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs no farther apart than the query's reach, plus slack."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(queries)))]
        reach = reach + SLACK_M
        while stack:
            node, active = stack.pop()
            if not len(active):
                continue
            if isinstance(node, np.ndarray):
                for start in range(0, len(active), 2048):
                    some = active[start : start + 2048]
                    i, j = np.nonzero(_metres(queries[some], self.vectors[node]) <= reach[some][:, None])
                    found.append((some[i], node[j]))
                continue
            point, middle, inner, outer = node
            d = _metres(queries[active], point)[:, 0]
            stack.append((inner, active[d - reach[active] <= middle]))
            stack.append((outer, active[d + reach[active] >= middle]))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _assigned(places: DataFrame, tree, reach: Column | None) -> DataFrame:
    """Adds cell and home: one row per cell that needs the place; `tree` is a broadcast PivotTree."""
    apart = reach is None
    df = places if apart else places.withColumn("reach", reach)

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                v = _unit_vectors(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float))
                i, c, h = tree.value.assign(v, None if apart else pdf.reach.to_numpy(float))
                yield pdf.iloc[i].assign(cell=c.astype(np.int32), home=h)

    return df.mapInPandas(cells, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())]))


def _blocks(homes: DataFrame, copies: DataFrame, block: int) -> DataFrame:
    """cell, nl, nr of the cells that hold more than `block` places of either side: one row per such cell."""
    counts = [df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((homes, "nl"), (copies, "nr"))]
    return counts[0].join(counts[1], "cell").filter("nl > 1 or nr > 1")


def _met(homes: DataFrame, copies: DataFrame, payload: list[str], block: int, once: bool) -> DataFrame:
    """llat, llon and the payload of the copies within reach. homes, copies: rows of `_assigned` (cut, as they are read twice)."""
    cuts = _blocks(homes, copies, block)
    lot = F.xxhash64("lat", "lon")  # any spread will do
    nl, nr = F.coalesce("nl", F.lit(1)), F.coalesce("nr", F.lit(1))
    ls = homes.select("cell", "lat", "lon").join(cuts, "cell", "left")
    rs = copies.select("cell", "lat", "lon", "reach", *payload).join(cuts, "cell", "left")
    ls = ls.select(F.lit(0).alias("side"), "cell", "lat", "lon", F.pmod(lot, nl).cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), nr - 1)).alias("rb"))
    rs = rs.select(F.lit(1).alias("side"), "cell", "lat", "lon", "reach", *payload, F.explode(F.sequence(F.lit(0), nl - 1)).alias("lb"), F.pmod(lot, nr).cast("int").alias("rb"))
    out = T.StructType([T.StructField("llat", T.DoubleType()), T.StructField("llon", T.DoubleType()), *[copies.schema[c] for c in payload]])
    names = out.fieldNames()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if a.empty or b.empty:
            return pd.DataFrame({n: pdf[n if n in pdf else n[1:]].iloc[:0] for n in names})
        tree = VantageTree(_unit_vectors(a.lat.to_numpy(float), a.lon.to_numpy(float)))
        i, j = tree.within(_unit_vectors(b.lat.to_numpy(float), b.lon.to_numpy(float)), b.reach.to_numpy(float))
        la, lo = a.lat.to_numpy(float)[j], a.lon.to_numpy(float)[j]
        if once:  # of a pair and its mirror the one whose left place is the smaller; equal places meet themselves
            ra, ro = b.lat.to_numpy(float)[i], b.lon.to_numpy(float)[i]
            keep = (la < ra) | (la == ra) & (lo <= ro)
            i, la, lo = i[keep], la[keep], lo[keep]
        return pd.DataFrame({"llat": la, "llon": lo, **{c: b[c].to_numpy()[i] for c in payload}})

    return ls.unionByName(rs, allowMissingColumns=True).groupBy("cell", "lb", "rb").applyInPandas(meet, out)


def radius_candidates(left: DataFrame, right: DataFrame, reach_m: float, payload: list[str], leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """All (left place, right thing) pairs that may lie within reach: llat, llon and the right thing's `payload` columns.

    left: lat, lon, one row per place; right: lat, lon, extra (metres by which the right thing extends from its point) and the
    payload. Complete: pairs nearer than reach_m + extra are all there; a caller's exact test follows. Empty inputs give no rows.
    `leaf` is the number of left places a cell should hold, `block` the most of either side in one task.
    """
    tree = left.sparkSession.sparkContext.broadcast(choose_pivots(left, leaf))  # at most MOST_PIVOTS vectors
    homes = cut(_assigned(left.select("lat", "lon"), tree, None))
    copies = cut(_assigned(right.select("lat", "lon", "extra", *[c for c in payload if c not in ("lat", "lon", "extra")]), tree, F.col("extra") + F.lit(float(reach_m))))
    return _met(homes, copies, payload, block, once=False)


def _places(points: DataFrame) -> DataFrame:
    """Distinct (lat, lon); zeros without a sign, lest one place be two."""
    return points.select((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")).distinct()


def _placed(points: DataFrame, key: str, side: str) -> DataFrame:
    return points.select(key, (F.col("lat") + 0.0).alias(f"{side}lat"), (F.col("lon") + 0.0).alias(f"{side}lon"))


def _exact(near: DataFrame, radius_m: float) -> DataFrame:
    metres = haversine(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    return near.withColumn("metres", metres).filter(F.col("metres") <= radius_m)


def pairs_within(left: DataFrame, right: DataFrame, radius_m: float, **sizes) -> DataFrame:
    """Inclusive radius join of points: left (lid, lat, lon), right (rid, lat, lon) -> lid, rid, metres by haversine.

    Rows without coordinates match nothing; repeated rows match as often as they occur.
    """
    left, right = left.filter("lat is not null and lon is not null"), right.filter("lat is not null and lon is not null")
    rp = _places(right).withColumns({"extra": F.lit(0.0), "rlat": F.col("lat"), "rlon": F.col("lon")})
    exact = _exact(radius_candidates(cut(_places(left)), rp, radius_m, ["rlat", "rlon"], **sizes), radius_m)
    return exact.join(_placed(left, "lid", "l"), ["llat", "llon"]).join(_placed(right, "rid", "r"), ["rlat", "rlon"]).select("lid", "rid", "metres")


def self_pairs_within(points: DataFrame, radius_m: float, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Pairs of one set of points (id, lat, lon), each pair once: a_id < b_id, metres by haversine, inclusive.

    Every place is assigned once, to its home and the cells in reach. Rows without coordinates match nothing; of rows with one id
    none matches another.
    """
    points = points.filter("lat is not null and lon is not null")
    places = cut(_places(points))
    tree = points.sparkSession.sparkContext.broadcast(choose_pivots(places, leaf))
    every = cut(_assigned(places.withColumns({"rlat": F.col("lat"), "rlon": F.col("lon")}), tree, F.lit(float(radius_m))))
    exact = _exact(_met(every.filter("home"), every, ["rlat", "rlon"], block, once=True), radius_m)
    both = exact.join(_placed(points, "id", "l").withColumnRenamed("id", "x"), ["llat", "llon"]).join(_placed(points, "id", "r").withColumnRenamed("id", "y"), ["rlat", "rlon"])
    # within one place both orders of two rows come up, of which one is kept
    both = both.filter((F.col("x") < F.col("y")) | (F.col("x") > F.col("y")) & ((F.col("llat") != F.col("rlat")) | (F.col("llon") != F.col("rlon"))))
    return both.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), "metres")


def line_pieces(lines: DataFrame, geom: str = "geom", most_m: float = 200.0) -> DataFrame:
    """sid, x1, y1, x2, y2 (degrees, x running on across the date line) of every straight piece of at most `most_m` metres.

    Lines without two usable vertices give no pieces.
    """
    inner = F.regexp_extract(F.regexp_replace(geom, r"\s+", " "), r"(?i)^\s*(?:srid=\d+;)?\s*linestring\s*(?:zm|z|m)?\s*\(([^()]*)\)", 1)
    xy = F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.struct(F.try_element_at(F.split(p, " "), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(F.split(p, " "), F.lit(2)).try_cast("double").alias("y")))
    xy = F.filter(xy, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    df = lines.select(F.col("id").alias("sid"), xy.alias("v")).filter(F.size("v") > 1)
    df = df.select("sid", F.posexplode(F.slice("v", 1, F.size("v") - 1)).alias("k", "a"), "v").select("sid", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("v")[F.col("k") + 1].alias("b"))
    step = F.col("b.x") - F.col("x1")
    step = F.when(step > 180, step - 360).when(step < -180, step + 360).otherwise(step)
    df = df.select("sid", "x1", "y1", (F.col("x1") + step).alias("x2"), F.col("b.y").alias("y2"))
    degree = math.pi * RADIUS_M / 180
    long_m = degree * F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    df = df.withColumn("n", F.greatest(F.lit(1), F.ceil(long_m / most_m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, i: F.when(i == 0, F.col(a)).when(i == F.col("n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * i / F.col("n"))
    i, j = F.col("i"), F.col("i") + 1
    return df.select("sid", at("x1", "x2", i).alias("x1"), at("y1", "y2", i).alias("y1"), at("x1", "x2", j).alias("x2"), at("y1", "y2", j).alias("y2"))


def plane_metres(lat: Column, lon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres from a point to a straight piece, in the plane scaled at the point's latitude."""
    degree = math.pi * RADIUS_M / 180
    wrap = lambda d: d - 360 * F.round(d / 360)
    k = F.cos(F.radians(lat))
    ax, ay = wrap(x1 - lon) * k * degree, (y1 - lat) * degree
    dx, dy = (x2 - x1) * k * degree, (y2 - y1) * degree
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def nearest_line(points: DataFrame, lines: DataFrame, radius_m: float, **sizes) -> DataFrame:
    """For every point (lid, lat, lon) the nearest line (id, geom) if within radius: lid, sid, metres rounded to 6 decimals.

    Ties go to the smaller id. Points without coordinates and lines without two vertices match nothing.
    """
    points = points.filter("lat is not null and lon is not null")
    pieces = line_pieces(lines).filter("sid is not null")
    balls = pieces.select("sid", "x1", "y1", "x2", "y2", ((F.col("y1") + F.col("y2")) / 2).alias("lat"), (F.col("x1") / 2 + F.col("x2") / 2).alias("lon"))
    reach = F.greatest(haversine(F.col("lat"), F.col("lon"), F.col("y1"), F.col("x1")), haversine(F.col("lat"), F.col("lon"), F.col("y2"), F.col("x2")))
    # the plane and the sphere differ by a little over a piece's length
    balls = balls.withColumn("extra", reach * 1.02 + 0.02 * radius_m + 1.0)
    near = radius_candidates(cut(_places(points)), balls, radius_m, ["sid", "x1", "y1", "x2", "y2"], **sizes)
    metres = F.round(plane_metres(F.col("llat"), F.col("llon"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 6)
    best = near.select("llat", "llon", "sid", metres.alias("metres")).filter(F.col("metres") <= radius_m).groupBy("llat", "llon").agg(F.min(F.struct("metres", "sid")).alias("b"))
    return _placed(points, "lid", "l").join(best, ["llat", "llon"]).select("lid", F.col("b.sid").alias("sid"), F.col("b.metres").alias("metres"))


def located(df: DataFrame, id_column: str, out: str) -> DataFrame:
    """out, lat, lon of the rows with a usable point."""
    lon, lat = point_of(F.col("geom"))
    return df.select(F.col(id_column).alias(out), lat.alias("lat"), lon.alias("lon")).filter("lat is not null")


def near_reports(reports: DataFrame, images: DataFrame, segments: DataFrame, report_m: float = 20.0, image_m: float = 30.0, segment_m: float = 50.0, **sizes) -> DataFrame:
    """other_table, report_id, other_id: reports near reports (smaller id first), images near reports, each report's segment."""
    r = cut(located(reports, "id", "lid"))  # parsed once, joined three times
    pairs = self_pairs_within(r.withColumnRenamed("lid", "id"), report_m, **sizes).withColumnsRenamed({"a_id": "lid", "b_id": "rid"})
    shots = pairs_within(r, cut(located(images, "id", "rid")), image_m, **sizes)
    on = nearest_line(r, segments, segment_m, **sizes)
    parts = [("reports", pairs, "rid"), ("images", shots, "rid"), ("segments", on, "sid")]
    frames = [df.select(F.lit(name).alias("other_table"), F.col("lid").alias("report_id"), F.col(other).alias("other_id")) for name, df, other in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
