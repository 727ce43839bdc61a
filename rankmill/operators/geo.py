"""Map features: codes, bounding box, joins with values, simplification.

Every step works on one feature's own row, so none of them shuffles but the join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from rankmill.functions import arcs, projection, rings
from rankmill.functions.bind import let
from rankmill.functions.text import only_digits, strip, zero_fill
from rankmill.operators.joins import join_per_key
from rankmill.operators.select import pick_column
from rankmill.session import stored
from rankmill.sources.geo import GEOMETRY

# Candidate property names, the box around the mapped country, tolerances.
NAME_COLUMNS = ["kom_namn", "kommun", "name"]
CODE_COLUMNS = ["id", "kommun_kod", "kom_kod", "komkod"]
COUNTY_COLUMNS = ["lan_code", "lan_kod", "lanskod", "lan"]
COUNTY_NAME_COLUMNS = ["lan", "name", "region"]
COUNTY_CODE_COLUMNS = ["lan_kod", "l_id", "id", "code"]
PLAIN_COLUMNS = ["name", "namn", "kommun", "lan", "id", "kommun_kod", "lan_kod", "geometry"]
BOX = (10.5, 55.0, 24.5, 69.5)
BUILD_TOLERANCE, MAP_TOLERANCE = 0.003, 0.01
LON_LAT_SRID = 4326


def _required(df: DataFrame, name: str | None, code: str | None) -> None:
    if name is None or code is None:
        raise ValueError(f"need a name and a code column, found {df.columns}")


def municipality_features(df: DataFrame) -> DataFrame:
    """(kommun, kommun_kod[, lan_kod], geometry) whatever the columns are called."""
    name, code = pick_column(df.columns, NAME_COLUMNS, "exact"), pick_column(df.columns, CODE_COLUMNS, "exact")
    county = pick_column(df.columns, COUNTY_COLUMNS, "exact")
    _required(df, name, code)
    columns = [
        strip(F.col(name).cast("string")).alias("kommun"),
        zero_fill(only_digits(code), 4).alias("kommun_kod"),
    ]
    if county:
        columns.append(zero_fill(only_digits(county), 2).alias("lan_kod"))
    return df.select(*columns, "geometry")


def county_features(df: DataFrame) -> DataFrame:
    """(lan, lan_kod, geometry) whatever the columns are called."""
    name = pick_column(df.columns, COUNTY_NAME_COLUMNS, "exact")
    code = pick_column(df.columns, COUNTY_CODE_COLUMNS, "exact")
    _required(df, name, code)
    return df.select(
        strip(F.col(name).cast("string")).alias("lan"), zero_fill(only_digits(code), 2).alias("lan_kod"), "geometry"
    )


def plain_features(df: DataFrame) -> DataFrame:
    """Only the well-known columns, names as they are."""
    return df.select(*[c for c in df.columns if c.lower() in PLAIN_COLUMNS])


def _points(geometry: Column | str) -> Column:
    return F.flatten(F.flatten(F.col(geometry) if isinstance(geometry, str) else geometry))


def extent(geometry: Column | str) -> Column:
    """struct(xmin, ymin, xmax, ymax)"""

    def bounds(points: Column) -> Column:
        lon = F.transform(points, lambda p: F.get(p, F.lit(0)))
        lat = F.transform(points, lambda p: F.get(p, F.lit(1)))
        return F.struct(
            F.array_min(lon).alias("xmin"),
            F.array_min(lat).alias("ymin"),
            F.array_max(lon).alias("xmax"),
            F.array_max(lat).alias("ymax"),
        )

    return let(_points(geometry), bounds)


def in_box(df: DataFrame, box: Sequence[float] = BOX, geometry: str = "geometry") -> DataFrame:
    """Whole features that meet the box (xmin, ymin, xmax, ymax).

    The cheap test on extents comes first; only features that pass it but do not lie in the box
    altogether have their edges looked at.
    """
    xmin, ymin, xmax, ymax = (float(v) for v in box)

    def meets(e: Column) -> Column:
        apart = (e.xmin > xmax) | (e.xmax < xmin) | (e.ymin > ymax) | (e.ymax < ymin)
        within = (e.xmin >= xmin) & (e.xmax <= xmax) & (e.ymin >= ymin) & (e.ymax <= ymax)
        return F.when(apart, False).when(within, True).otherwise(_meets_box(F.col(geometry), xmin, ymin, xmax, ymax))

    return df.filter(let(extent(geometry), meets))


def _meets_box(geometry: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """An edge of the polygon crosses or lies in the box, or the polygon covers the box."""

    def xy(point: Column) -> tuple[Column, Column]:
        return F.get(point, F.lit(0)), F.get(point, F.lit(1))

    def edges(ring: Column) -> Column:
        return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def edge_meets(edge: Column) -> Column:
        # Clip the edge to the box: the part of it inside every side is [low, high] of its length.
        (x1, y1), (x2, y2) = xy(edge.a), xy(edge.b)
        low, high, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
        for start, end, least, most in ((x1, x2, xmin, xmax), (y1, y2, ymin, ymax)):
            step = F.nullif(end - start, F.lit(0.0))
            t1, t2 = (F.lit(least) - start) / step, (F.lit(most) - start) / step
            low, high = F.greatest(low, F.least(t1, t2)), F.least(high, F.greatest(t1, t2))
            outside = outside | (step.isNull() & ((start < least) | (start > most)))
        return ~outside & (low <= high)

    def crossings(ring: Column) -> Column:
        # Edges to the right of the box's corner; an odd number means the corner is inside the ring.
        def right(edge: Column) -> Column:
            (x1, y1), (x2, y2) = xy(edge.a), xy(edge.b)
            spans = (y1 > ymin) != (y2 > ymin)
            at = x1 + (F.lit(ymin) - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
            return spans & (F.lit(xmin) < at)

        return F.size(F.filter(edges(ring), right))

    def polygon_meets(rings: Column) -> Column:
        touches = F.exists(rings, lambda ring: F.exists(edges(ring), edge_meets))
        # Even-odd over all rings, so that a box inside a hole does not count as covered.
        total = F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring))
        return touches | (total % 2 == 1)

    return F.exists(geometry, polygon_meets)


def join_values(features: DataFrame, values: DataFrame, code: str) -> DataFrame:
    """Every feature, with the values of its code where there are any."""
    return join_per_key(features, values, [code], "left")


def with_srid(df: DataFrame, geometry: str = "geometry", srid: int = LON_LAT_SRID) -> DataFrame:
    """State that coordinates are lon/lat; raises on a coordinate that cannot be."""
    fine = let(extent(geometry), lambda e: (e.xmin >= -180) & (e.xmax <= 180) & (e.ymin >= -90) & (e.ymax <= 90))
    return df.withColumn("srid", F.when(~fine, F.raise_error("not lon/lat").cast("int")).otherwise(F.lit(srid)))


def to_lon_lat(df: DataFrame, srid: int, geometry: str = "geometry") -> DataFrame:
    """Coordinates of the plane grid ``srid`` as longitude and latitude, with ``srid`` stated as 4326.

    Lon/lat input stays as it is. A point's further coordinates, as heights, are left out.
    """
    if srid == LON_LAT_SRID:
        return with_srid(df, geometry)
    if srid not in projection.GRIDS:
        raise ValueError(f"unknown grid {srid}, known are {sorted(projection.GRIDS)}")
    grid = projection.GRIDS[srid]

    def point(p: Column) -> Column:
        return projection.lon_lat(F.get(p, F.lit(0)), F.get(p, F.lit(1)), grid)

    turned = F.transform(F.col(geometry), lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return with_srid(df.withColumn(geometry, turned), geometry)


def simplify(df: DataFrame, tolerance: float = MAP_TOLERANCE, geometry: str = "geometry") -> DataFrame:
    """Thin out rings; a tolerance of 0 leaves them alone. Neighbours are simplified independently.

    Bisection of a line at its farthest point has no built-in equivalent, so this one step runs in
    numpy, on the points of a whole Arrow batch of features at a time.
    """
    if not tolerance or float(tolerance) <= 0:
        return df

    # Workers get the helper with the query; they need not have this package installed.
    cloudpickle.register_pickle_by_value(rings)

    @F.arrow_udf(GEOMETRY)
    def thin(geometries: pa.Array) -> pa.Array:
        return rings.thin_batch(geometries, float(tolerance))

    return df.withColumn(geometry, thin(geometry))


def _junctions(rows: DataFrame) -> DataFrame:
    """(_id, _cuts) of geometries: places (polygon, ring, point) where arcs end.

    An arc ends where the rings that pass a point come from, or go to, different neighbours (``hard``). A ring that others
    share whole has no such point; its smallest one is listed, so that all are cut alike.
    """
    rings = rows.select("_id", F.posexplode("_geometry").alias("p", "polygon")).select("_id", "p", F.posexplode("polygon").alias("r", "ring"))
    # without the closing point and the closing point's heights
    rings = rings.select("_id", "p", "r", F.transform(F.slice("ring", F.lit(1), F.size("ring") - 1), lambda q: F.slice(q, 1, 2)).alias("ring")).filter(F.size("ring") > 0)
    visits = rings.select("*", F.size("ring").alias("n"), F.array_min("ring").alias("least"), F.posexplode("ring").alias("i", "at"))
    before, after = F.get("ring", (F.col("i") + F.col("n") - 1) % F.col("n")), F.get("ring", (F.col("i") + 1) % F.col("n"))
    pair = F.array(F.least(before, after), F.greatest(before, after))
    visits = visits.select("_id", "p", "r", "i", "at", pair.alias("pair"), (F.col("at") == F.col("least")).alias("least"))
    points = visits.groupBy("at").agg(F.min("pair").alias("low"), F.max("pair").alias("high"), F.bool_or("least").alias("least"), F.count(F.lit(1)).alias("visits"))
    hard = F.col("low") != F.col("high")
    cuts = points.filter(hard | (F.col("least") & (F.col("visits") > 1))).select("at", hard.alias("hard"))
    found = join_per_key(visits.select("_id", "p", "r", "i", "at"), cuts, ["at"])
    return found.groupBy("_id").agg(F.collect_list(F.struct("p", "r", "i", "hard")).alias("_cuts"))


def simplify_borders(df: DataFrame, tolerance: float = MAP_TOLERANCE, geometry: str = "geometry") -> DataFrame:
    """Thin out a map's polygons so that neighbours keep the same border and no ring crosses itself.

    Rings are cut into arcs where neighbours change; each arc is thinned in a direction both sides agree on, so they
    get the same points without being brought together. Only points that end arcs travel back to their geometries. Where a thinned ring
    would cross itself or another ring of its polygon, or fall to fewer than four points, its arcs at fault get a
    quarter of the tolerance on all sides, again and again; at last they keep all their points.
    Rows with equal geometries are treated alike; a missing geometry stays missing.
    """
    if not tolerance or float(tolerance) <= 0:
        return df
    for helper in (arcs, rings):
        cloudpickle.register_pickle_by_value(helper)
    text = F.to_json(F.struct(F.col(geometry).alias("g")))
    # A small file of many features is read by one task; what follows costs far more than dealing its rows out.
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = stored(dealt.withColumn("_id", F.array(F.xxhash64(F.lit(0), text), F.xxhash64(F.lit(1), text))))
    distinct = named.filter(F.col(geometry).isNotNull()).select("_id", F.col(geometry).alias("_geometry")).dropDuplicates(["_id"])
    rows = stored(join_per_key(distinct, _junctions(distinct), ["_id"], "left"))
    done = stored(_thinned(rows.withColumn("_levels", F.lit(None).cast(_LEVELS)), float(tolerance)))
    levels = None
    while True:
        faulty = stored(done.select(F.explode("_refine").alias("arc")).distinct())
        if faulty.isEmpty():
            break
        one = faulty.withColumn("level", F.lit(1))
        levels = stored(one if levels is None else levels.union(one).groupBy("arc").agg(F.sum("level").cast("int").alias("level")))
        used = done.select("_id", F.explode("_arcs").alias("arc"))
        touched = join_per_key(used, faulty, ["arc"]).select("_id").distinct()
        known = join_per_key(join_per_key(used, levels, ["arc"]), touched, ["_id"])
        known = known.groupBy("_id").agg(F.collect_list(F.struct("arc", "level")).alias("_levels"))
        again = stored(_thinned(join_per_key(rows, known, ["_id"]), float(tolerance)))
        done = stored(done.join(again.select(F.col("_id").alias("_redone")), F.col("_id") == F.col("_redone"), "left_anti").unionByName(again))
    return join_per_key(named, done.select("_id", "_thin"), ["_id"], "left").withColumn(geometry, F.col("_thin")).drop("_id", "_thin")


_CHUNK_POINTS = 8192
_LEVELS = "array<struct<arc: binary, level: int>>"


def _thinned(rows: DataFrame, tolerance: float) -> DataFrame:
    """(_id, _thin, _arcs, _refine): each geometry thinned under the levels of its arcs, all its arcs, and those at fault."""
    nested = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))

    def run(batches):
        for batch in batches:
            points = rings.points_before(batch.column("_geometry"))
            at = 0
            while at < len(batch):  # rows of some thousand points together, or one row of more
                upto = max(at + 1, int(points.searchsorted(points[at] + _CHUNK_POINTS, "right")) - 1)
                part = batch.slice(at, upto - at)
                rows = []
                for row in part.to_pylist():
                    cuts = {(c["p"], c["r"], c["i"]): c["hard"] for c in row["_cuts"] or ()}
                    rows.append((row["_geometry"], cuts, {bytes(x["arc"]): x["level"] for x in row["_levels"] or ()}))
                made = zip(*arcs.thin_geometries(rows, tolerance), strict=True)
                columns = [pa.array(m, t) for m, t in zip(made, (nested, pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], ["_id", "_thin", "_arcs", "_refine"])
                at = upto

    return rows.select("_id", "_geometry", "_cuts", "_levels").mapInArrow(run, f"_id array<long>, _thin {GEOMETRY}, _arcs array<binary>, _refine array<binary>")
