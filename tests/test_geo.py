import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import projection
from rankmill.operators import geo
from rankmill.sources import geo as source
from rankmill.sources.features import feature_objects, read_pieces


def square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


FEATURES = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"id": "SE 114", "kom_namn": " Ale ", "lan_code": 7}, "geometry": {"type": "Polygon", "coordinates": [square(12, 57)]}},
        {"type": "Feature", "properties": {"id": 1880, "kom_namn": "Örebro", "lan_code": 18}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(15, 59)], [square(30, 30)]]}},
    ],
}


@pytest.fixture
def features(spark, tmp_path):
    path = tmp_path / "kommuner.geojson"
    path.write_text(json.dumps(FEATURES))
    names = source.geojson_properties(spark, str(path))
    assert sorted(names) == ["id", "kom_namn", "lan_code"]
    return source.read_geojson(spark, str(path), names)


def test_properties_of_all_features(spark, tmp_path):
    path = tmp_path / "some.geojson"
    feature = lambda **p: {"type": "Feature", "properties": p, "geometry": None}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature(b=1), feature(b=1, a=2), feature(c=3)]}))
    assert source.geojson_properties(spark, str(path)) == ["b", "a", "c"]
    assert [r.geometry for r in source.read_geojson(spark, str(path), ["b"]).collect()] == [None] * 3
    path.write_text(json.dumps({"features": [{"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    with pytest.raises(Exception, match="not a polygon"):
        source.read_geojson(spark, str(path), []).collect()


def test_scan_and_codes(features):
    got = [(r.kommun, r.kommun_kod, r.lan_kod, len(r.geometry)) for r in geo.municipality_features(features).orderBy("kommun").collect()]
    assert got == [("Ale", "0114", "07", 1), ("Örebro", "1880", "18", 2)]
    assert geo.plain_features(features).columns == ["id", "geometry"]
    counties = geo.county_features(features.withColumnsRenamed({"kom_namn": "name"}))
    assert [r.lan_kod for r in counties.orderBy("lan").collect()] == ["114", "1880"]
    with pytest.raises(ValueError, match="name and a code"):
        geo.municipality_features(features.drop("id"))


def test_write_and_read_back(spark, features, tmp_path, rows):
    clean = geo.municipality_features(features)
    report = source.write_features(clean, str(tmp_path / "k.parquet"), str(tmp_path / "k.geojson"))
    assert report["features"] == 2 and report["columns"] == clean.columns
    again = source.read_features(spark, str(tmp_path / "k.parquet"))
    assert rows(again) == rows(clean.drop("lan_kod"))
    lines = source.read_geojson(spark, str(tmp_path / "k.geojson"), ["kommun", "kommun_kod", "lan_kod"], collection=False)
    assert rows(lines) == rows(clean)
    clean.drop("kommun").write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ValueError, match="missing columns"):
        source.read_features(spark, str(tmp_path / "bad.parquet"))


def test_feature_json(features):
    first = json.loads(source.feature_json(geo.municipality_features(features).orderBy("kommun")).first().feature)
    assert first["properties"] == {"kommun": "Ale", "kommun_kod": "0114", "lan_kod": "07"}
    assert first["geometry"] == {"type": "MultiPolygon", "coordinates": [[square(12, 57)]]}


def test_join_and_srid(spark, features, rows):
    values = spark.createDataFrame([("0114", 5)], "kommun_kod string, v int")
    joined = geo.join_values(geo.municipality_features(features).select("kommun_kod"), values, "kommun_kod")
    assert rows(joined) == [("0114", 5), ("1880", None)]
    assert {r.srid for r in geo.with_srid(features).collect()} == {4326}
    far = spark.createDataFrame([([[square(500, 0)]],)], f"geometry {source.GEOMETRY}")
    with pytest.raises(Exception, match="not lon/lat"):
        geo.with_srid(far).collect()


def test_box(spark):
    triangle = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [0.0, 0.0]]
    ring_with_hole = [square(-10, -10, 30.0), square(-5, -5, 20.0)]
    shapes = {
        "inside": [[square(6, 6)]], "outside": [[square(20, 20)]], "touches": [[square(8, 6)]],
        "extent only": [[triangle]], "covers": [[square(0, 0, 20.0)]], "in hole": [ring_with_hole],
        "edge crosses": [[[[0.0, 7.0], [20.0, 6.0], [20.0, 6.5], [0.0, 7.5], [0.0, 7.0]]]],
        "one part": [[square(20, 20)], [square(7, 7)]],
    }
    df = spark.createDataFrame(list(shapes.items()), f"name string, geometry {source.GEOMETRY}")
    got = {r.name for r in geo.in_box(df, (5.5, 5.5, 8.0, 8.0)).collect()}
    assert got == {"inside", "touches", "covers", "edge crosses", "one part"}


def slow_line(points, tolerance):
    """Plain recursive line simplification."""
    if len(points) < 3:
        return points
    a, b = np.array(points[0]), np.array(points[-1])
    base = b - a

    def away(p):
        t = np.clip(np.dot(p - a, base) / (np.dot(base, base) or 1), 0, 1)
        return math.hypot(*(np.array(p) - a - t * base))

    distances = [away(np.array(p)) for p in points[1:-1]]
    far = int(np.argmax(distances))
    if distances[far] <= tolerance:
        return [points[0], points[-1]]
    return slow_line(points[: far + 2], tolerance)[:-1] + slow_line(points[far + 1 :], tolerance)


def slow_ring(ring, tolerance):
    turn = int(np.argmax([math.hypot(x - ring[0][0], y - ring[0][1]) for x, y in ring]))
    return slow_line(ring[: turn + 1], tolerance)[:-1] + slow_line(ring[turn:], tolerance)


def blob(rng, n):
    angles = np.linspace(0, 2 * math.pi, n, endpoint=False)
    reach = 1 + 0.3 * rng.random(n)
    ring = np.stack([reach * np.cos(angles), reach * np.sin(angles)], 1).tolist()
    return ring + [ring[0]]


@pytest.mark.parametrize("tolerance", [0.01, 0.1, 0.25])
def test_simplify(spark, tolerance):
    rng = np.random.default_rng(3)
    data = [(i, [[blob(rng, 5 + 7 * i)], [blob(rng, 40), blob(rng, 12)]]) for i in range(12)] + [(99, None), (98, [])]
    df = spark.createDataFrame(data, f"i int, geometry {source.GEOMETRY}")
    got = {r.i: r.geometry for r in geo.simplify(df, tolerance).collect()}
    assert got[99] is None and got[98] == []
    for i, polygons in data[:12]:
        want = [[slow_ring(ring, tolerance) for ring in rings] for rings in polygons]
        assert [[len(r) for r in rings] for rings in got[i]] == [[len(r) for r in rings] for rings in want]
        assert got[i] == want


def test_simplify_keeps_rings_valid(spark):
    flat = [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [1.0, -0.02], [0.5, -0.01], [0.0, 0.0]]
    df = spark.createDataFrame([([[flat, square(0, 0)]],)], f"geometry {source.GEOMETRY}")
    ring, kept = geo.simplify(df, 5.0).first().geometry[0]
    assert len(ring) == 4 and ring[0] == ring[-1] and [1.0, -0.02] in ring
    assert len(kept) >= 4 and kept[0] == kept[-1]
    assert geo.simplify(df, 0) is df
    assert geo.simplify(df, 0.005).select(F.size(F.col("geometry")[0][0])).first()[0] == 5


def tricky_collection(n):
    """Braces, brackets and quotes in names, members before and behind the features, features of all sizes."""
    rng = random.Random(2)
    signs = ["{", "}", "[", "]", '"', "\\", "a", "å", "\n", ",", ":", "{}", "}}", '\\"']
    some = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))
    features = [
        {
            "type": "Feature",
            "id": str(i),
            "properties": {"name": some(), "deep": {"a": {"b": some()}}, "list": [some(), {"c": 1}]},
            "geometry": None if i % 7 == 0 else {"type": "Polygon", "coordinates": [square(i, j) for j in range(rng.choice([1, 1, 2, 40]))]},
        }
        for i in range(n)
    ]
    return {"type": "FeatureCollection", "name": "a}{b[" + some(), "crs": {"type": "name", "properties": {"name": "x}"}}, "features": features, "more": {"at": "end"}}


@pytest.mark.parametrize("indent", [None, 2])
def test_a_collection_is_read_by_several_tasks(spark, tmp_path, indent):
    made = tricky_collection(120)
    (tmp_path / "many.geojson").write_text(json.dumps(made, indent=indent, ensure_ascii=False))
    (tmp_path / "none.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        pieces = read_pieces(spark, str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 10
        got = [json.loads(r.feature) for r in feature_objects(pieces).orderBy("source_file", "at").collect()]
        assert got == made["features"]
        rows = source.read_geojson(spark, str(tmp_path / "many.geojson"), ["name"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(f["properties"]["name"], f["geometry"] and [f["geometry"]["coordinates"]]) for f in made["features"]]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(([r.name, r.geometry] for r in rows), key=key) == sorted(map(list, want), key=key)


# Published control points of the national grid: latitude and longitude as (degrees, minutes), northing, easting.
CONTROL_POINTS = [
    ((55, 0), (12, 45), 6097106.672, 356083.438),
    ((55, 0), (14, 15), 6095048.642, 452024.069),
    ((57, 0), (12, 45), 6319636.937, 363331.554),
    ((57, 0), (19, 30), 6326392.707, 773251.054),
    ((59, 0), (11, 15), 6546096.724, 284626.066),
    ((59, 0), (19, 30), 6548757.206, 758410.519),
    ((61, 0), (12, 45), 6764877.311, 378323.440),
    ((61, 0), (18, 45), 6768593.345, 702745.127),
    ((63, 0), (12, 0), 6989134.048, 348083.148),
    ((63, 0), (19, 30), 6993565.630, 727798.671),
    ((65, 0), (13, 30), 7209293.753, 429270.201),
    ((65, 0), (21, 45), 7225449.115, 817833.405),
    ((69, 0), (21, 0), 7666089.698, 739639.195),
]


def test_reprojection_of_control_points(spark):
    ring = [[e, n] for _, _, n, e in CONTROL_POINTS]
    df = spark.createDataFrame([(1, [[ring]]), (2, None)], f"id int, geometry {source.GEOMETRY}")
    out = geo.to_lon_lat(df, 3006)
    rows = {r.id: r for r in out.collect()}
    assert rows[1].srid == 4326 and rows[2].geometry is None
    for (lon, lat), (want_lat, want_lon, *_) in zip(rows[1].geometry[0][0], CONTROL_POINTS, strict=True):
        assert abs(lat - want_lat[0] - want_lat[1] / 60) < 1e-7 and abs(lon - want_lon[0] - want_lon[1] / 60) < 1e-7


def test_every_grid_goes_there_and_back(spark):
    for srid, grid in projection.GRIDS.items():
        places = [(grid.meridian + d, lat) for d in (-2.0, -0.3, 0.0, 1.4) for lat in (55.0, 61.3, 69.0)]
        ring = [list(projection.grid_point(*p, grid)) for p in places]
        (row,) = geo.to_lon_lat(spark.createDataFrame([([[ring]],)], f"geometry {source.GEOMETRY}"), srid).collect()
        assert np.abs(np.array(row.geometry[0][0]) - np.array(places)).max() < 1e-9
    with pytest.raises(ValueError, match="unknown grid"):
        geo.to_lon_lat(spark.createDataFrame([], f"geometry {source.GEOMETRY}"), 1)
