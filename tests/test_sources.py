"""Readers and writers on small files made here."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from lowstress.functions import tags
from lowstress.sources import infra, osm_json, sinks
from lowstress.sources.field_map import FieldMap, load_field_map


def test_overpass_file(spark, tmp_path):
    geo = lambda *p: [{"lat": a, "lon": o} for a, o in p]
    elements = [
        {"type": "way", "id": 1, "nodes": [1, 2], "geometry": geo((43.0, -80.0), (43.1, -80.0)), "tags": {"highway": "cycleway"}},
        {"type": "way", "id": 2, "geometry": geo((43.0, -80.0), (43.0, -80.1)), "tags": {"highway": "primary", "cycleway:left": "lane", "maxspeed": "30 mph", "lanes": "2;3"}},
        {"type": "way", "id": 3, "tags": {"highway": "residential"}},
        {"type": "way", "id": 4, "geometry": geo((1.0, 2.0), (3.0, 4.0)), "tags": {"leisure": "park", "name": "Green"}},
        {"type": "node", "id": 5, "lat": 43.5, "lon": -80.5, "tags": {"amenity": "school", "name": "A"}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}))
    e = osm_json.read_elements(spark, str(tmp_path / "a.json"))
    w = osm_json.ways(e)
    assert sorted(r.way_id for r in osm_json.select_cycling(w).collect()) == ["1", "2"]
    assert sorted(r.way_id for r in osm_json.select_roads(w).collect()) == ["2", "3"]
    assert osm_json.vertices(w).count() == 6
    row = osm_json.flat_tags(w).where("way_id = '2'").select(tags.parse_speed(F.col("maxspeed")).alias("s"), tags.parse_lanes(F.col("lanes")).alias("n")).first()
    assert (row.s, row.n) == (48, 1)
    d = {r.type: (r.lat, r.lon, r.name) for r in osm_json.destinations(e).where("type in ('park', 'school')").collect()}
    assert d == {"park": (2.0, 3.0, "Green"), "school": (43.5, -80.5, "A")}
    assert osm_json.region_box("Ottawa")[0] == 45.25
    with pytest.raises(ValueError, match="unknown region"):
        osm_json.region_box("Atlantis")


def test_geojson_parts_status_and_statistics(spark, tmp_path):
    line = [[-80.0, 43.0], [-80.001, 43.0]]
    feats = [
        {"properties": {"T": "bike LANE", "S": "Built", "NAME": "x"}, "geometry": {"type": "LineString", "coordinates": line}},
        {"properties": {"T": "??", "S": "built"}, "geometry": {"type": "MultiLineString", "coordinates": [line, line, [[-80.0, 43.0]]]}},
        {"properties": {"T": "Bike Lane", "S": "planned"}, "geometry": {"type": "LineString", "coordinates": line}},
        {"properties": {"S": "built"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"S": "built"}, "geometry": None},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    fm = FieldMap(facility_field="T", status_field="S", status_include=("built",), facility_map={"Bike Lane": "cycle_lane"})
    ways, stats = infra.read_infra(spark, str(tmp_path / "a.geojson"), fm)
    got = sorted((r.way_id, r.facility, r.name) for r in ways.collect())
    assert got == [("shp_0_0", "cycle_lane", "x"), ("shp_1_0", "unknown", "Unnamed"), ("shp_1_1", "unknown", "Unnamed")]
    s = stats.first()
    assert (s.features, s.loaded, s.skipped_status, s.skipped_geometry, s.skipped_short) == (5, 3, 1, 2, 1)
    with pytest.raises(ValueError, match="unknown kind"):
        infra.read_infra(spark, "x.kml")


def test_shapefile_and_projection(spark, tmp_path):
    pts = [(500000.0, 4649776.0), (500100.0, 4649776.0)]
    body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", *pts[0], *pts[1])
    (tmp_path / "r.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    fieldd = b"FACILITY_T".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15
    (tmp_path / "r.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 1, 32 + 32 + 1, 11) + b"\0" * 20 + fieldd + b"\x0d" + b" " + b"lane".ljust(10))
    fm = FieldMap(facility_field="FACILITY_T", facility_map={"lane": "cycle_lane"}, source_crs="EPSG:32617")
    ways, _ = infra.read_infra(spark, str(tmp_path / "r.shp"), fm)
    r = ways.first()
    assert r.facility == "cycle_lane" and abs(r.length_m - 100) < 0.5
    assert abs(r.coords[0].lat - 42.0) < 0.01 and abs(r.coords[0].lon + 81.0) < 1e-9
    with pytest.raises(ValueError, match="unsupported"):
        infra.reproject(infra.read_shapefile(spark, str(tmp_path / "r.shp")), "EPSG:2958")


def test_field_map_file(tmp_path):
    (tmp_path / "f.yaml").write_text("source_name: X\nstatus_include: [a, b]\nnonsense: 1\n")
    m = load_field_map(str(tmp_path / "f.yaml"))
    assert m.source_name == "X" and m.status_include == ("a", "b") and m.name_field == "NAME"


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([("G1", "island", 43.0, -80.0, 43.2, -80.0, 70.0, "high", 1), ("G2", "detour</script>", None, None, None, None, 1.0, "low", 2)], "gap_id string, gap_type string, start_lat double, start_lon double, end_lat double, end_lon double, composite double, band string, rank int")
    sinks.write_geojson(sinks.gap_features(g), str(tmp_path / "g"))
    data = json.loads(next((tmp_path / "g").glob("part*")).read_text())
    assert [f["geometry"]["type"] for f in data["features"]] == ["Point", "LineString"] and data["features"][0]["geometry"]["coordinates"] == [-80.0, 43.1]
    page = sinks.review_page(g, "<R&D>")
    assert "</script>" not in page.split("const gaps")[1].split("\n")[0] and "&lt;R&amp;D&gt;" in page
    sinks.write_csv(g, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part*")).read_text().startswith("gap_id,")
    d = spark.createDataFrame([("G1", "Data error", "2024")], "gap_id string, reason string, ts string")
    assert json.loads(sinks.dismissed_sidecar(d).first().value)["G1"]["reason"] == "Data error"


def test_ways_with_a_facility_on_one_side_and_footways(spark):
    from lowstress.operators import network as N

    tags = {
        1: {"highway": "residential", "cycleway:left": "lane"}, 2: {"highway": "secondary", "cycleway:both": "track"}, 3: {"highway": "footway", "bicycle": "designated"}, 4: {"highway": "footway", "bicycle": "yes", "foot": "designated"},
        5: {"highway": "path", "bicycle": "yes"}, 6: {"highway": "bridleway", "cycleway:right": "track"}, 7: {"highway": "footway"}, 8: {"highway": "tertiary", "cycleway": "opposite_lane", "cycleway:left": "no", "cycleway:both": "track"},
        9: {"highway": "residential", "cycleway": "lane"}, 10: {"highway": "residential", "cycleway": "opposite_lane", "cycleway:left": "lane"}, 11: {"highway": "residential", "cycleway": "opposite_lane"},
    }
    rows = [(str(i), i, [(43.0 + i / 100, -80.0), (43.0 + i / 100, -79.99)], t) for i, t in tags.items()]
    w = spark.createDataFrame(rows, "way_id string, ord int, coords array<struct<lat: double, lon: double>>, tags map<string, string>")
    ids = lambda df: {int(r.way_id) for r in df.collect()}
    assert ids(osm_json.select_cycling(w)) == {2, 3, 5, 8} and ids(osm_json.select_roads(w)) == {1, 2, 6, 8, 9, 10, 11}
    flat, v = osm_json.flat_tags(w), osm_json.vertices(w)
    assert ids(flat.where(N.is_cycling_way(flat))) == {2, 3, 5, 8} and ids(flat.where(N.is_road_way(flat))) == {1, 2, 6, 8, 9, 10, 11}
    assert ids(N.cycling_edges(flat, v)) == {3, 8}  # a tag of one side says that there is something, not what
    assert ids(N.road_attribute_edges(flat, v)) == {8, 9, 10} and ids(N.road_edges(flat, v)) == {1, 2, 6, 8, 9, 10, 11}


def test_a_roundabout_of_several_ways_is_one_circle(spark):
    from lowstress.operators import refine

    spot = lambda k: (43.0 + 0.0002 * math.sin(math.radians(k)), -80.0 + 0.00027 * math.cos(math.radians(k)))
    arcs = {1: (0, 60, 120), 2: (120, 180, 240), 3: (240, 300, 360)}
    rows = [(w, i, *spot(k % 360)) for w, ks in arcs.items() for i, k in enumerate(ks)]
    rows += [(9, i, 44.0 + 0.001 * math.sin(math.radians(k % 360)), -80.0) for i, k in enumerate(range(0, 361, 40))]  # closed
    rows += [(20, 0, 45.0, -80.0), (20, 1, 45.001, -80.0)]
    v = spark.createDataFrame(rows, "way_id long, seq int, lat double, lon double")
    ways = spark.createDataFrame([(1, "roundabout"), (2, "roundabout"), (3, "circular"), (9, "roundabout"), (20, "")], "way_id long, junction string")
    got = sorted((r.lat, r.lon, r.radius) for r in refine.roundabout_circles(ways, v).collect())
    assert len(got) == 2
    ends = [spot(k) for k in (0, 120, 240)]
    assert abs(got[0][0] - sum(p[0] for p in ends) / 3) < 1e-9 and abs(got[0][1] - sum(p[1] for p in ends) / 3) < 1e-9 and 15 < got[0][2] < 25
    assert refine.roundabout_circles(ways, v.limit(0)).count() == 0
