"""Readers of plans, reviews and areas, and the writers of tables, features and pages."""

import json

import pytest
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import geo
from lowstress.operators import routing
from lowstress.sources import readers, sinks


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_master_plans(spark, tmp_path):
    f = lambda kind, c, **p: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    doc = {"type": "FeatureCollection", "features": [f("LineString", [[-80, 43], [-80.1, 43.1]], name="A"), f("MultiLineString", [[[1, 2], [3, 4]], [[5, 6]]]), f("Point", [7, 8], name="P")]}
    got = readers.read_master_plan(spark, put(tmp_path, "plan.geojson", json.dumps(doc, indent=1))).collect()
    assert [(r.feature_ord, r.name, r.lat, r.lon) for r in got] == [(0, "A", 43, -80), (0, "A", 43.1, -80.1), (1, "", 2, 1), (1, "", 4, 3), (1, "", 6, 5), (2, "P", 8, 7)]
    for path in (None, str(tmp_path / "none.geojson"), put(tmp_path, "bad.geojson", "{not json"), put(tmp_path, "list.geojson", "[]")):
        assert readers.read_master_plan(spark, path).count() == 0


def test_finalised_gaps_and_their_box(spark, tmp_path):
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-80.0, 43.0]}, "properties": {"gap_id": "GAP-001", "end_lat": 43.2, "end_lon": -79.9}}
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}
    got = readers.read_finalised_gaps(spark, put(tmp_path, "gaps.geojson", json.dumps({"features": [line, point]})))
    assert [(r.ord, r.lat, r.lon, r.properties["gap_id"]) for r in got.collect()] == [(1, 43.0, -80.0, "GAP-001")]
    assert readers.gaps_bbox(got) == pytest.approx((42.97, -80.02, 43.23, -79.88))
    with pytest.raises(ValueError, match="no point"):
        readers.read_finalised_gaps(spark, put(tmp_path, "lines.geojson", json.dumps({"features": [line]})))
    with pytest.raises(FileNotFoundError):
        readers.read_finalised_gaps(spark, str(tmp_path / "none"))


def test_dismissals_gap_tables_and_areas(spark, tmp_path):
    d = readers.read_dismissed(spark, put(tmp_path, "d.json", json.dumps({"GAP-001": {"reason": "Data error", "timestamp": "t"}, "GAP-002": {}})))
    assert sorted(map(tuple, d.collect())) == [("GAP-001", "Data error", "t"), ("GAP-002", "Unspecified", None)]
    with pytest.raises(ValueError, match="no JSON object"):
        readers.read_dismissed(spark, put(tmp_path, "l.json", "[1]"))
    g = readers.read_gaps_csv(spark, put(tmp_path, "g.csv", 'gap_id,from_street\nGAP-001,first\nGAP-001,"second, ""b"""\nGAP-002,\n'))
    assert sorted(map(tuple, g.collect())) == [("GAP-001", 'second, "b"'), ("GAP-002", None)]
    assert readers.read_areas(spark, None).count() == 0
    a = readers.read_areas(spark, put(tmp_path, "a.csv", "lat,lon,quintile\n43,-80,2\n43,-80,9\n,1,1\n"))
    assert [(r.quintile, r.lat) for r in a.collect()] == [(2, 43.0)]


def test_fetching_tries_all_mirrors(spark):
    asked, waits = [], []

    def post(url, query, timeout):
        asked.append(url)
        if len(asked) < 5:
            raise OSError("down")
        return b'{"elements": []}'

    assert readers.fetch("q", ("x", "y", "z"), post=post, sleep=waits.append) == {"elements": []}
    assert asked == ["x", "x", "x", "y", "y"] and waits == [1, 2, 4, 1]
    with pytest.raises(ConnectionError):
        readers.fetch("q", ("x", "y", "z"), post=lambda *a: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)


def scored(spark):
    rows = [("GAP-001", "island", 70.0, 1, "<A>", 43.0, -80.0, 43.1, -80.1, True, 1), ("GAP-002", "dangling", 50.0, 2, "B", 43.2, -80.0, 43.3, -80.1, False, None)]
    out = spark.createDataFrame(rows, "gap_id string, gap_type string, composite double, rank int, from_street string, start_lat double, start_lon double, end_lat double, end_lon double, crosses_barrier boolean, active_rank int")
    out = out.withColumn("dismissed", F.col("active_rank").isNull()).withColumn("len_m", F.lit(12.4)).withColumn("band", F.lit("high"))
    scores = {c: F.lit(0.1234) for c in ("conn_score", "build_score", "dest_score", "lts_score", "equity_score")}
    words = {c: F.lit(c) for c in ("facility_short", "cost_tier", "otm18_basis", "start_facility", "end_facility", "context")}
    return out.withColumns(scores | words | {"lts_achievable": F.lit(1), "corridor_lts": F.lit(3), "plan_match": F.lit(True), "separation_ratio": F.lit(float("inf"))})


def test_tables(spark, tmp_path):
    t = sinks.gap_table(scored(spark))
    assert tuple(t.columns) == L.GAP_COLUMNS and len(t.columns) == 32
    r = t.where("rank = 1").first()
    assert (r.composite_score, r.straight_line_m, r.to_street, r.aadt_note, r.score_lts, r.separation_ratio, r.recommended_facility) == (70.0, 12.0, "", L.AADT_NOTE, 12.3, "inf", "facility_short")
    assert [c for c in t.columns if r[c] is None] == ["detour_factor", "current_network_m"]
    with pytest.raises(ValueError, match="the rows lack otm18_basis"):
        sinks.gap_table(scored(spark).drop("otm18_basis"))
    sinks.write_csv(t, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == list(L.GAP_COLUMNS) and back.count() == 2
    final = sinks.final_table(scored(spark))
    assert tuple(final.columns) == L.FINAL_COLUMNS and [(x.rank, x.gap_id) for x in final.collect()] == [(1, "GAP-001")]
    assert sinks.final_features(scored(spark)).count() == 2


def street(spark):
    """A street west to east (quiet, then a trunk road, then quiet), a way around the trunk road, and a street far away."""
    at = [(43.0, -80.0), (43.0, -79.99), (43.0, -79.98), (43.0, -79.97), (43.004, -79.985), (44.0, -80.0), (44.0, -79.99)]
    ways = [(1, 0, 1, "residential", "A"), (2, 1, 2, "trunk", "T"), (3, 2, 3, "residential", None), (4, 1, 4, "residential", "N"), (5, 4, 2, "residential", "N"), (6, 5, 6, "residential", "B")]
    rows = [(w, *at[a], *at[b], h, n) for w, a, b, h, n in ways]
    e = spark.createDataFrame(rows, "way_id long, lat1 double, lon1 double, lat2 double, lon2 double, highway string, name string")
    one, two = geo.node_key(F.col("lat1"), F.col("lon1")), geo.node_key(F.col("lat2"), F.col("lon2"))
    return e.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "way_id", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("length_m"), "highway", F.lit(0).alias("maxspeed"), F.lit(1).alias("lanes"), "name", F.lit("").alias("cycleway"), F.lit("<1000").alias("aadt_proxy"))


def test_a_route_run_from_gaps_to_files(spark, tmp_path):
    rows = [
        ("g1", "island", "X", 43.0, -80.0, 43.0, -79.97, None, None), ("g2", "detour", None, None, None, 43.0, -79.97, 43.0, -80.0), ("g3", "dangling", "", 43.0, -80.0, None, None, 43.0, -80.0),
        ("g4", "dangling", "", 43.0, -80.0, 43.0, -80.0, None, None), ("g5", "dangling", "", 43.0, -80.0, 44.0, -80.0, None, None), ("g6", "dangling", "", 43.0, -80.0, 50.0, 10.0, None, None),
    ]
    gaps = spark.createDataFrame(rows, "gap_id string, gap_type string, from_street string, start_lat double, start_lon double, end_lat double, end_lon double, lat double, lon double")
    compared = routing.checkpoint(routing.route_gaps(gaps, street(spark), "compare"))
    out = {r.gap_id: r for r in compared.collect()}
    assert [out[g].found for g in sorted(out)] == [True, True, False, False, False, False]
    assert [out[g].notes for g in ("g3", "g4", "g5", "g6")] == [[L.ROUTE_NOTES[n]] for n in ("no_end", "same_node", "no_path", "not_snapped")]
    g = out["g1"]
    assert [s.road_name for s in g.segments] == ["A", "N", "N", "Unnamed road"] and len(g.parts) == 4 and g.worst_lts == 2  # around the trunk road
    assert g.parts[0][0].lon == -80.0 and g.parts[-1][-1].lon == -79.97 and out["g2"].start_lat == 43.0  # a gap without a start begins at its point
    assert (g.compare_verdict, g.compare_shortest_worst_lts) == ("detour_buys_comfort" if g.compare_length_ratio > 1.1 else "comfort_for_free", 4)
    assert (out["g5"].compare_verdict, out["g5"].total_length_m, out["g5"].route_quality, out["g5"].worst_lts) == ("incomplete", 0.0, "", 1)
    # an edge without a cost cuts the comfortable way: the shortest one steps in, and says so
    holes = routing.road_graph(street(spark)).withColumn("lts_cost", F.when(F.col("way_id") != 6, F.col("lts_cost")))
    comp = routing.connected_components(holes)
    far = routing.snap_ends(routing.route_ends(spark.createDataFrame([("h", 44.0, -80.0, 44.0, -79.99)], "gap_id string, start_lat double, start_lon double, end_lat double, end_lon double")), holes)
    assert [r.fallback for r in routing.find_paths(far, holes, comp, "lts_cost").collect()] == [True]
    h = routing._routes(far, holes, comp, "lts").first()
    assert (h.found, h.fallback, h.route_quality, h.notes) == (True, True, "poor", [L.ROUTE_NOTES["fallback"]])

    for strategy, routes in (("shortest", routing.route_gaps(gaps, street(spark), "shortest")), ("lts", compared.drop(*L.COMPARE_COLUMNS)), ("compare", compared)):
        paths = sinks.write_routes(gaps, routes, str(tmp_path), "My Region", strategy)
        assert paths["csv"].endswith({"lts": "my_region_routes_summary.csv", "shortest": "my_region_routes_shortest_summary.csv", "compare": "my_region_routes_compare_summary.csv"}[strategy])
        table = spark.read.csv(paths["csv"], header=True)
        assert tuple(table.columns) == L.ROUTE_COLUMNS + (L.COMPARE_COLUMNS if strategy == "compare" else ())
        assert [r.route_found for r in table.orderBy("gap_id").collect()] == ["true", "true", "false", "false", "false", "false"]
        made = json.loads("".join(r.value for r in spark.read.text(paths["geojson"], wholetext=True).collect()))["features"]
        lines = [f for f in made if f["geometry"]["type"] == "MultiLineString"]
        assert len([f for f in made if f["geometry"]["type"] == "Point"]) == 4 and len(lines) == 2
        assert all(len(f["geometry"]["coordinates"]) == len(f["properties"]["segments"]) and ("compare" in f["properties"]) == (strategy == "compare") for f in lines)
        page = spark.read.text(paths["map"], wholetext=True).first().value
        assert "My Region routes" in page and "total cost" in page and "g1" in page and "g5" not in page
    s = routing.route_summary(routes).first()
    assert (s.gaps, s.found, s.fallback, s.excellent + s.good + s.fair + s.poor_or_not_found) == (6, 2, 0, 6)
    assert routing.route_gaps(gaps.limit(0), street(spark)).count() == 0
    with pytest.raises(ValueError, match="unknown strategy"):
        routing.route_gaps(gaps, street(spark), "fast")


def test_pages(spark):
    page = sinks.map_page(scored(spark), "<b>")
    assert "&lt;b&gt;" in page and "<A>" not in page and "\\u003cA\\u003e" in page
    review = sinks.review_page(scored(spark), "Region </script>", {"GAP-002": "Data error"})
    assert review.count("</script>") == 1 and "GAP-002" in review and all(c in review for c in L.FINAL_COLUMNS)
    with pytest.raises(ValueError, match="a page holds"):
        sinks.map_page(spark.range(sinks.PAGE_ROWS + 1).withColumn("rank", F.col("id")), "x")


def test_places_regions_and_missing_files(spark, tmp_path):
    from lowstress.sources import infra, osm_json

    rows = [("node", {"amenity": "school"}), ("way", {"amenity": "school"}), ("way", {"leisure": "park"}), ("node", {"shop": "supermarket"}), ("node", {"shop": "bakery"}), ("way", {"landuse": "retail"}), ("node", None)]
    places = osm_json.select_destinations(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, type string, tags map<string,string>"))
    assert {r.id for r in places.collect()} == {0, 2, 3, 5}
    assert osm_json.region_box("Here", lambda n: (1.0, 2.0, 3.0, 4.0)) == (1.0, 2.0, 3.0, 4.0)
    with pytest.raises(ValueError, match="unknown region"):
        osm_json.region_box("Here", lambda n: None)
    with pytest.raises(FileNotFoundError):
        infra.read_infra(spark, str(tmp_path / "none.geojson"))
    assert infra.projection(spark, put(tmp_path, "a.prj", 'PROJCS["x"]')) == "projected" and infra.projection(spark, put(tmp_path, "b.prj", "GEOGCS[]")) == "geographic"
    assert infra.projection(spark, str(tmp_path / "c.prj")) is None


def test_scores_of_the_gap_table_are_rounded_as_sql_rounds_them(spark):
    import duckdb

    scores = [0.5245, 0.5285, 0.5385, 0.5244, 0.12345, 1.0, 0.0]
    rows = scored(spark).limit(1).drop("conn_score").crossJoin(spark.createDataFrame([(s,) for s in scores], "conn_score double"))
    got = sorted(r.score_connectivity for r in sinks.gap_table(rows).collect())
    assert got == sorted(duckdb.sql(f"select round(s * 100, 1) from (select unnest({scores}::double[]) as s)").fetchall()[i][0] for i in range(len(scores)))
    assert got.count(52.5) == 1 and got.count(52.4) == 1
