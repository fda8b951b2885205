"""Operators without a SQL text, and edge cases of the others, against small cases worked out by hand or by brute force."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lowstress.functions import geo, tags
from lowstress.operators import attach, clean, detect, refine, review, score
from lowstress.operators import network as N
from lowstress.operators import separation as sep
from lowstress.operators.ranking import ranked
from lowstress.operators.spatial import grid_join, grid_join_limit


def metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def key(lat, lon):
    return math.floor(lat * 1e5 + 0.5) * 100_000_000 + math.floor(lon * 1e5 + 0.5) + 18_000_000


def network(spark, lines, facility="protected_track"):
    """Edges of lines of (lat, lon); way ids are the numbers of the lines."""
    rows = []
    for i, line in enumerate(lines):
        for p, q in zip(line, line[1:], strict=False):
            a, b = sorted((key(*p), key(*q)))
            rows.append((a, b, i, facility, metres(*p, *q)))
    return spark.createDataFrame(rows, "a long, b long, way_id long, facility string, length_m double")


def points(spark, rows, prefix=""):
    return spark.createDataFrame(rows, f"id long, {prefix}lat double, {prefix}lon double")


@pytest.mark.parametrize("lat", [0.0, 43.0, 75.0, 80.0, 88.0])
def test_exact_grid_joins_lose_no_pair_at_any_latitude(spark, lat):
    import random

    rnd = random.Random(int(lat))
    at = [(i, lat + rnd.uniform(-0.02, 0.02), 10 + rnd.uniform(-0.02, 0.02) / max(0.02, math.cos(math.radians(lat)))) for i in range(120)]
    right = points(spark, at, "r_").withColumnRenamed("id", "r_id")
    got = {(r.id, r.r_id) for r in grid_join(points(spark, at), right, 1000).collect()}
    assert got == {(i, j) for i, a, b in at for j, c, d in at if metres(a, b, c, d) <= 1000} and len(got) > 150


def test_joins_with_a_limit_of_each_row(spark):
    at = [(i, 43 + i * 0.001, -80.0) for i in range(20)]
    left = points(spark, at).withColumn("limit", F.col("id") * 40.0 + 20)
    got = {(r.id, r.r_id) for r in grid_join_limit(left, points(spark, at, "r_").withColumnRenamed("id", "r_id"), F.col("limit")).collect()}
    assert got == {(i, j) for i, a, b in at for j, c, d in at if metres(a, b, c, d) <= i * 40 + 20}
    with pytest.raises(Exception, match="beyond the classes"):
        grid_join_limit(left, points(spark, at, "r_").withColumnRenamed("id", "r_id"), F.lit(5000.0)).collect()


def test_equity_and_spines_whatever_the_distance(spark):
    gaps = spark.createDataFrame([("g", 43.0, -80.0, 43.001, -80.0, "cycle_lane", "unknown")], "gap_id string, start_lat double, start_lon double, end_lat double, end_lon double, start_facility string, end_facility string")
    areas = spark.createDataFrame([(1, 1, 47.0, -80.0)], "da_id long, quintile int, lat double, lon double")
    assert score.equity(gaps, areas.limit(0)).first().equity_score == 0.5
    assert score.equity(gaps, areas).first().equity_score == 1.0
    assert score.equity(gaps, areas.withColumn("lat", F.lit(-43.0)).withColumn("lon", F.lit(99.0))).first().equity_score == 1.0


def test_ranks_equal_one_sorted_list(spark):
    rows = [((i * 37) % 101, i) for i in range(500)]
    got = {r.i: r.n for r in ranked(spark.createDataFrame(rows, "k int, i int").repartition(7), "n", F.desc("k"), F.asc("i")).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}


def edge_set(df):
    return {(r.a, r.b): r for r in df.collect()}


def test_dissolve_makes_no_second_edge_and_no_loop(spark):
    e = lambda pairs: spark.createDataFrame([(*sorted(p), i, "cycle_lane", 1.0) for i, p in enumerate(pairs)], "a long, b long, way_id long, facility string, length_m double")
    plain = edge_set(clean.dissolve(e([(1, 5), (5, 3), (3, 9)])))
    assert set(plain) == {(1, 9)} and plain[1, 9].path == [1, 5, 3, 9] and plain[1, 9].way_ids == [0, 1, 2] and plain[1, 9].length_m == 3
    beside = edge_set(clean.dissolve(e([(1, 4), (1, 2), (2, 3), (3, 4), (1, 7), (4, 8)])))
    assert set(beside) == {(1, 4), (1, 2), (2, 4), (1, 7), (4, 8)} and beside[2, 4].length_m == 2
    ring = edge_set(clean.dissolve(e([(1, 2), (2, 3), (3, 4), (4, 1)])))
    assert len(ring) == 3 and sum(r.length_m for r in ring.values()) == 4
    lollipop = edge_set(clean.dissolve(e([(1, 2), (2, 3), (3, 4), (4, 5), (5, 2), (1, 9), (1, 8)])))
    assert len(lollipop) == 6 and sum(r.length_m for r in lollipop.values()) == 7 and not any(a == b for a, b in lollipop)
    mixed = e([(1, 2), (2, 3)]).withColumn("facility", F.when(F.col("way_id") == 0, "cycle_lane").otherwise("shared_path"))
    assert len(edge_set(clean.dissolve(mixed))) == 2 and clean.dissolve(mixed.limit(0)).count() == 0


def test_dead_ends_snap_to_edges_and_chains_dissolve(spark):
    lines = [[(43.0, -80.0), (43.0, -79.99)], [(43.0001, -79.995), (43.003, -79.995)]]
    got = clean.clean_topology(network(spark, lines))
    assert got.count() == 3 and clean.clean_counts(network(spark, lines), got).first().components_after == 1


ISLAND_GAP = 0.0072  # 800 m


def test_islands_beyond_a_cell_and_their_anchors(spark):
    main = [(43.0, -80.0 + i * 0.001) for i in range(30)]
    far = [(43.0 + ISLAND_GAP, -80.0 + i * 0.001) for i in range(12)]
    small = [(43.0 - ISLAND_GAP * 1.5, -80.0 + i * 0.002) for i in range(4)]
    net = detect.prepare(network(spark, [main, far, small]))
    got = {r.component: r for r in detect.island_pairs(net).collect()}
    assert len(got) == 1 and abs(next(iter(got.values())).dist - 800) < 10  # four nodes may be 900 m off, not 1200
    near = [(43.0 + 0.003, -80.0005), (43.006, -80.0005)], [(43.0 + 0.004, -79.9999), (43.007, -79.9999)]
    twins = detect.island_pairs(detect.prepare(network(spark, [main, *near])))
    assert twins.count() == 2
    one = detect.by_anchor(twins).collect()
    assert len(one) == 1 and one[0].size == 4 and abs(one[0].dist - metres(43.003, -80.0005, 43.0, -80.0)) < 1


def test_dead_ends_that_a_road_joins_or_that_found_each_other(spark):
    lines = [[(43.0, -80.0), (43.0, -79.99)], [(43.0, -79.988), (43.0, -79.98)]]
    net = detect.prepare(network(spark, lines))
    pairs = detect.dangling_pairs(net)
    close = pairs.where("dist < 200")
    assert close.count() == 2 and detect.mutual_once(close).count() == 1
    road = spark.createDataFrame([tuple(sorted((key(43.0, -79.99), key(43.0, -79.988))))], "a long, b long")
    assert detect.dangling_pairs(net, road).where("dist < 200").count() == 0


ROAD = "way_id long, highway string, name string, maxspeed int, lanes int, lat1 double, lon1 double, lat2 double, lon2 double"


def roads(spark, rows):
    return spark.createDataFrame(rows, ROAD).withColumn("mid_lat", (F.col("lat1") + F.col("lat2")) / 2).withColumn("mid_lon", (F.col("lon1") + F.col("lon2")) / 2)


GAP = "ord long, start_lat double, start_lon double, end_lat double, end_lon double"


def test_what_roads_say_about_gaps(spark):
    r = roads(spark, [
        (1, "residential", "First", 40, 2, 43.0, -80.0, 43.001, -80.0), (2, "tertiary", "", 50, 2, 43.009, -80.0, 43.011, -80.0),
        (3, "motorway", "Fast", 100, 4, 43.006, -80.006, 43.008, -80.006), (4, "service", "", 20, 1, 43.0, -79.9, 43.004, -79.9),
    ])
    gaps = spark.createDataFrame([(1, 43.0005, -80.0, 43.01, -80.0), (2, 43.0005, -79.9, 43.0035, -79.9), (3, 10.0, 10.0, 10.01, 10.0)], GAP)
    out = {x.ord: x for x in attach.attach(gaps, r).collect()}
    assert (out[1].from_street, out[1].to_street, out[1].crosses_barrier) == ("First", "Unnamed tertiary", True)
    assert (out[2].from_street, out[2].candidate_roads, out[2].road_highway, out[2].crosses_barrier) == ("Unnamed service", [4], "service", False)
    assert (out[3].from_street, out[3].candidate_roads) == ("Unknown", None)
    assert {x.ord for x in attach.follows_road(gaps, r).collect()} == {2}
    near = {x.id: x.road for x in attach.nearest_named_road(points(spark, [(1, 43.02, -80.0), (2, 44.0, -80.0)]), r, "id").collect()}
    assert near == {1: "Fast", 2: "Fast"}


def test_greedy_dedup_by_detector_and_covered_gaps(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.choice(["island", "dangling"]), i % 2, 43 + rnd.random() * 0.02, -80 + rnd.random() * 0.02, 43 + rnd.random() * 0.02, -80 + rnd.random() * 0.02, None) for i in range(60)]
    gaps = spark.createDataFrame(rows, "ord long, gap_type string, src int, start_lat double, start_lon double, end_lat double, end_lon double, detour_factor double")

    def greedy(of, apart):
        order = sorted(of, key=lambda g: (-{"island": 4, "dangling": 1}[g[1]], -metres(*g[3:7]), g[0]))
        kept = []
        for g in order:
            mid = (g[3] + g[5]) / 2, (g[4] + g[6]) / 2
            if all(metres(*mid, (k[3] + k[5]) / 2, (k[4] + k[6]) / 2) >= apart and min(metres(*x, *y) for x in (g[3:5], g[5:7]) for y in (k[3:5], k[5:7])) >= 150 for k in kept):
                kept.append(g)
        return {g[0] for g in kept}

    assert {r.ord for r in refine.greedy_dedup(gaps).collect()} == greedy(rows, 300)
    assert {r.ord for r in refine.greedy_dedup(gaps, within="src").collect()} == greedy(rows[::2], 300) | greedy(rows[1::2], 300)
    numbered = refine.number_gaps(refine.cross_method_dedup(gaps)).orderBy("prio").collect()
    assert [r.gap_id for r in numbered] == [f"GAP-{i:03d}" for i in range(1, len(numbered) + 1)]
    mid = lambda g: ((g[3] + g[5]) / 2, (g[4] + g[6]) / 2)
    free = {g[0] for g in rows[:30] if all(metres(*mid(g), *mid(k)) >= 200 for k in rows[30:])}
    assert {r.ord for r in refine.without_covered(gaps.where("ord < 30"), gaps.where("ord >= 30")).collect()} == free


def test_same_road_rules(spark):
    rows = [(1, 43.0, -80.0, 43.0001, -80.0, "A", "A"), (2, 43.0, -80.0, 43.001, -80.0, "A", "A"), (3, 43.0, -80.0, 43.0001, -80.0, "A", "B"), (4, None, None, None, None, "A", "A")]
    labelled = spark.createDataFrame(rows, GAP + ", from_street string, to_street string")
    assert {r.ord for r in refine.same_road_duplicates(labelled).collect()} == {2, 3, 4}
    assert [r[0] for r in labelled.select(refine.is_micro_gap(refine.gap_length())).where("ord < 4").collect()] == [True, False, True]


def test_samples_are_topped_up(spark):
    crowd = [(i, 43 + i * 1e-5, -80.0) for i in range(100)] + [(1000 + i, 43.1 + i * 0.02, -80.0) for i in range(3)]
    nodes = spark.createDataFrame(crowd, "node long, lat double, lon double")
    got = {r.node for r in sep.sample_nodes(nodes).collect()}
    assert len(got) == 80 and {1000, 1001, 1002} <= got
    assert sep.sample_nodes(nodes, 2).count() == 4  # one of every cell at least


def test_separation_and_detours_by_plain_paths(spark):
    line = [(43.0, -80.0), (43.003, -80.0), (43.003, -79.9985), (43.0, -79.9985)]
    edges = network(spark, [line])
    gap = spark.createDataFrame([("g", *line[0], *line[3]), ("h", *line[0], *line[0]), ("far", 44.0, -80.0, 44.01, -80.0)], "gap_id string, start_lat double, start_lon double, end_lat double, end_lon double")
    length = sum(metres(*p, *q) for p, q in zip(line, line[1:], strict=False))
    got = {r.gap_id: r for r in sep.separation(gap, edges).collect()}
    assert set(got) == {"g", "h"} and got["h"].separation_ratio == math.inf
    assert abs(got["g"].network_m - length) < 1e-6 and abs(got["g"].separation_ratio - length / metres(*line[0], *line[3])) < 1e-9 and got["g"].keep
    detours = {(r.source, r.target): r.detour_factor for r in sep.detour_gaps(edges).collect()}
    want = {}
    for i in range(4):
        for j in range(i + 1, 4):
            along, straight = sum(metres(*p, *q) for p, q in zip(line[i:j], line[i + 1 : j + 1], strict=False)), metres(*line[i], *line[j])
            if 50 <= straight <= 600 and along / straight >= 2:
                want[tuple(sorted((key(*line[i]), key(*line[j]))))] = along / straight
    assert set(detours) == set(want) and all(abs(detours[k] - want[k]) < 1e-9 for k in want) and want


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(tags.to_float(F.lit(x))) for x in ("1.5", "", "inf", "x", " 2 ")] == [1.5, None, None, None, 2.0]
    assert value(tags.to_float(F.lit(None).cast("string"))) is None
    assert value(tags.gap_label(F.lit("A"), F.lit("B"))) == "A B" and value(tags.gap_label(F.lit("A"), F.lit(None), True)) == "A → "
    assert value(tags.slug(F.lit("Region of Here"))) == "region_of_here"
    assert value(tags.better_facility(F.lit("cycle_lane"), F.lit("shared_path"))) == "shared_path" and value(tags.better_facility(F.lit("shared_path"), F.lit("protected_track"))) == "shared_path"
    assert value(tags.display_date(F.to_timestamp(F.lit("2024-05-06 07:08:09")))) == "2024-05-06 07:08"
    for kind in ("protected_track", "cycle_lane", "shared_path", "shared_roadway", "signed_route"):
        m = tags.facility_tags(F.lit(kind), F.lit("n"))
        again = tags.facility_class(*(F.coalesce(m[k], F.lit("")) for k in ("highway", "cycleway", "bicycle", "segregated")), F.coalesce(m["route"], F.lit("")))
        assert value(again) == kind
    line = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(a)).alias("lon")) for a in p])
    joined = lambda x, y: [p.lat for p in value(geo.join_polylines(x, y))]
    assert joined(line(1, 2), line(2, 3)) == [1, 2, 3] and joined(line(1, 2), line(3, 2)) == [1, 2, 3]
    assert joined(line(2, 1), line(3, 2)) == [3, 2, 1] and joined(line(2, 1), line(2, 3)) == [3, 2, 1] and joined(line(1, 2), line(5, 6)) == [1, 2, 5, 6]


def test_review_states_filters_and_advice(spark):
    ts = "gap_id string, reason string, ts long, event_id long"
    own = spark.createDataFrame([("a", "Data error", 1, 1), ("a", None, 2, 2), ("b", "Data error", 1, 3)], ts)
    assert {r.gap_id for r in review.restored(own).collect()} == {"b"}
    other = spark.createDataFrame([("a", "Old", 0, 0), ("c", "Old", 0, 0)], ts)
    assert {(r.gap_id, r.reason) for r in review.restored(review.with_imported(own, other)).collect()} == {("b", "Data error"), ("c", "Old")}
    gaps = spark.createDataFrame([("a", "island", 70.0, 1, 1), ("b", "corridor", 80.0, 2, 2), ("c", "island", 40.0, 3, 3)], "gap_id string, gap_type string, composite double, rank int, ord int")
    ranks = review.active_rank(gaps, review.restored(own))
    assert review.review_stats(ranks).first().asDict() == {"active": 2, "dismissed": 1, "high": 1, "medium": 1}
    shown = lambda f: {r.gap_id for r in review.filtered(ranks, f).collect()}
    assert [shown(f) for f in ("all", "active", "dismissed", "high", "island")] == [{"a", "b", "c"}, {"a", "c"}, {"b"}, {"a"}, {"a", "c"}]
    with pytest.raises(ValueError, match="unknown filter"):
        review.filtered(ranks, "none")
    assert [r.gap_id for r in review.review_list(ranks).collect()] == ["a", "c", "b"]
    reasons = spark.createDataFrame([("a", "x"), ("b", None), ("c", "")], "gap_id string, reason string")
    assert [(r.reason, r.n) for r in review.reasons_by_count(reasons).collect()] == [("Unspecified", 2), ("x", 1)]


def test_near_miss_trace_summary_and_nearest_nodes(spark):
    from lowstress.operators import diagnose

    lines = [[(43.0, -80.0), (43.0, -79.99)], [(43.0, -79.9895), (43.0, -79.98)]]
    net = detect.prepare(network(spark, lines))
    box = (42.99, -80.01, 43.01, -79.97)
    trace = diagnose.near_miss_trace(net, box).collect()
    assert len(trace) == 1 and abs(trace[0].dist - metres(43.0, -79.99, 43.0, -79.9895)) < 1e-6 and trace[0].status == "would create a gap"
    s = diagnose.summary(net, box).first()
    assert (s.nodes, s.edges, s.components, s.main_nodes, s.dangling_in_box, s.near_miss_in_box) == (4, 2, 2, 2, 4, 1)
    assert diagnose.nodes_near(net, (10.0, 10.0, 11.0, 11.0), 3).count() == 3 and diagnose.nodes_near(net, box).where("dist is null").count() == 4
    assert {r.reason for r in diagnose.island_trace(net, box).collect()} == {"largest component", "candidate"}


def test_report_has_nine_sections_in_order(spark, tmp_path):
    from lowstress.operators import diagnose

    rows = [("w1", "cycleway", "", "A", 0, 43.0, -80.0), ("w1", "cycleway", "", "A", 1, 43.0, -79.99), ("w2", "residential", "lane", None, 0, 43.0, -79.9895), ("w2", "residential", "lane", None, 1, 43.0, -79.98), ("w3", "primary", "", "B", 0, 50.0, 1.0), ("w3", "primary", "", "B", 1, 50.0, 1.1)]
    v = spark.createDataFrame(rows, "way_id string, highway string, cycleway string, name string, seq int, lat double, lon double")
    ways = v.select("way_id", "highway", "cycleway", F.lit("").alias("bicycle"), F.lit("").alias("segregated"), "name").distinct()
    cycling, along = N.cycling_edges(ways, v), N.road_attribute_edges(ways, v)
    steps = {"cycling": cycling, "road attributes": along, "merged": N.merged_edges(cycling, along)}
    lines = diagnose.report(ways, v, steps, (42.99, -80.01, 43.01, -79.97), "Here")
    diagnose.write_report(lines.coalesce(1), str(tmp_path / "report"))
    got = [r.value for r in sorted(spark.read.text(str(tmp_path / "report")).withColumn("i", F.monotonically_increasing_id()).collect(), key=lambda r: r.i)]
    assert [x for x in got if x.startswith("[")] == [f"[{n}] {t}" for n, t in diagnose.TITLES.items()]
    at = {n: got.index(f"[{n}] {t}") for n, t in diagnose.TITLES.items()}
    assert "3 ways, 1 for cycling, 2 roads" in got[1] and got[at[2] + 1].startswith("  w1  protected_track") and at[3] == at[2] + 2 and "lane  cycle_lane" in got[at[3] + 1]
    assert got[at[4] + 3] == "  merged: 4 nodes, 2 edges, 2 components" and at[6] == at[5] + 5 and "would create a gap" in got[at[8] + 1]
    assert got[-1].startswith("  4 nodes, 2 edges, 2 components") and "4 dead ends and 1 near misses" in got[-1]
    empty = [r.line for r in diagnose.report(ways, v, steps, (10.0, 10.0, 11.0, 11.0), "Nowhere").orderBy("place").collect()]
    assert empty.count("  (nothing)") == 6


def test_json_of_a_page_is_escaped():
    from lowstress.sources.sinks import embed

    text = embed({"a": "</script>& "})
    assert "<" not in text and "&" not in text and " " not in text and json.loads(text) == {"a": "</script>& "}


def test_boxes_of_degrees_and_folded_places_against_plain_loops(spark):
    """Far north a distance spans more degrees than a box allows; beyond a pole a coordinate names a place on the other side."""
    import math

    from lowstress.operators.spatial import grid_join

    def hav(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 12742000.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    spots = [(lat + i * 0.004, -80.6 + j * 0.013) for lat in (43.0, 79.5, 89.9, 97.5, 403.0) for i in range(3) for j in range(4)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "k long, lat double, lon double")
    right = left.selectExpr("k as r", "lat as r_lat", "lon as r_lon").withColumnRenamed("r", "r_k")
    near = {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if hav(*p, *q) <= 1000}
    boxed = {(i, j) for i, j in near if abs(spots[i][0] - spots[j][0]) <= 0.01 and abs(spots[i][1] - spots[j][1]) <= 0.02}
    assert boxed < near
    assert {(x.k, x.r_k) for x in grid_join(left, right, 1000, box=(0.01, 0.02)).collect()} == boxed
    assert {(x.k, x.r_k) for x in grid_join(left, right, 1000, fold=True).collect()} == near


def test_gap_queries_keep_to_the_degrees_of_their_statements(spark, tmp_path):
    """Customers and orders of one tile at 79 degrees, where a kilometre is wider than the statements' boxes, against SQL."""
    import oracle

    from lowstress.plans import catalogue

    src, out = "/root/testdata/sf0.1", str(tmp_path)
    one = {"customer": ("c_custkey", 410), "orders": ("o_orderkey", 4096), "lineitem": ("l_orderkey", 4096), "supplier": ("s_suppkey", 28)}
    for name, (key, size) in one.items():
        t = spark.read.parquet(f"{src}/{name}.parquet").where(f"{key} < {size}")
        t.withColumn(key, (t[key] + 146 * size).cast(t.schema[key].dataType)).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    for name in ("part", "events", "nation"):
        spark.read.parquet(f"{src}/{name}.parquet").limit(50).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    con = oracle.connect(out)
    for name in ("destination_score", "barrier_flag", "street_labels", "cycling_within_35m", "nearest_cycling_node", "follows_road"):
        assert oracle.assert_same(catalogue.queries()[name](spark, out), con, catalogue.oracle_sql()[name]) > 0, name


def test_exploded_sides_are_not_broadcast(spark):
    """Spark takes an exploded side for as small as its source, so its estimate must not choose a broadcast."""
    from lowstress.operators.attach import follows_road
    from lowstress.operators.spatial import grid_join

    g = spark.range(10).selectExpr("id as ord", "43.0D as start_lat", "-80.0D as start_lon", "43.001D as end_lat", "-80.0D as end_lon", "43.0D + id / 1e6D as lat", "-80.0D as lon").withColumn("start_lat", F.col("lat"))
    x = spark.range(10).selectExpr("43.0D + id / 1e6D as lat1", "-80.0D as lon1", "43.01D as lat2", "-80.0D as lon2", "43.0D + id / 1e6D as r_lat", "-80.0D as r_lon")
    for df in (follows_road(g, x), grid_join(g, x, 100)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0


def test_later_rounds_of_snapping_look_at_the_halves_only(spark, monkeypatch):
    from lowstress.operators import clean

    key = lambda lat, lon: (4_300_000 + lat) * 100_000_000 + 18_000_000 - 8_000_000 + lon
    a, b = key(0, 0), key(0, 1000)
    tails = [(key(4, x), key(200, x)) for x in (300, 600)]
    far = [(key(2000 + 100 * i, 0), key(2000 + 100 * i, 80)) for i in range(40)]
    rows = [(*sorted(e), i, "cycle_lane", 100.0) for i, e in enumerate([(a, b), *tails, *far])]
    seen, before = [], clean._in_reach
    monkeypatch.setattr(clean, "_in_reach", lambda ends, edges, tolerance: (seen.append(edges.count()), before(ends, edges, tolerance))[1])
    got = clean.snap_dead_ends(spark.createDataFrame(rows, "a long, b long, way_id long, facility string, length_m double")).select("a", "b").collect()
    n, m = tails[0][0], tails[1][0]
    assert {tuple(r) for r in got} == {tuple(sorted(e)) for e in [(a, n), (n, m), (m, b), *tails, *far]} and len(got) == 45
    assert seen == [43, 2, 2]


def test_pairs_of_detectors_are_not_sorted_whole(spark):
    import random

    from lowstress.operators import detect

    rnd = random.Random(3)
    key = lambda lat, lon: (4_300_000 + lat) * 100_000_000 + 18_000_000 - 8_000_000 + lon
    at = [(rnd.randrange(1500), rnd.randrange(1500)) for _ in range(60)]
    rows = [(key(x, y), key(x + 30, y + 20), i, rnd.choice(["cycle_lane", "unknown"]), 40.0) for i, (x, y) in enumerate(at)]
    net = detect.prepare(spark.createDataFrame(rows, "a long, b long, way_id long, facility string, length_m double"))
    out = detect.near_miss(net)
    # the minimum of structures is sorted for; one row of a batch and pair of components is left before
    assert "SortAggregate" not in out._jdf.queryExecution().toString()
    n = [(r.node, r.component, r.facility) for r in net.nodes.collect()]
    near = detect.node_join(net.nodes.select("node", "lat", "lon", "component"), detect._right(net.nodes), 300).where("dist >= 30 and component < r_component").collect()
    best = {}
    for r in sorted(near, key=lambda r: (r.dist, r.node, r.r_node)):
        best.setdefault((r.component, r.r_component), (r.node, r.r_node))
    kind = {x: f for x, _, f in n}
    assert len(best) > 10 and {tuple(r) for r in out.select("c1", "c2", "node", "r_node", "facility", "r_facility").collect()} == {(*c, a, b, kind[a], kind[b]) for c, (a, b) in best.items()}


def test_islands_far_from_the_largest_component_are_not_dealt_to_cells(spark):
    from lowstress.operators.spatial import in_rows_of

    left = spark.createDataFrame([(1, 43.0, -80.0), (2, 43.03, -80.0), (3, 43.25, -80.0), (4, 42.96, -80.0)], "id int, lat double, lon double")
    right = spark.createDataFrame([(43.0, -80.0)], "r_lat double, r_lon double")
    assert {r.id for r in in_rows_of(left, right, 3000).collect()} <= {1, 2, 4} and in_rows_of(left, right, 3000).where("id = 2").count() == 1 and in_rows_of(left, right, 600, exact=False).count() == 1


def test_detours_of_the_analysis_look_at_every_node(spark, monkeypatch):
    from lowstress.plans import analysis

    class Seen(Exception):
        pass

    def seen(detours, net):
        raise Seen({(r.source, r.target) for r in detours.collect()})

    # a comb: 100 dead ends 57 m apart, joined 334 m away, so that all neighbours are detours
    teeth = [[(43.0, -80.0 + i * 0.0007), (43.003, -80.0 + i * 0.0007)] for i in range(100)]
    monkeypatch.setattr(analysis.detect, "detour_ends", seen)
    with pytest.raises(Seen) as found:
        analysis.find_gaps(detect.prepare(network(spark, [*teeth, [t[1] for t in teeth]])), None)
    ends = [key(43.0, -80.0 + i * 0.0007) for i in range(100)]
    assert {tuple(sorted(p)) for p in zip(ends, ends[1:], strict=False)} <= found.value.args[0]


def test_dissolving_walks_chains_without_rounds_of_tables(spark):
    from lowstress import storage

    line = [(43.0 + i * 0.0003, -80.0) for i in range(60)]
    ring = [(44.0, -80.0), (44.0, -79.999), (44.001, -79.999), (44.001, -80.0), (44.0, -80.0)]
    written = lambda: len(storage._written.get(spark.sparkContext.applicationId, []))
    n = written()
    rows = {r.a: r for r in clean.dissolve(network(spark, [line])).collect()}
    assert written() - n <= 7
    assert list(rows) == [key(*line[0])] and rows[key(*line[0])].path == [key(*p) for p in line] and abs(rows[key(*line[0])].length_m - sum(metres(*p, *q) for p, q in zip(line, line[1:], strict=False))) < 1e-6
    both = clean.dissolve(network(spark, [line, ring])).collect()
    assert len(both) == 4 and sum(len(r.path) - 1 for r in both) == 63
