"""Routes for gaps over the road network, from their end points to rows that the writers take as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import geo, tags
from lowstress.graph.components import connected_components
from lowstress.graph.paths import shortest_paths
from lowstress.lookups import Thresholds
from lowstress.operators import network as N
from lowstress.operators.route import compare, roll_up, segment_facility, weighted_edges, with_quality
from lowstress.operators.spatial import nearest
from lowstress.storage import checkpoint

T = Thresholds()
#: Strategy -> the weight that its routes minimise; a comparison adds the shortest routes to the comfortable ones.
STRATEGIES = {"lts": "lts_cost", "shortest": "length_m", "compare": "lts_cost"}
#: Metres within which an end snaps to a road node, and within which it does if there is none.
SNAP, SNAP_WIDE = 300, 1500
ROUTE_SCHEMA = (
    "gap_id", "gap_type", "strategy", "from_street", "to_street", "found", "fallback", "total_length_m", "straight_line_m", "detour_ratio", "worst_lts", "lts_problem_length_m", "lts_problem_pct",
    "upgrade_complexity", "dominant_facility", "estimated_cost", "route_quality", "notes", "start_lat", "start_lon", "end_lat", "end_lon", "parts", "segments",
)


def _or(df: DataFrame, column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default) if column in df.columns else default


def route_ends(gaps: DataFrame) -> DataFrame:
    """(gap_id, gap_type, from_street, to_street, start_lat, ..., end_lon, straight_line_m): a gap without a start begins at its own point (lat, lon)."""
    empty, none = F.lit(""), F.lit(None).cast("double")
    whole = F.col("start_lat").isNotNull() & F.col("start_lon").isNotNull()
    out = gaps.select(
        "gap_id", *[_or(gaps, c, empty).alias(c) for c in ("gap_type", "from_street", "to_street")],
        *[F.when(whole, F.col(f"start_{c}")).otherwise(F.col(c) if c in gaps.columns else none).alias(f"start_{c}") for c in ("lat", "lon")], "end_lat", "end_lon",
    )
    return out.withColumn("straight_line_m", geo.haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")))


def snap_ends(ends: DataFrame, roads: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end``, the nearest road node of each end within SNAP, else within SNAP_WIDE (ties: the smaller node), and pair_id."""
    n = N.nodes(roads).select("node", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    out = ends
    for e in ("start", "end"):
        at = ends.where("end_lat is not null and end_lon is not null").select("gap_id", F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")).where("lat is not null and lon is not null")
        close = nearest(at, n, "gap_id", SNAP, ["node"]).select("gap_id", "node")
        far = nearest(at.join(close, "gap_id", "left_anti"), n, "gap_id", SNAP_WIDE, ["node"]).select("gap_id", "node")
        out = out.join(close.unionByName(far).withColumnRenamed("node", e), "gap_id", "left")
    return checkpoint(out.withColumn("pair_id", F.xxhash64("gap_id")))


def road_graph(roads: DataFrame) -> DataFrame:
    """Road edges with level of stress, weights, and the facility that each would need."""
    out = segment_facility(weighted_edges(roads))
    return checkpoint(out.withColumn("lts_label", tags.lookup(F.col("lts"), L.LTS_LABEL, "Unknown")))


def find_paths(snapped: DataFrame, roads: DataFrame, comp: DataFrame, weight: str) -> DataFrame:
    """(pair_id, path, fallback). Where ``weight`` leaves no path (edges without one are not used), the physically shortest, as a fallback."""
    ask = snapped.where("start is not null and end is not null and start <> end").select("pair_id", F.col("start").alias("source"), F.col("end").alias("target"))
    found = checkpoint(shortest_paths(roads, ask, weight, comp=comp).select("pair_id", "path", F.lit(False).alias("fallback")))
    if weight == "length_m":
        return found
    same = ask.join(comp.withColumnRenamed("node", "source"), "source").join(comp.select(F.col("node").alias("target"), F.col("component").alias("_c")), "target").where("component = _c")
    missed = same.join(found, "pair_id", "left_anti").select("pair_id", "source", "target")
    if missed.isEmpty():
        return found
    return checkpoint(found.unionByName(shortest_paths(roads, missed, "length_m", comp=comp).select("pair_id", "path", F.lit(True).alias("fallback"))))


def route_segments(paths: DataFrame, roads: DataFrame) -> DataFrame:
    """(pair_id, seq, length_m, lts, recommended, part, segment): the road edges along each path; part is the line of the edge."""
    steps = paths.select("pair_id", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v"))).alias("seq", "s"))
    steps = steps.select("pair_id", "seq", "s.u", "s.v", F.least("s.u", "s.v").alias("a"), F.greatest("s.u", "s.v").alias("b"))
    kind = F.col("recommended")
    segment = F.struct(
        F.coalesce("name", F.lit("Unnamed road")).alias("road_name"), F.coalesce("highway", F.lit("")).alias("highway_class"), F.round("length_m", 1).alias("length_m"), "lts", "lts_label",
        tags.lookup(kind, L.FACILITY_SHORT, "").alias("recommended_facility"), kind.alias("recommended_facility_type"), tags.lookup(kind, L.COST_TIER, "unknown").alias("cost_tier"), tags.lookup(kind, L.BASIS, "").alias("otm18_basis"),
    )
    point = lambda n: F.struct(*N._coords(F.col(n)))
    return steps.join(roads, ["a", "b"]).select("pair_id", "seq", "length_m", "lts", "recommended", F.array(point("u"), point("v")).alias("part"), segment.alias("segment"))


def _notes() -> Column:
    """What there is to say about a route, in the order in which it came up."""
    unsnapped = F.col("start").isNull() | F.col("end").isNull()
    why = (
        F.when(F.col("end_lat").isNull() | F.col("end_lon").isNull(), L.ROUTE_NOTES["no_end"])
        .when(unsnapped, L.ROUTE_NOTES["not_snapped"])
        .when(F.col("start") == F.col("end"), L.ROUTE_NOTES["same_node"])
        .when(~F.col("found"), L.ROUTE_NOTES["no_path"])
        .when(F.col("fallback"), L.ROUTE_NOTES["fallback"])
    )
    far = F.when(F.col("found") & (F.col("detour_ratio") > T.route_detour), F.format_string(L.ROUTE_NOTES["detour"], F.col("detour_ratio"), F.lit(str(T.route_detour))))
    return F.filter(F.array(why, far), lambda x: x.isNotNull())


def _routes(snapped: DataFrame, roads: DataFrame, comp: DataFrame, strategy: str) -> DataFrame:
    paths = find_paths(snapped, roads, comp, STRATEGIES[strategy])
    segments = checkpoint(route_segments(paths, roads))
    lines = segments.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("seq", "part", "segment"))).alias("s"))
    lines = lines.select("pair_id", F.transform("s", lambda x: x["part"]).alias("parts"), F.transform("s", lambda x: x["segment"]).alias("segments"))
    out = snapped.join(roll_up(segments, "pair_id"), "pair_id", "left").join(lines, "pair_id", "left").join(paths.select("pair_id", "fallback"), "pair_id", "left")
    out = out.withColumn("found", F.col("total_length_m").isNotNull()).withColumn("fallback", F.coalesce("fallback", F.lit(False))).withColumn("straight_line_m", F.coalesce("straight_line_m", F.lit(0.0)))
    out = with_quality(out).withColumn("detour_ratio", F.when(F.col("found"), F.col("detour_ratio")).otherwise(1.0)).withColumn("notes", _notes())
    none = {
        "total_length_m": F.lit(0.0), "worst_lts": F.lit(1), "lts_problem_length_m": F.lit(0.0), "lts_problem_pct": F.lit(0.0), "upgrade_complexity": F.lit(""), "dominant_facility": F.lit(""), "estimated_cost": F.lit(0.0),
        "parts": F.array(), "segments": F.array(),
    }
    out = out.withColumnsRenamed({"problem_m": "lts_problem_length_m", "problem_pct": "lts_problem_pct", "complexity": "upgrade_complexity", "quality": "route_quality"}).withColumn("strategy", F.lit(strategy))
    return out.select(*[F.coalesce(F.col(c), none[c]).alias(c) if c in none else F.col(c) for c in ROUTE_SCHEMA])


def with_comparison(lts: DataFrame, shortest: DataFrame) -> DataFrame:
    """The comfortable routes with compare_shortest_length_m, compare_length_ratio, compare_shortest_worst_lts (null unless both were found) and compare_verdict."""
    verdict = compare(lts, shortest)
    s = shortest.select("gap_id", F.col("found").alias("_f"), F.col("total_length_m").alias("_m"), F.col("worst_lts").alias("_w"))
    both = lts.join(verdict, "gap_id").join(s, "gap_id").withColumn("_ok", F.col("found") & F.col("_f"))
    return both.select(
        *lts.columns, F.when(F.col("_ok"), F.round("_m", 1)).alias("compare_shortest_length_m"), F.col("length_ratio").alias("compare_length_ratio"),
        F.when(F.col("_ok"), F.col("_w")).alias("compare_shortest_worst_lts"), F.col("verdict").alias("compare_verdict"),
    )


def route_gaps(gaps: DataFrame, roads: DataFrame, strategy: str = "lts") -> DataFrame:
    """One row for each gap (ROUTE_SCHEMA): whether there is a route, its line and segments, length, stress, cost, quality and notes.

    ``lts`` looks for the comfortable route (length times the multiplier of its stress), ``shortest`` for the shortest; ``compare``
    returns the comfortable ones with how they relate to the shortest. gap_id is unique. A gap without an end, without road
    nodes near its ends, or without a path has found false, zeros, empty texts and a note.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(STRATEGIES)}")
    roads = road_graph(roads)
    comp = checkpoint(connected_components(roads))
    snapped = snap_ends(route_ends(gaps), roads)
    first = _routes(snapped, roads, comp, "shortest" if strategy == "shortest" else "lts")
    return first if strategy != "compare" else with_comparison(first, _routes(snapped, roads, comp, "shortest"))


def compare_strategies(gaps: DataFrame, roads: DataFrame) -> DataFrame:
    """(gap_id, length_ratio, verdict) of the comfortable against the shortest routes."""
    return route_gaps(gaps, roads, "compare").select("gap_id", F.col("compare_length_ratio").alias("length_ratio"), F.col("compare_verdict").alias("verdict"))


def route_summary(routes: DataFrame) -> DataFrame:
    """One row: gaps, routes found, fallbacks, routes of each quality (a route that was not found has none), total length and cost of the found ones."""
    q = lambda x: F.count_if(F.col("route_quality") == x)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("found"), F.col(c))), F.lit(0.0))
    return routes.agg(
        F.count("*").alias("gaps"), F.count_if("found").alias("found"), F.count_if("fallback").alias("fallback"), q("excellent").alias("excellent"), q("good").alias("good"), q("fair").alias("fair"),
        F.count_if((F.col("route_quality") == "poor") | ~F.col("found")).alias("poor_or_not_found"), total("total_length_m").alias("total_length_m"), total("estimated_cost").alias("total_cost"),
    )
