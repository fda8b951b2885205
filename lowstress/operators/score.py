"""Scoring of gaps as Catalyst expressions over small lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import geo, tags
from lowstress.lookups import Thresholds
from lowstress.operators.pyramid import nearest_anywhere
from lowstress.operators.ranking import ranked
from lowstress.operators.refine import with_midpoint
from lowstress.operators.spatial import grid_join

T = Thresholds()


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def lts_context(gaps: DataFrame) -> DataFrame:
    """Adds corridor_lts, endpoint_lts_start/end, context and lts_score; the nearest road is road_highway/maxspeed/lanes (null: none)."""
    corridor = F.when(F.col("road_highway").isNull(), 4).otherwise(tags.segment_lts(F.col("road_highway"), F.col("road_maxspeed"), F.col("road_lanes"), F.lit("none")))
    ends = {e: tags.lookup(F.col(f"{e}_facility"), L.ENDPOINT_LTS, 3) for e in ("start", "end")}
    out = gaps.select("*", corridor.alias("corridor_lts"), *[c.alias(f"endpoint_lts_{e}") for e, c in ends.items()])
    low = (F.col("endpoint_lts_start") <= 2) & (F.col("endpoint_lts_end") <= 2)
    context = F.when(low & (F.col("corridor_lts") <= 2), "completes_low_stress").when(low & (F.col("corridor_lts") == 3), "reduces_stress").when(F.col("corridor_lts") == 4, "high_stress_barrier").otherwise("reduces_stress")
    out = out.withColumn("context", context)
    return out.withColumn("lts_score", tags.lookup(F.col("context"), L.CONTEXT_SCORE, 0.5))


def facility_case(barrier: Column, speed: Column, aadt: Column, start: Column, end: Column) -> Column:
    """The case (a key of ``BASIS``) that a road's speed and volume and the facilities at both ends make."""
    guarded = start.isin("protected_track", "shared_path") | end.isin("protected_track", "shared_path")
    return (
        F.when(barrier, "barrier_crossing")
        .when((speed > 60) | (aadt > 8000), "grade_separated_path")
        .when((speed >= 50) | (aadt >= 3000), "protected_cycle_track")
        .when((speed >= 40) | (aadt >= 1000), F.when(F.coalesce(guarded, F.lit(False)), "protected_by_ends").otherwise("painted_cycle_lane"))
        .otherwise("shared_roadway")
    )


def facility_choice(barrier: Column, speed: Column, aadt: Column, start: Column, end: Column) -> Column:
    """The recommended facility type."""
    case = facility_case(barrier, speed, aadt, start, end)
    return F.when(case == "protected_by_ends", "protected_cycle_track").otherwise(case)


def recommend(gaps: DataFrame) -> DataFrame:
    """Adds recommended (the type), facility_short, lts_achievable, cost_tier and otm18_basis."""
    speed = F.when(F.coalesce("road_maxspeed", F.lit(0)) == 0, 50).otherwise(F.col("road_maxspeed"))
    proxy = F.when(F.col("road_highway").isNull(), "unknown").otherwise(tags.aadt_proxy(F.col("road_highway")))
    aadt = tags.lookup(proxy, L.AADT_MIDPOINT, L.AADT_DEFAULT)
    case = facility_case(F.col("crosses_barrier"), speed, aadt, F.col("start_facility"), F.col("end_facility"))
    out = gaps.withColumn("_case", case)
    out = out.withColumns({"otm18_basis": tags.lookup(F.col("_case"), L.BASIS, ""), "recommended": F.when(F.col("_case") == "protected_by_ends", "protected_cycle_track").otherwise(F.col("_case"))}).drop("_case")
    kind = F.col("recommended")
    return out.withColumns({"facility_short": tags.lookup(kind, L.FACILITY_SHORT, ""), "lts_achievable": tags.lookup(kind, L.LTS_ACHIEVABLE, 2), "cost_tier": tags.lookup(kind, L.COST_TIER, "unknown")})


def with_length(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("len_m", geo.haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")))


def buildability(gaps: DataFrame) -> DataFrame:
    """Shorter and simpler is easier; a barrier weighs heavily, a road to build along helps."""
    base = 0.5 + 0.5 * F.greatest(F.lit(0.0), 1 - F.col("len_m") / 800)
    score = base * tags.lookup(F.col("recommended"), L.COMPLEXITY, 0.5)
    score = score * F.when(F.col("crosses_barrier"), 0.3).otherwise(1.0) * F.when(F.col("road_highway").isNotNull(), 1.15).otherwise(1.0)
    return gaps.withColumn("build_score", clamp(score))


def baseline(gaps: DataFrame) -> DataFrame:
    """One row: what connectivity scores are measured against."""
    kind = F.col("gap_type")
    return gaps.agg(
        F.coalesce(F.max(F.when(kind == "island", F.col("component_size"))), F.lit(50)).alias("max_island_size"),
        F.coalesce(F.max(F.when((kind == "detour") & (F.col("detour_factor") != 0), F.col("detour_factor"))), F.lit(5.0)).alias("max_detour_factor"),
        F.coalesce(F.avg(F.when((kind == "detour") & (F.col("detour_factor") != 0), F.col("detour_factor"))), F.lit(2.5)).alias("mean_detour_factor"),
        F.coalesce(F.max(F.when(kind.isin("dangling", "corridor", "connector") & (F.col("len_m") != 0), F.col("len_m"))), F.lit(600.0)).alias("max_short_gap_m"),
        F.count("*").alias("total_gaps"),
    )


def connectivity(gaps: DataFrame) -> DataFrame:
    """Adds conn_base and sep_score. The baseline is one row, so attaching it by broadcast is bounded."""
    both = gaps.join(F.broadcast(baseline(gaps).select("max_island_size", "max_short_gap_m")))
    short = 0.35 + 0.65 * F.greatest(F.lit(0.0), 1 - F.col("len_m") / F.col("max_short_gap_m"))
    short = F.when(F.col("gap_type") == "corridor", F.least(F.lit(1.0), short + 0.10)).otherwise(short)
    base = (
        F.when(F.col("gap_type") == "island", F.least(F.lit(1.0), F.coalesce("component_size", F.lit(1)) / F.col("max_island_size")))
        .when(F.col("gap_type") == "detour", F.least(F.lit(1.0), (F.coalesce("detour_factor", F.lit(2.0)) - 2.0) / 3.0))
        .when(F.col("gap_type").isin("dangling", "corridor", "connector"), tags.rounded(F.least(F.lit(1.0), short), 4))
        .otherwise(0.5)
    )
    ratio = F.col("separation_ratio")
    sep = F.when(ratio.isNull(), 0.5).when(ratio == float("inf"), 1.0).otherwise(clamp((ratio - 1.0) / 3.0))
    return both.withColumn("conn_base", base).withColumn("sep_score", sep).drop("max_island_size", "max_short_gap_m")


def destinations(gaps: DataFrame, places: DataFrame, box: tuple[float, float | None] | None = None) -> DataFrame:
    """(gap_id, dest_score): weighted places within 1 km of the midpoint (and the degrees of ``box``), half beyond 500 m, of five at most."""
    p = places.select(tags.lookup(F.col("type"), L.DESTINATION_WEIGHT, 0.3).alias("w"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = grid_join(with_midpoint(gaps).select("gap_id", "lat", "lon"), p, 1000, box=box)
    total = near.groupBy("gap_id").agg(F.sum(F.when(F.col("dist") <= 500, F.col("w")).otherwise(F.col("w") * 0.5)).alias("s"))
    return gaps.select("gap_id").join(total, "gap_id", "left").select("gap_id", F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / 5.0).alias("dest_score"))


def nearest_point(gaps: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """(gap_id, value, dist) of the point nearest to each gap's midpoint, however far; ties by ``ord``."""
    p = points.select("ord", value, F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return nearest_anywhere(with_midpoint(gaps).select("gap_id", "lat", "lon"), p, "gap_id", ["ord"], [value]).select("gap_id", value, "dist")


def equity(gaps: DataFrame, areas: DataFrame) -> DataFrame:
    """(gap_id, equity_score): from the income quintile of the nearest area; 0.5 without areas."""
    near = nearest_point(gaps, areas.withColumnRenamed("da_id", "ord"), "quintile")
    return gaps.select("gap_id").join(near, "gap_id", "left").select("gap_id", F.when(F.col("quintile").isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), (6 - F.col("quintile")) / 5.0)).alias("equity_score"))


def spine_proximity(gaps: DataFrame, spines: DataFrame) -> DataFrame:
    """(gap_id, spine_score): falls over 2 km from the nearest spine, higher for gaps at protected facilities."""
    near = nearest_point(gaps, spines, "name")
    d = F.greatest(F.lit(0.1), 1 - F.col("dist") / 2000)
    safe = F.col("start_facility").isin("protected_track", "shared_path") | F.col("end_facility").isin("protected_track", "shared_path")
    out = gaps.select("gap_id", "start_facility", "end_facility").join(near, "gap_id", "left")
    return out.select("gap_id", F.when(F.col("dist").isNull(), 0.5).when(safe, F.least(F.lit(1.0), d * 1.25)).otherwise(d).alias("spine_score"))


def composite(gaps: DataFrame) -> DataFrame:
    """Adds composite (0 to 100) and rank. Needs all partial scores."""
    gaps = gaps.withColumn("conn_score", 0.55 * F.col("conn_base") + 0.20 * F.col("spine_score") + 0.25 * F.col("sep_score"))
    raw = L.WEIGHTS["connectivity"] * F.col("conn_score") + L.WEIGHTS["buildability"] * F.col("build_score") + L.WEIGHTS["destination"] * F.col("dest_score") + L.WEIGHTS["lts"] * F.col("lts_score") + L.WEIGHTS["equity"] * F.col("equity_score")
    plan = F.when(F.col("plan_match"), 0.05).otherwise(0.0)
    same = (F.col("start_facility") == F.col("end_facility")) & F.col("start_facility").isin("protected_track", "cycle_lane", "shared_path")
    more = (
        F.when(F.col("gap_type") == "corridor", 0.12)
        .when(F.col("gap_type") == "dangling", F.when(same, 0.08).otherwise(0.04))
        .when(F.col("gap_type") == "connector", F.when(F.col("connector_class") == "quick_win", 0.06).otherwise(0.02))
        .otherwise(0.0)
    )
    out = gaps.withColumn("composite", tags.rounded(F.least(F.lit(1.0), raw + plan + more) * 100, 1))
    return ranked(out.withColumn("band", tags.priority_band(F.col("composite"))), "rank", F.desc("composite"), "ord").withColumn("rank", F.col("rank").cast("int"))


def score_gaps(gaps: DataFrame, places: DataFrame, areas: DataFrame, spines: DataFrame, box: tuple[float, float | None] | None = None) -> DataFrame:
    """All partial scores, the composite and the rank; ``box`` is that of destinations."""
    g = connectivity(buildability(recommend(lts_context(with_length(gaps)))))
    for part in (destinations(gaps, places, box), equity(gaps, areas), spine_proximity(gaps, spines)):
        g = g.join(part, "gap_id")
    return composite(g)
