"""Routes: weighted road edges, roll-up of segments, quality, comparison of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import tags
from lowstress.lookups import Thresholds
from lowstress.operators.score import facility_choice

T = Thresholds()


def weighted_edges(roads: DataFrame) -> DataFrame:
    """Adds lts and lts_cost (length times the stress multiplier)."""
    e = roads.withColumn("lts", tags.segment_lts(F.col("highway"), F.col("maxspeed"), F.col("lanes"), F.col("cycleway")))
    return e.withColumn("lts_cost", F.col("length_m") * tags.lookup(F.col("lts"), L.LTS_COST, 3.0))


def segment_facility(edges: DataFrame) -> DataFrame:
    speed = F.when(F.coalesce("maxspeed", F.lit(0)) == 0, 50).otherwise(F.col("maxspeed"))
    aadt = tags.lookup(F.col("aadt_proxy"), L.AADT_MIDPOINT, L.AADT_DEFAULT)
    return edges.withColumn("recommended", facility_choice(F.lit(False), speed, aadt, F.lit(None).cast("string"), F.lit(None).cast("string")))


def roll_up(segments: DataFrame, key: str = "gap_id") -> DataFrame:
    """Per route: length, worst stress, problem length and share, stress-4 share, dominant facility, cost, complexity."""
    cost = F.sum(F.col("length_m") * tags.lookup(F.col("recommended"), L.COST_PER_METRE, 500))
    by = segments.groupBy(key, "recommended").agg(
        F.sum("length_m").alias("m"), F.max("lts").alias("w"), F.sum(F.when(F.col("lts") >= 3, F.col("length_m")).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col("lts") >= 4, F.col("length_m")).otherwise(0.0)).alias("p4"), cost.alias("c"),
    )
    out = by.groupBy(key).agg(
        F.sum("m").alias("total_length_m"), F.max("w").alias("worst_lts"), F.sum("p").alias("problem_m"), F.sum("p4").alias("lts4_m"), F.sum("c").alias("estimated_cost"),
        F.max_by("recommended", F.struct("m", "recommended")).alias("dominant_facility"),
    )
    pct = F.when(F.col("total_length_m") > 0, 100 * F.col("problem_m") / F.col("total_length_m")).otherwise(0.0)
    out = out.withColumn("problem_pct", F.round(pct, 1)).withColumn("lts4_pct", F.when(F.col("total_length_m") > 0, 100 * F.col("lts4_m") / F.col("total_length_m")).otherwise(0.0))
    return out.withColumn("complexity", F.when(F.col("worst_lts") <= 2, "straightforward").when(F.col("problem_pct") <= 30, "moderate").otherwise("complex"))


def with_quality(routes: DataFrame) -> DataFrame:
    """Adds detour_ratio and quality; needs straight_line_m, found and fallback."""
    out = routes.withColumn("detour_ratio", F.when(F.col("straight_line_m") > 0, F.col("total_length_m") / F.col("straight_line_m")).otherwise(1.0))
    high = F.when(F.col("total_length_m") > 0, 100 * F.col("problem_m") / F.col("total_length_m")).otherwise(0.0)
    quality = (
        F.when(~F.col("found"), "")
        .when(F.col("fallback") | (F.col("detour_ratio") > T.route_detour) | (F.col("lts4_pct") > 40), "poor")
        .when((high <= 5) & (F.col("detour_ratio") <= 1.4), "excellent")
        .when((high <= 20) & (F.col("lts4_pct") <= 10), "good")
        .when((F.col("lts4_pct") <= 25) & (F.col("detour_ratio") <= 2.0), "fair")
        .otherwise("poor")
    )
    return out.withColumn("quality", quality)


def compare(lts: DataFrame, shortest: DataFrame, key: str = "gap_id") -> DataFrame:
    """(key, length_ratio, verdict) of the low-stress against the shortest route; both with found, fallback, total_length_m, worst_lts."""
    s = shortest.select(key, F.col("found").alias("s_found"), F.col("total_length_m").alias("s_len"), F.col("worst_lts").alias("s_worst"))
    both = lts.select(key, "found", "fallback", "total_length_m", "worst_lts").join(s, key)
    ok = F.col("found") & F.col("s_found")
    ratio = F.when(ok, F.when(F.col("s_len") > 0, F.round(F.col("total_length_m") / F.col("s_len"), 2)).otherwise(1.0))
    verdict = (
        F.when(~ok, "incomplete")
        .when(F.col("s_worst") <= 2, "direct_is_comfortable")
        .when(F.col("fallback") | (F.col("worst_lts") >= 4), "no_comfortable_route")
        .when(F.col("length_ratio") <= 1.1, "comfort_for_free")
        .otherwise("detour_buys_comfort")
    )
    return both.withColumn("length_ratio", ratio).withColumn("verdict", verdict).select(key, "length_ratio", "verdict")
