"""Refinement of candidate gaps: roundabouts, separation, plans, deduplication, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import geo, tags
from lowstress.graph.cells import CELL_NODES, curve
from lowstress.graph.components import connected_components
from lowstress.graph.greedy import ONE_TASK, greedily_dropped
from lowstress.lookups import Thresholds
from lowstress.operators.network import segments
from lowstress.operators.ranking import ranked
from lowstress.operators.spatial import grid_join, grid_join_limit
from lowstress.storage import checkpoint

T = Thresholds()


def roundabout_circles(ways: DataFrame, vertices: DataFrame) -> DataFrame:
    """(cluster, lat, lon, radius) of each roundabout: ways that touch are one, whatever the number of ways it is drawn as.

    A way counts with its two ends, as a road edge does, a closed one with all its vertices. The centre is the mean of the cluster's
    nodes, the radius the largest distance from it, 12 m at least; the cluster is named by its smallest node.
    """
    v = vertices.join(ways.where("junction in ('roundabout', 'circular')").select("way_id"), "way_id", "left_semi")
    v = checkpoint(v.select("way_id", "seq", "lat", "lon", geo.node_key(F.col("lat"), F.col("lon")).alias("node")))
    ends = v.groupBy("way_id").agg(F.min_by("node", "seq").alias("a"), F.max_by("node", "seq").alias("b"))
    closed = ends.where("a = b").select("way_id")
    around = segments(v.drop("node").join(closed, "way_id", "left_semi")).select("a", "b")
    comp = checkpoint(connected_components(ends.select("a", "b").unionByName(around)))
    at = v.groupBy("node").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).join(comp, "node")
    centre = at.groupBy("component").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    far = at.join(centre, "component").groupBy("component", "c_lat", "c_lon").agg(F.max(geo.haversine(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))).alias("m"))
    return far.select(F.col("component").alias("cluster"), F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), F.greatest(F.lit(float(T.roundabout_floor)), F.col("m")).alias("radius"))


def with_midpoint(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("lat", (F.col("start_lat") + F.col("end_lat")) / 2).withColumn("lon", (F.col("start_lon") + F.col("end_lon")) / 2)


def gap_length():
    return geo.haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))


def roundabout_hits(gaps: DataFrame, circles: DataFrame) -> DataFrame:
    """Ids of short gaps whose straight line passes a roundabout."""
    g = with_midpoint(gaps).where(gap_length() <= T.roundabout_max_gap).select("gap_id", "start_lat", "start_lon", "end_lat", "end_lon", "lat", "lon")
    c = circles.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "radius")
    hit = geo.point_segment(F.col("r_lat"), F.col("r_lon"), F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))["dist"] <= F.col("radius") + T.roundabout_margin
    # half a gap, a margin and the widest circle bound how far a centre can be from the midpoint
    reach = T.roundabout_max_gap / 2 + T.roundabout_margin + 500
    wide = circles.where(F.col("radius") > 500).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "radius")
    near = grid_join(g, c, reach).where(hit).select("gap_id")
    if wide.isEmpty():
        return near.distinct()
    # a circle of over 500 m is no roundabout that anyone built; those that data hold anyway meet gaps by classes of radius
    far = grid_join_limit(wide.withColumnRenamed("r_lat", "lat").withColumnRenamed("r_lon", "lon"), g.withColumnRenamed("lat", "r_lat").withColumnRenamed("lon", "r_lon"), F.col("radius") + reach, (2_000, 20_000, 200_000))
    return near.unionByName(far.withColumnRenamed("lat", "c_lat").withColumnRenamed("lon", "c_lon").withColumnRenamed("r_lat", "m_lat").withColumnRenamed("r_lon", "m_lon").withColumnRenamed("c_lat", "r_lat").withColumnRenamed("c_lon", "r_lon").where(hit).select("gap_id")).distinct()


def plan_match(gaps: DataFrame, plan: DataFrame) -> DataFrame:
    """(gap_id, plan_name): the first plan feature with a vertex within 200 m of the gap's midpoint."""
    g = with_midpoint(gaps).select("gap_id", "lat", "lon")
    p = plan.select("feature_ord", F.col("name").alias("plan_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = grid_join(g, p, T.plan_radius, fold=True).where(F.col("dist") < T.plan_radius)
    return near.groupBy("gap_id").agg(F.min_by("plan_name", "feature_ord").alias("plan_name"))


def dedup_order(gaps: DataFrame) -> DataFrame:
    """Greedy order: type priority, detour factor and length, all descending; then ``ord``."""
    return ranked(gaps, "prio", F.desc(tags.lookup(F.col("gap_type"), L.GAP_PRIORITY, 0)), F.desc(F.coalesce("detour_factor", F.lit(0.0))), F.desc("len_m"), F.asc("ord"))


def conflicts(gaps: DataFrame, separation: Column | float, within: str | None = None) -> DataFrame:
    """(hi, lo): gaps (with prio) whose midpoints are closer than ``separation`` or that have ends within 150 m; only of one ``within``, if given."""
    group = F.col(within) if within else F.lit(0)
    own = F.lit(float(separation)) if isinstance(separation, (int, float)) else separation
    gaps = gaps.withColumn("_g", group).withColumn("_s", own)
    widest = float(separation) if isinstance(separation, (int, float)) else float(T.dedup)
    mids = with_midpoint(gaps).select("prio", "_g", "_s", "lat", "lon")
    ends = gaps.select("prio", "_g", F.lit(float(T.endpoint_dedup)).alias("_s"), F.explode(F.array(*[F.struct(F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("start", "end")])).alias("p")).select("prio", "_g", "_s", "p.*")
    out = None
    for points, radius in ((mids, widest), (ends, T.endpoint_dedup)):
        right = points.select(F.col("prio").alias("lo"), F.col("_g").alias("_h"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
        pairs = grid_join(points.withColumnRenamed("prio", "hi"), right, radius).where((F.col("dist") < F.col("_s")) & (F.col("hi") < F.col("lo")) & (F.col("_g") == F.col("_h"))).select("hi", "lo")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def greedy_dedup(gaps: DataFrame, separation: Column | float = T.dedup, within: str | None = None, tile: int = CELL_NODES, one_task: int = ONE_TASK) -> DataFrame:
    """What a greedy pass in priority order keeps (one pass for each value of ``within``, if given).

    Conflicts are settled tile by tile, ``tile`` gaps that lie near each other in one (see ``graph.greedy``). That is the
    sequential result, whatever the number of partitions. Gaps without coordinates are left out.
    """
    g = checkpoint(dedup_order(gaps.where("start_lat is not null and end_lat is not null").withColumn("len_m", gap_length())))
    pairs = checkpoint(conflicts(g, separation, within))
    some = pairs.select(F.explode(F.array("hi", "lo")).alias("prio")).distinct()
    placed = with_midpoint(g.join(some, "prio", "left_semi")).select(F.col("prio").alias("node"), curve(geo.node_key(F.col("lat"), F.col("lon"))).alias("z"))
    tiles = ranked(placed, "n", "z", "node").select("node", F.floor((F.col("n") - 1) / tile).cast("long").alias("tile"))
    return g.join(greedily_dropped(pairs, tiles, one_task).withColumnRenamed("node", "prio"), "prio", "left_anti")


def number_gaps(gaps: DataFrame) -> DataFrame:
    return ranked(gaps, "_n", F.asc("prio")).withColumn("gap_id", F.format_string("GAP-%03d", F.col("_n"))).drop("_n")


def cross_method_dedup(gaps: DataFrame, buffer: float = T.dedup) -> DataFrame:
    """The greedy pass over the gaps of all detectors together."""
    return greedy_dedup(gaps, buffer)


def without_covered(gaps: DataFrame, existing: DataFrame, radius: float = T.near_miss_existing) -> DataFrame:
    """Gaps whose midpoint is not closer than ``radius`` to the midpoint of an existing gap."""
    mids = with_midpoint(existing).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    hit = grid_join(with_midpoint(gaps).select("ord", "lat", "lon"), mids, radius).where(F.col("dist") < radius).select("ord").distinct()
    return gaps.join(hit, "ord", "left_anti")


def same_road_duplicates(labelled: DataFrame, lateral: float = 25.0) -> DataFrame:
    """Gaps without those whose ends lie on one named street less than ``lateral`` metres apart; without coordinates they stay."""
    same = (F.col("from_street") != "") & (F.col("from_street") == F.col("to_street")) & (gap_length() < lateral)
    return labelled.where(~F.coalesce(same, F.lit(False)))


def is_micro_gap(length: Column) -> Column:
    """Opposite sides of one road: nothing longer than 20 m is suppressed, whatever the names."""
    return length <= T.micro_gap
