"""What the road network says about a gap: candidate roads, barriers, street labels, buildability.

Gaps need ``ord`` (unique) and the coordinates of both ends; roads the columns of ``network.road_edges``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import geo
from lowstress.lookups import Thresholds
from lowstress.operators.refine import gap_length, with_midpoint
from lowstress.operators.pyramid import nearest_anywhere
from lowstress.operators.spatial import grid_join, grid_join_limit

T = Thresholds()
#: Degrees of latitude and longitude that a search looks at, whatever the distance (None: all).
Box = tuple[float, float | None] | None


def _middles(gaps: DataFrame, key: str) -> DataFrame:
    return with_midpoint(gaps.withColumn("len_m", gap_length())).select(key, "lat", "lon", "len_m")


def _road_points(roads: DataFrame) -> DataFrame:
    return roads.select("way_id", "highway", F.col("name").alias("road"), "maxspeed", "lanes", F.col("mid_lat").alias("r_lat"), F.col("mid_lon").alias("r_lon"))


def candidate_roads(gaps: DataFrame, roads: DataFrame, key: str = "ord", box: Box = None) -> DataFrame:
    """(key, way_id, highway, maxspeed, lanes, dist, rn): the five roads nearest to a gap's midpoint within 100 m or 0.3 of its length."""
    limit = F.greatest(F.lit(float(T.candidate_buffer)), 0.3 * F.col("len_m"))
    pairs = grid_join_limit(_middles(gaps, key), _road_points(roads), limit, box=box)
    rn = F.row_number().over(Window.partitionBy(key).orderBy("dist", "way_id"))
    return pairs.withColumn("rn", rn).where("rn <= 5").select(key, "way_id", "highway", "maxspeed", "lanes", "dist", "rn")


def barriers(gaps: DataFrame, roads: DataFrame, key: str = "ord", box: Box = None) -> DataFrame:
    """(key): gaps with a motorway or trunk road within half their length of their midpoint."""
    motor = _road_points(roads.where(F.col("highway").isin(*L.MOTOR_ONLY)))
    return grid_join_limit(_middles(gaps, key), motor, 0.5 * F.col("len_m"), box=box).select(key).distinct()


def end_labels(gaps: DataFrame, roads: DataFrame, key: str = "ord", box: Box = None) -> DataFrame:
    """(key, from_street, to_street): the nearest named road within 150 m of each end, else the class of the nearest within 200 m, else Unknown."""
    ends = F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("start", "end")])
    at = gaps.select(key, F.explode(ends).alias("p")).select(key, "p.*")
    near = grid_join(at, _road_points(roads), 200, box=box)
    order, named = F.struct("dist", "way_id"), (F.col("road") != "") & (F.col("dist") <= 150)
    best = near.groupBy(key, "e").agg(F.min(F.when(named, F.struct("dist", "way_id", "road"))).alias("n"), F.min_by("highway", order).alias("h"))
    label = F.coalesce(F.col("n.road"), F.concat(F.lit("Unnamed "), F.col("h")))
    side = lambda e: F.max(F.when(F.col("e") == e, label))
    labels = best.groupBy(key).agg(side("start").alias("f"), side("end").alias("t"))
    out = gaps.select(key).join(labels, key, "left")
    return out.select(key, F.coalesce("f", F.lit("Unknown")).alias("from_street"), F.coalesce("t", F.lit("Unknown")).alias("to_street"))


def nearest_named_road(points: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    """(key, way_id, road, dist): the nearest road with a name, however far."""
    return nearest_anywhere(points.select(key, "lat", "lon"), _road_points(roads.where("name <> ''")), key, ["way_id"], ["road"])


def follows_road(gaps: DataFrame, roads: DataFrame, key: str = "ord", tolerance: float = T.connector_tolerance, samples: int = T.connector_samples, least: float = 0.5, box: float | None = None) -> DataFrame:
    """(key): gaps along which at least half of ``samples`` + 1 points, ends included, lie within ``tolerance`` of some road edge (and ``box`` degrees of its bounds, if given)."""
    size = 6 * tolerance / geo.DEGREE_M  # wide enough east to west up to 80 degrees
    i = F.col("i") / F.lit(float(samples))
    at = gaps.select(key, "start_lat", "start_lon", "end_lat", "end_lon", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i"))
    at = at.select(key, "i", (F.col("start_lat") + (F.col("end_lat") - F.col("start_lat")) * i).alias("lat"), (F.col("start_lon") + (F.col("end_lon") - F.col("start_lon")) * i).alias("lon"))
    around = F.array(*[F.struct((geo.cell(F.col("lat"), size) + j).alias("r"), (geo.cell(F.col("lon"), size) + k).alias("c")) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    cells = roads.select("lat1", "lon1", "lat2", "lon2", F.explode(geo.segment_cells(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), size)).alias("k"))
    met = at.withColumn("k", F.explode(around)).hint("merge").join(cells, "k")  # both are exploded, so their estimates are far too small
    hit = met.where(geo.point_segment(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))["dist"] <= tolerance)
    for c in ("lat", "lon") if box is not None else ():
        hit = hit.where((F.greatest(f"{c}1", f"{c}2") >= F.col(c) - box) & (F.least(f"{c}1", f"{c}2") <= F.col(c) + box))
    return hit.groupBy(key).agg(F.count_distinct("i").alias("n")).where(F.col("n") >= least * (samples + 1)).select(key)


def attach(gaps: DataFrame, roads: DataFrame) -> DataFrame:
    """Adds crosses_barrier, from_street, to_street, gap_label, candidate_roads (way ids, nearest first) and the attributes of the nearest one.

    A gap that has crosses_barrier already (corridors: false) keeps it.
    """
    c = candidate_roads(gaps, roads)
    first = F.when(F.col("rn") == 1, F.struct("highway", "maxspeed", "lanes"))
    c = c.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "way_id"))), lambda x: x["way_id"]).alias("candidate_roads"), F.max(first).alias("m"))
    c = c.select("ord", "candidate_roads", F.col("m.highway").alias("road_highway"), F.col("m.maxspeed").alias("road_maxspeed"), F.col("m.lanes").alias("road_lanes"))
    had = F.col("crosses_barrier") if "crosses_barrier" in gaps.columns else F.lit(None).cast("boolean")
    out = gaps.withColumn("_had", had).drop("crosses_barrier").join(c, "ord", "left").join(end_labels(gaps, roads), "ord")
    out = out.join(barriers(gaps, roads).withColumn("_hit", F.lit(True)), "ord", "left")
    return out.withColumn("crosses_barrier", F.coalesce("_had", "_hit", F.lit(False))).drop("_had", "_hit")
