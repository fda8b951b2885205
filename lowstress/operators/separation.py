"""Operators that need distances along the cycling network: detours, separation of gap ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions import geo
from lowstress.graph.paths import shortest_paths
from lowstress.lookups import Thresholds
from lowstress.operators import network as N
from lowstress.operators.refine import is_micro_gap
from lowstress.operators.spatial import grid_join, nearest
from lowstress.storage import checkpoint

T = Thresholds()


def sample_nodes(nodes: DataFrame, wanted: int = T.detour_sample, cell_m: float = 1000.0) -> DataFrame:
    """A sample spread over the area, by a hash of the node: the same number from every cell (one at least), then others up to ``wanted``."""
    size = cell_m / geo.DEGREE_M
    cells = nodes.withColumn("r", geo.cell(F.col("lat"), size)).withColumn("c", geo.cell(F.col("lon"), size)).withColumn("h", F.md5(F.col("node").cast("string")))
    n = cells.select("r", "c").distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(wanted) / F.count("*"))).alias("each"))
    rn = F.row_number().over(Window.partitionBy("r", "c").orderBy("h", "node"))
    dealt = checkpoint(cells.withColumn("rn", rn).join(F.broadcast(n)).select("node", "lat", "lon", "h", (F.col("rn") <= F.col("each")).alias("taken")))  # one number
    missing = wanted - dealt.where("taken").count()
    spare = dealt.where("not taken").orderBy("h", "node").limit(max(0, missing))
    return dealt.where("taken").unionByName(spare).select("node", "lat", "lon")


def detour_gaps(edges: DataFrame, wanted: int | None = T.detour_sample) -> DataFrame:
    """(source, target, straight_m, network_m, detour_factor): node pairs of the largest component 50 to 600 m apart, twice as far or more by the network.

    Of a sample of ``wanted`` nodes (None: of all nodes).
    """
    edges = checkpoint(edges)
    comp = N.components(edges)
    main = N.component_stats(edges, comp).where("rank = 0").select("component")
    inside = comp.join(main, "component", "left_semi")
    nodes = N.nodes(edges).join(inside, "node", "left_semi")
    nodes = checkpoint(nodes) if wanted is None else sample_nodes(nodes, wanted)
    right = nodes.select(F.col("node").alias("target"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    pairs = grid_join(nodes.withColumnRenamed("node", "source"), right, T.gap_max).where((F.col("source") < F.col("target")) & (F.col("dist") >= 50))
    pairs = checkpoint(pairs.select(F.xxhash64("source", "target").alias("pair_id"), "source", "target", F.col("dist").alias("straight_m")))
    found = shortest_paths(edges, pairs.select("pair_id", "source", "target"), comp=inside)
    out = pairs.join(found.select("pair_id", F.col("cost").alias("network_m")), "pair_id").withColumn("detour_factor", F.col("network_m") / F.col("straight_m"))
    return out.where((F.col("detour_factor") >= T.detour_min) & ~is_micro_gap(F.col("straight_m"))).drop("pair_id")


def separation(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """(gap_id, network_m, separation_ratio, keep) of gaps both of whose ends are within 50 m of a network node.

    The same node, or no path: infinite. keep is false where the ends are connected already (ratio up
    to 1.4 and no longer than 60 m).
    """
    edges = checkpoint(edges)
    comp = N.components(edges)
    n = N.nodes(edges).select("node", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    ends = []
    for e in ("start", "end"):
        at = gaps.select("gap_id", F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon"))
        ends.append(nearest(at, n, "gap_id", T.endpoint_to_cycling, ["node"]).select("gap_id", F.col("node").alias(e)))
    straight = geo.haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))
    both = checkpoint(ends[0].join(ends[1], "gap_id").join(gaps.select("gap_id", straight.alias("straight_m")), "gap_id").withColumn("pair_id", F.xxhash64("gap_id")))
    ask = both.where("start <> end").select("pair_id", F.col("start").alias("source"), F.col("end").alias("target"))
    found = shortest_paths(edges, ask, comp=comp).select("pair_id", F.col("cost").alias("network_m"))
    out = both.join(found, "pair_id", "left")
    ratio = F.when(F.col("network_m").isNull() | (F.col("straight_m") == 0), F.lit(float("inf"))).otherwise(F.col("network_m") / F.col("straight_m"))
    out = out.withColumn("separation_ratio", ratio)
    keep = ~((F.col("separation_ratio") <= T.connected_ratio) & (F.col("straight_m") <= T.connected_length))
    return out.select("gap_id", "network_m", "separation_ratio", keep.alias("keep"))
