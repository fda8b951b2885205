"""Spines: long protected edges around the most central nodes, with names from the nearest road."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.graph.components import connected_components
from lowstress.graph.paths import betweenness
from lowstress.lookups import Thresholds
from lowstress.operators import network as N
from lowstress.operators.spatial import nearest
from lowstress.storage import checkpoint

T = Thresholds()


def detect_spines(edges: DataFrame, named_roads: DataFrame) -> DataFrame:
    """(spine, name, lat, lon, total_length_m, facility, n_nodes): the pieces that the most central nodes of protected edges form.

    With fewer than four such nodes, the five largest components of the whole network instead.
    """
    # all that is read several times is stored: the edges may be a long plan, and so is the centrality
    long = checkpoint(edges.where(F.col("facility").isin("protected_track", "shared_path") & (F.col("length_m") >= T.spine_edge)).select("a", "b", "facility", "length_m"))
    central = betweenness(long) if long.select(F.explode(F.array("a", "b")).alias("n")).distinct().limit(4).count() == 4 else None
    if central is not None:
        top = checkpoint(central.orderBy(F.desc("centrality"), "node").limit(T.spine_top).select("node"))
        a, b = top.withColumnRenamed("node", "a"), top.withColumnRenamed("node", "b")
        inside = long.join(a, "a", "left_semi").join(b, "b", "left_semi")
        comp = connected_components(inside)
    else:
        inside = edges = checkpoint(edges.select("a", "b", "facility", "length_m"))
        comp = connected_components(edges)
        five = N.component_stats(edges, comp).where("rank < 5").select("component")
        comp = comp.join(five, "component", "left_semi").select("node", "component")
    comp = checkpoint(comp)
    at = N.nodes(inside).join(comp, "node").groupBy(F.col("component").alias("spine")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n_nodes"))
    own = inside.join(comp, inside.a == comp.node).groupBy(F.col("component").alias("spine")).agg(F.sum("length_m").alias("total_length_m"), F.mode("facility", True).alias("facility"))
    out = checkpoint(at.join(own, "spine").where("n_nodes >= 2"))
    roads = named_roads.where("name <> ''").select("way_id", "name", F.col("mid_lat").alias("r_lat"), F.col("mid_lon").alias("r_lon"))
    label = nearest(out.select("spine", "lat", "lon"), roads, "spine", 100, ["way_id"]).select("spine", "name")
    return out.join(label, "spine", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Spine "), F.col("spine").cast("string"))))


def spines_by_name(roads: DataFrame, wanted: list[str]) -> DataFrame:
    """(name, lat, lon, total_length_m) of the user's spines: roads whose name contains the given one, whatever the case."""
    rows = [F.when(F.lower("name").contains(w.lower()), F.lit(w)) for w in wanted]
    return roads.withColumn("spine", F.coalesce(*rows)).where("spine is not null").groupBy(F.col("spine").alias("name")).agg(F.avg("mid_lat").alias("lat"), F.avg("mid_lon").alias("lon"), F.sum("length_m").alias("total_length_m"))
