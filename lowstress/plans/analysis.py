"""The gap analysis from ways to ranked gaps: one network, all detectors, refinement, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.lookups import Thresholds
from lowstress.operators import attach, clean, corridor, detect, refine, score
from lowstress.operators import network as N
from lowstress.operators import separation as SEP
from lowstress.operators.spines import detect_spines, spines_by_name
from lowstress.storage import checkpoint, materialize

T = Thresholds()


def build_network(ways: DataFrame, vertices: DataFrame) -> DataFrame:
    """Cycling ways and facilities along roads as one graph, nodes within 15 m snapped, topology cleaned: (a, b, facility, length_m, ...)."""
    merged = N.network_edges(ways, vertices).drop("source", "drawn", "along")
    return materialize(clean.clean_topology(N.snapped_edges(merged, T.snap)), "network")


def find_gaps(net: detect.Network, roads: DataFrame, connectors: bool = True) -> DataFrame:
    """The gaps of all detectors in their order, each deduplicated on its own: what the road network says is attached.

    Every dead end, and for detours every node of the largest component, is looked at. ``connectors`` is the detector that users switch on.
    """
    islands = detect.pairs_as_gaps(detect.by_anchor(detect.island_pairs(net)), "island", 0)
    detours = detect.pairs_as_gaps(detect.detour_ends(SEP.detour_gaps(net.edges, None), net), "detour", 1)
    dangling = detect.pairs_as_gaps(detect.mutual_once(detect.dangling_pairs(net, roads)), "dangling", 2)
    corridors = detect.pairs_as_gaps(detect.corridor_ends(corridor.corridor_gaps(roads), net), "corridor", 3)
    parts = [islands, detours, dangling, corridors]
    if connectors:
        links = detect.pairs_as_gaps(detect.mutual_once(detect.connector_pairs(net, roads)), "connector", 5)
        links = links.join(attach.barriers(links, roads), "ord", "left_anti").join(attach.follows_road(links, roads), "ord", "left_semi")
        parts.append(links)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    kept = checkpoint(refine.greedy_dedup(checkpoint(found), within="src_ord").drop("prio", "len_m"))
    misses = detect.pairs_as_gaps(detect.near_miss(net).where("facility <> 'unknown' and r_facility <> 'unknown'"), "dangling", 4)
    misses = refine.without_covered(checkpoint(misses), kept.where("src_ord < 4"))
    misses = refine.greedy_dedup(misses, float(T.near_miss_existing)).drop("prio", "len_m")
    return checkpoint(attach.attach(kept.unionByName(misses), roads))


def refine_gaps(gaps: DataFrame, net: detect.Network, ways: DataFrame, vertices: DataFrame, plan: DataFrame) -> DataFrame:
    """Cross-method deduplication, roundabouts, separation by the network, plans, numbers. A gap with an end that is no longer near the network goes, unless it has no length."""
    g = checkpoint(refine.number_gaps(refine.cross_method_dedup(gaps)))
    g = g.join(refine.roundabout_hits(g, refine.roundabout_circles(ways, vertices)), "gap_id", "left_anti")
    apart = SEP.separation(g, net.edges).withColumnRenamed("network_m", "current_network_m")
    g = g.join(apart, "gap_id", "left").where(F.coalesce("keep", refine.gap_length() <= 0)).drop("keep")
    planned = refine.plan_match(g, plan).select("gap_id", F.lit(True).alias("plan_match"))
    g = g.join(planned, "gap_id", "left").withColumn("plan_match", F.coalesce("plan_match", F.lit(False)))
    return checkpoint(refine.number_gaps(g.drop("gap_id")))


def gap_analysis(
    ways: DataFrame, vertices: DataFrame, places: DataFrame, areas: DataFrame, plan: DataFrame, wanted_spines: list[str] | None = None, connectors: bool = True,
) -> DataFrame:
    """Ranked gaps with all scores. Spines are those of the network itself, or the roads of the names that the user wants as spines."""
    net = detect.prepare(build_network(ways, vertices))
    roads = materialize(N.road_edges(ways, vertices), "roads")
    found = spines_by_name(roads, wanted_spines) if wanted_spines else detect_spines(net.edges, roads)
    spines = checkpoint(found.select(F.xxhash64("name", "lat", "lon").alias("ord"), "name", "lat", "lon"))
    gaps = refine_gaps(find_gaps(net, roads, connectors), net, ways, vertices, plan)
    return score.score_gaps(gaps, places, areas, spines)
