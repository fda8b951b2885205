"""Detectors of missing links: pairs of nodes of different components that are close but not connected.

``prepare`` reads a network once (components, nodes, statistics); every detector takes what it returns, or plain edges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.lookups import ENDPOINT_PRIORITY, Thresholds
from lowstress.operators import network as N
from lowstress.operators.spatial import grid_join, in_rows_of, node_join, within
from lowstress.storage import checkpoint, materialize

T = Thresholds()


def _right(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("r_node"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("component").alias("r_component"), F.col("facility").alias("r_facility"))


def _first(pairs: DataFrame, by: list[str], *order: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy("dist", *order))
    return pairs.withColumn("rn", rn).where("rn = 1").drop("rn")


def _closest(pairs: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Of pairs (whole numbers and dist) the closest of each value of ``by``, as ``_first``.

    Every batch of a task leaves one row for each value, so that what is shuffled and sorted follows the nodes, not the pairs.
    """

    def first(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            at = np.lexsort([column(c) for c in reversed((*by, "dist", *order))])
            fresh = np.zeros(len(at), bool)
            fresh[:1] = True
            for c in by:
                x = column(c)[at]
                fresh[1:] |= x[1:] != x[:-1]
            yield batch.take(pa.array(at[fresh]))

    return _first(pairs.mapInArrow(first, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)), by, *order)


def _slim(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "lat", "lon", "component")


def _with_facilities(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (node, r_node) with the facilities of both ends."""
    own = nodes.select("node", "facility")
    return pairs.join(own, "node").join(own.select(F.col("node").alias("r_node"), F.col("facility").alias("r_facility")), "r_node")


def _nearest_of_others(net: Network, anchors: DataFrame, roads: DataFrame | None, radius: float) -> DataFrame:
    """Each anchor and the nearest qualifying node of another component, further away than a street's width, that no road edge joins it to."""
    right = _right(net.nodes.where("facility <> 'unknown'")).drop("r_facility")
    pairs = node_join(_with_roads(_slim(anchors), roads), right, radius, least=T.same_road, rows=net.nodes.count()).where("component <> r_component")
    best = _closest(_not_joined(pairs).select("node", "r_node", "component", "r_component", "dist"), ["node"], "r_node")
    return _with_facilities(best, net.nodes)


def _with_roads(anchors: DataFrame, roads: DataFrame | None) -> DataFrame:
    """The anchors with _joined, the nodes that a single road edge joins them to (null: none); few nodes have many."""
    if roads is None:
        return anchors.withColumn("_joined", F.lit(None).cast("array<long>"))
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))
    to = roads.select(F.explode(both).alias("x")).select("x.node", "x.to").join(anchors.select("node"), "node", "left_semi").groupBy("node").agg(F.collect_set("to").alias("_joined"))
    return anchors.join(to, "node", "left")


def _not_joined(pairs: DataFrame) -> DataFrame:
    """Pairs that no single road edge joins already."""
    return pairs.where(F.col("_joined").isNull() | ~F.array_contains("_joined", F.col("r_node"))).drop("_joined")


@dataclass(frozen=True)
class Network:
    """What all detectors read: edges, components, nodes with coordinates, component and facility, (component, size, length_m, main), and (node, degree)."""

    edges: DataFrame
    comp: DataFrame
    nodes: DataFrame
    stats: DataFrame
    degrees: DataFrame


def prepare(edges: DataFrame | Network) -> Network:
    if isinstance(edges, Network):
        return edges
    edges = materialize(edges, "edges")
    every = materialize(N.components(edges).join(N.node_ends(edges), "node"), "nodes")
    size = materialize(every.groupBy("component").agg(F.count("*").alias("size"), F.sum("length_m").alias("length_m")), "sizes")
    largest = size.agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("largest"))
    stats = size.join(F.broadcast(largest)).withColumn("main", F.col("component") == F.col("largest")).drop("largest")  # one row
    nodes = every.select("node", *N._coords(F.col("node")), "component", "facility")
    return Network(edges, every.select("node", "component"), nodes, stats, every.select("node", "degree"))


def _long(net: Network) -> DataFrame:
    return net.stats.where(F.col("length_m") >= T.component_min_length).select("component")


def cap_anchors(anchors: DataFrame, stats: DataFrame, cap: int = T.dangling_cap) -> DataFrame:
    """The anchors of the largest components first, ``cap`` at most; ties by component and node."""
    return anchors.join(stats.select("component", "size"), "component").orderBy(F.desc("size"), "component", "node").limit(cap).drop("size")


def dangling_pairs(edges: DataFrame | Network, roads: DataFrame | None = None) -> DataFrame:
    """Each dead end of a component of some length, and the nearest qualifying node of another one that no road edge joins it to."""
    net = prepare(edges)
    anchors = net.nodes.join(net.degrees.where("degree = 1").select("node"), "node", "left_semi").join(_long(net), "component", "left_semi")
    return _nearest_of_others(net, anchors, roads, T.dangling_radius)


def mutual_once(pairs: DataFrame) -> DataFrame:
    """Of two dead ends that found each other, the pair of the smaller one."""
    turned = pairs.select(F.col("r_node").alias("node"), F.col("node").alias("r_node"))
    return pairs.join(turned.where("r_node < node"), ["node", "r_node"], "left_anti")


def near_miss(edges: DataFrame | Network, least: float = T.near_miss_min) -> DataFrame:
    """The closest pair of every two components 30 to 300 m apart."""
    nodes = prepare(edges).nodes
    pairs = node_join(_slim(nodes), _right(nodes).drop("r_facility"), T.near_miss_max, rows=nodes.count()).where((F.col("dist") >= least) & (F.col("component") < F.col("r_component")))
    best = _closest(pairs.select(F.col("component").alias("c1"), F.col("r_component").alias("c2"), "dist", "node", "r_node"), ["c1", "c2"], "node", "r_node")
    return _with_facilities(best, nodes).select("c1", "c2", "dist", "node", "r_node", "facility", "r_facility")


def closest_to_main(net: Network, islands: DataFrame) -> DataFrame:
    """The closest pair of each of the components (component, size) with the largest one.

    Looked for in neighbouring cells of 600 m first, whatever the distance; for islands with nothing there, as far as any
    island's limit reaches (3000 m).
    """
    main = _right(net.nodes.join(net.stats.where("main").select("component"), "component", "left_semi")).select("r_node", "r_lat", "r_lon")
    nodes = _slim(net.nodes.join(islands.select("component"), "component", "left_semi"))
    best = lambda pairs: _closest(pairs.select("component", "node", "r_node", "dist"), ["component"], "node", "r_node")
    close = checkpoint(best(grid_join(in_rows_of(nodes, main, T.gap_max, exact=False), main, T.gap_max, exact=False, cut=False)))
    far = best(grid_join(in_rows_of(nodes, main, 3000).join(close.select("component"), "component", "left_anti"), main, 3000))
    return _with_facilities(close.unionByName(far), net.nodes).join(islands, "component")


def island_pairs(edges: DataFrame | Network) -> DataFrame:
    """Each other component of 250 m or more and its closest pair with the largest one, within 3000, 1500 or 900 m by its size."""
    net = prepare(edges)
    best = closest_to_main(net, net.stats.where((~F.col("main")) & (F.col("length_m") >= T.island_min_length)).select("component", "size"))
    limit = F.when(F.col("size") >= 10, 3000).when(F.col("size") >= 5, 1500).otherwise(900)
    return best.where((F.col("dist") <= limit) & (F.col("facility") != "unknown") & (F.col("r_facility") != "unknown"))


def by_anchor(islands: DataFrame) -> DataFrame:
    """One gap for each node of the largest component: the shortest, with the sizes of all its islands added."""
    total = F.sum("size").over(Window.partitionBy("r_node"))
    rn = F.row_number().over(Window.partitionBy("r_node").orderBy("dist", "component"))
    return islands.withColumn("total", total).withColumn("rn", rn).where("rn = 1").drop("rn", "size").withColumnRenamed("total", "size")


def connector_pairs(edges: DataFrame | Network, roads: DataFrame | None = None) -> DataFrame:
    """Facility termini and the nearest qualifying node of another component that no road edge joins them to, by class."""
    net = prepare(edges)
    anchors = net.nodes.join(N.facility_termini(net.edges).select("node"), "node", "left_semi").join(_long(net), "component", "left_semi")
    best = _nearest_of_others(net, anchors, roads, T.connector_max)
    return best.withColumn("connector_class", F.when(F.col("dist") <= T.connector_quick, "quick_win").otherwise("network_link"))


def pairs_as_gaps(pairs: DataFrame, kind: str, src: int) -> DataFrame:
    """Node pairs (node, r_node, facility, r_facility and what a detector adds) in the columns that all gaps have."""
    extra = lambda c, k: (F.col(c) if c in pairs.columns else F.lit(None)).cast(k).alias(c if c != "size" else "component_size")
    (la, lo), (lb, lb2) = N._coords(F.col("node")), N._coords(F.col("r_node"))
    return pairs.select(
        F.xxhash64(F.lit(src), "node", "r_node").alias("ord"), F.lit(kind).alias("gap_type"), F.lit(src).alias("src_ord"),
        la.alias("start_lat"), lo.alias("start_lon"), lb.alias("end_lat"), lb2.alias("end_lon"), F.col("facility").alias("start_facility"), F.col("r_facility").alias("end_facility"),
        extra("size", "long"), extra("detour_factor", "double"), extra("connector_class", "string"), extra("straight_line_m", "double"), extra("crosses_barrier", "boolean"),
    )


def corridor_ends(holes: DataFrame, net: Network) -> DataFrame:
    """Corridor holes (a, b, length_m) with qualifying facilities on both sides and a node of the cycling network within 35 m of each end, as pairs."""
    out = holes.where(F.col("start_facility").isin(*ENDPOINT_PRIORITY) & F.col("end_facility").isin(*ENDPOINT_PRIORITY))
    out = out.withColumnsRenamed({"a": "node", "b": "r_node", "length_m": "straight_line_m", "start_facility": "facility", "end_facility": "r_facility"}).withColumn("crosses_barrier", F.lit(False))
    right = net.nodes.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    for end in ("node", "r_node"):
        lat, lon = N._coords(F.col(end))
        out = out.join(within(out.select(end).distinct().select(end, lat.alias("lat"), lon.alias("lon")), right, end, T.corridor_near_cycling), end)
    return out


def detour_ends(detours: DataFrame, net: Network) -> DataFrame:
    """Detours (source, target, straight_m, detour_factor) between nodes of known facilities, as pairs."""
    f = lambda end, name: net.nodes.where("facility <> 'unknown'").select(F.col("node").alias(end), F.col("facility").alias(name))
    return detours.join(f("source", "facility"), "source").join(f("target", "r_facility"), "target").withColumnRenamed("source", "node").withColumnRenamed("target", "r_node").withColumnRenamed("straight_m", "dist")
