"""Why a place has no gap: what the network and the detectors see inside a bounding box."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions import geo
from lowstress.lookups import Thresholds
from lowstress.operators import network as N
from lowstress.operators.detect import Network, _right, closest_to_main, prepare
from lowstress.operators.ranking import ranked
from lowstress.operators.spatial import grid_join
from lowstress.storage import checkpoint, materialize

T = Thresholds()


Box = tuple[float, float, float, float]


def nodes_in(edges: DataFrame | Network, box: Box) -> DataFrame:
    """(node, lat, lon, degree, component, facility, facilities) inside the box."""
    net = prepare(edges)
    kinds = net.edges.select(F.explode(F.array("a", "b")).alias("node"), "facility").groupBy("node").agg(F.count("*").alias("degree"), F.array_sort(F.collect_set("facility")).alias("facilities"))
    return net.nodes.where(geo.in_bbox(F.col("lat"), F.col("lon"), *box)).join(kinds, "node")


def nodes_near(edges: DataFrame | Network, box: Box, k: int = 10) -> DataFrame:
    """The nodes inside the box with dist null; if there are none, the ``k`` nearest to its middle."""
    net = prepare(edges)
    inside = nodes_in(net, box).select("node", "lat", "lon", "component", "facility", F.lit(None).cast("double").alias("dist"))
    if not inside.isEmpty():
        return inside
    middle = F.lit((box[0] + box[2]) / 2), F.lit((box[1] + box[3]) / 2)
    away = net.nodes.withColumn("dist", geo.haversine(F.col("lat"), F.col("lon"), *middle))
    return away.orderBy("dist", "node").limit(k).select("node", "lat", "lon", "component", "facility", "dist")


def build_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(step, nodes, edges, components) of the networks of each step of the build, in order."""
    out = None
    for i, (name, e) in enumerate(parts.items()):
        e = materialize(e.select("a", "b"), "step")
        found = N.components(e).agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
        one = found.join(F.broadcast(e.agg(F.count("*").alias("edges"))))  # one row each
        one = one.select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "nodes", "edges", "components")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("step_no")


def island_trace(edges: DataFrame | Network, box: Box) -> DataFrame:
    """(component, size, length_m, dist, reason) of the components that touch the box: why each is, or is not, an island gap."""
    net = prepare(edges)
    touched = nodes_in(net, box).select("component").distinct()
    stats = net.stats.join(touched, "component", "left_semi")
    best = closest_to_main(net, stats.where("not main").select("component", "size")).select("component", "dist", "facility", "r_facility")
    limit = F.when(F.col("size") >= 10, 3000).when(F.col("size") >= 5, 1500).otherwise(900)
    reason = (
        F.when(F.col("main"), "largest component").when(F.col("length_m") < T.island_min_length, "too short").when(F.col("dist").isNull(), "nothing within 3000 m")
        .when(F.col("dist") > limit, "too far").when((F.col("facility") == "unknown") | (F.col("r_facility") == "unknown"), "facility unknown").otherwise("candidate")
    )
    return stats.join(best, "component", "left").select("component", "size", "length_m", "dist", reason.alias("reason"))


def near_miss_trace(edges: DataFrame | Network, box: Box, least: float = 20, most: int | None = None) -> DataFrame:
    """(node, r_node, component, r_component, facility, r_facility, dist, status) of node pairs ``least`` to 300 m apart, one of which is inside the box.

    Nearest first; ``most`` keeps that many for a report.
    """
    net = prepare(edges)
    inside = net.nodes.where(geo.in_bbox(F.col("lat"), F.col("lon"), *box) & (F.col("facility") != "unknown"))
    pairs = grid_join(inside, _right(net.nodes), T.near_miss_max).where((F.col("dist") >= least) & (F.col("component") != F.col("r_component")))
    seen = F.row_number().over(Window.partitionBy(F.least("node", "r_node"), F.greatest("node", "r_node")).orderBy("node"))
    pairs = pairs.withColumn("seen", seen).where("seen = 1")
    status = F.when((F.col("facility") != "unknown") & (F.col("r_facility") != "unknown"), "would create a gap").otherwise("filtered by facility")
    out = pairs.select("node", "r_node", "component", "r_component", "facility", "r_facility", "dist", status.alias("status"))
    return out if most is None else out.orderBy("dist", "node", "r_node").limit(most)


def summary(edges: DataFrame | Network, box: Box) -> DataFrame:
    """One row: nodes, edges, components, main_nodes, short_islands, dangling_in_box, near_miss_in_box."""
    net = prepare(edges)
    c = net.stats.agg(
        F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max(F.when(F.col("main"), F.col("size"))).alias("main_nodes"),
        F.count_if(~F.col("main") & (F.col("length_m") < T.island_min_length)).alias("short_islands"),
    )
    ends = net.degrees.where("degree = 1").join(net.nodes, "node").where(geo.in_bbox(F.col("lat"), F.col("lon"), *box)).agg(F.count("*").alias("dangling_in_box"))
    near = near_miss_trace(net, box).agg(F.count("*").alias("near_miss_in_box"))
    return c.crossJoin(net.edges.agg(F.count("*").alias("edges"))).crossJoin(ends).crossJoin(near)  # one row each


def dangling_trace(edges: DataFrame | Network, box: Box) -> DataFrame:
    """(node, checked, same_component, not_qualifying, candidates) of the dead ends inside the box."""
    net = prepare(edges)
    nodes = net.nodes
    ends = nodes.join(net.degrees.where("degree = 1").select("node"), "node", "left_semi").where(geo.in_bbox(F.col("lat"), F.col("lon"), *box))
    near = grid_join(ends, _right(nodes), T.dangling_radius, exact=False).where("node <> r_node")
    same, bad = F.col("component") == F.col("r_component"), F.col("r_facility") == "unknown"
    return near.groupBy("node").agg(
        F.count("*").alias("checked"), F.count_if(same).alias("same_component"), F.count_if(~same & bad).alias("not_qualifying"), F.count_if(~same & ~bad & (F.col("dist") > T.same_road)).alias("candidates")
    )


def ways_in(ways: DataFrame, vertices: DataFrame, box: Box) -> DataFrame:
    """(way_id, facility, highway, cycleway, name, length_m, vertices, start_lat, ..., end_lon) of the ways with a vertex inside the box."""
    inside = vertices.where(geo.in_bbox(F.col("lat"), F.col("lon"), *box)).select("way_id").distinct()
    v = vertices.join(inside, "way_id", "left_semi")
    point = F.struct("lat", "lon")
    ends = v.groupBy("way_id").agg(F.min_by(point, "seq").alias("p"), F.max_by(point, "seq").alias("q"), F.count("*").alias("vertices"))
    length = N.segments(v).groupBy("way_id").agg(F.sum("length_m").alias("length_m"))
    out = N.with_facility(ways).join(ends, "way_id").join(length, "way_id", "left")
    return out.select(
        "way_id", "facility", "highway", N.cycleway_of(ways).alias("cycleway"), "name", F.coalesce("length_m", F.lit(0.0)).alias("length_m"), "vertices",
        F.col("p.lat").alias("start_lat"), F.col("p.lon").alias("start_lon"), F.col("q.lat").alias("end_lat"), F.col("q.lon").alias("end_lon"),
    )


TITLES = {
    1: "DATA", 2: "CYCLING WAYS INSIDE THE BOX", 3: "ROAD WAYS WITH CYCLEWAY TAGS INSIDE THE BOX", 4: "BUILDING THE CYCLING NETWORK", 5: "NODES INSIDE THE BOX", 6: "COMPONENTS THAT TOUCH THE BOX",
    7: "DEAD ENDS INSIDE THE BOX", 8: "NEAR MISSES INSIDE THE BOX", 9: "SUMMARY",
}


def report(ways: DataFrame, vertices: DataFrame, steps: dict[str, DataFrame], box: Box, region: str) -> DataFrame:
    """(place, section, line): the diagnostic report of a box in nine sections, lines numbered from 1.

    ``steps`` are the networks of the build in order; the last one is what gaps are found on. Every section lists all that it
    found; an empty one says so.
    """
    net = prepare(list(steps.values())[-1])
    rows, drawn = checkpoint(ways_in(ways, vertices, box)), ways.where(N.is_cycling_way(ways)).select("way_id")
    tagged = rows.where("cycleway <> ''").join(ways.where(N.is_road_way(ways)).select("way_id"), "way_id", "left_semi")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    number = lambda c: F.coalesce(F.col(c), F.lit(float("nan"))).cast("double")
    # lines of a section stand in the order of a number, then of a text
    say = lambda df, order, text_order, form, *cols: df.select((F.col(order) if isinstance(order, str) else order).cast("double").alias("k"), text_order.alias("t"), F.concat(F.lit("  "), F.format_string(form, *cols)).alias("line"))
    data = ways.agg(F.count("*").alias("ways"), F.count_if(N.is_cycling_way(ways)).alias("cycling"), F.count_if(N.is_road_way(ways)).alias("roads"))
    none, node = F.lit(""), F.concat_ws(" ", "node", "r_node")
    parts = {
        1: say(data, "ways", none, f"{region}, box {box}: %d ways, %d for cycling, %d roads", "ways", "cycling", "roads"),
        2: say(rows.join(drawn, "way_id", "left_semi"), F.lit(0), text("way_id"), "%s  %s  %.0f m  (%.5f,%.5f) to (%.5f,%.5f)  %s", text("way_id"), "facility", "length_m", "start_lat", "start_lon", "end_lat", "end_lon", text("name")),
        3: say(tagged, F.lit(0), text("way_id"), "%s  %s  %s  %s  %.0f m", text("way_id"), text("highway"), "cycleway", "facility", "length_m"),
        4: say(build_counts(steps), "step_no", none, "%s: %d nodes, %d edges, %d components", "step", "nodes", "edges", "components"),
        5: say(nodes_in(net, box), "node", none, "%d  (%.5f,%.5f)  degree %d  component %d  %s  [%s]", "node", "lat", "lon", "degree", "component", "facility", F.array_join("facilities", ", ")),
        6: say(island_trace(net, box), -F.col("size"), text("component"), "component %d: %d nodes, %.0f m, nearest pair to the largest %.0f m: %s", "component", "size", "length_m", number("dist"), "reason"),
        7: say(dangling_trace(net, box), "node", none, "%d: %d checked, %d of the same component, %d not qualifying, %d candidates", "node", "checked", "same_component", "not_qualifying", "candidates"),
        8: say(near_miss_trace(net, box), "dist", node, "%.0f m  component %d to %d  %s to %s: %s", "dist", "component", "r_component", "facility", "r_facility", "status"),
        9: say(summary(net, box), "nodes", none, "%d nodes, %d edges, %d components, the largest of %d nodes; %d short islands; %d dead ends and %d near misses in the box", "nodes", "edges", "components", "main_nodes", "short_islands", "dangling_in_box", "near_miss_in_box"),
    }
    spark, out = net.edges.sparkSession, None
    for n, lines in parts.items():
        head = spark.createDataFrame([(float("-inf"), "", f"[{n}] {TITLES[n]}")], "k double, t string, line string")
        one = head.unionByName(lines).withColumn("section", F.lit(n))
        out = one if out is None else out.unionByName(one)
    out = checkpoint(out)
    found = out.groupBy("section").agg(F.count("*").alias("n")).where("n = 1")
    nothing = found.select(F.lit(0.0).alias("k"), F.lit("").alias("t"), F.lit("  (nothing)").alias("line"), "section")
    return ranked(out.unionByName(nothing), "place", "section", "k", "t", "line").select("place", "section", "line")


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text, in order."""
    lines.orderBy("place").select("line").write.text(path)
