"""Corridor gaps: holes in streets that are partly cycled, found on ordered chains of a street's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions import geo, tags
from lowstress.graph.chains import ONE_TASK, chain_order, joints_of
from lowstress.lookups import Thresholds
from lowstress.storage import checkpoint

T = Thresholds()
#: Values of a cycleway tag, or of one for a side of the road, that make an edge cycled.
CYCLED = ("track", "lane")


def cycled_tag(roads: DataFrame):
    """The first of the cycleway tags (road, left, right, both) that says track or lane; null: none."""
    named = [c for c in ("cycleway", "cycleway_left", "cycleway_right", "cycleway_both") if c in roads.columns]
    return F.coalesce(*[F.when(F.col(c).isin(*CYCLED), F.col(c)) for c in named])


def street_chains(roads: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(name, chain, pos, a, b, length_m, cycled, facility): the edges of each street in order, from a to b, chain by chain.

    A chain leads from one node in which its street ends or forks to the next; streets that only go round have none. Order
    comes from list ranking over all streets at once, so a name that very many roads share is no group. ``facility`` is
    what the tags of a cycled edge say.
    """
    tag = cycled_tag(roads)
    edges = roads.where("name <> ''").select("name", "way_id", "a", "b", "length_m", tag.isNotNull().alias("cycled"), F.when(tag.isNotNull(), tags.infer_facility(tag)).alias("facility"))
    edges = checkpoint(edges.withColumn("eid", F.monotonically_increasing_id()))
    at = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).cast("long").alias("s")), F.struct(F.col("b").alias("node"), F.lit(1).cast("long").alias("s"))))
    joints = checkpoint(joints_of(edges.select("name", "eid", at.alias("p")).select("name", "eid", "p.node", "p.s"), ["name", "node"]))
    order = chain_order(edges, joints, one_task)
    return edges.drop("a", "b").join(order, "eid").select("name", "chain", "pos", F.col("u").alias("a"), F.col("v").alias("b"), "length_m", "cycled", "facility")


def corridor_holes(chains: DataFrame) -> DataFrame:
    """(name, chain, hole, a, b, length_m, start_facility, end_facility): runs without a facility between cycled edges, 20 to 800 m long."""
    w = Window.partitionBy("chain").orderBy("pos")
    x = chains.withColumn("turn", F.coalesce((F.lag("cycled").over(w) != F.col("cycled")).cast("int"), F.lit(0)))
    x = x.withColumns({"run": F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("facility").over(w), "after": F.lead("facility").over(w)})
    runs = x.groupBy("name", "chain", "run").agg(
        F.min_by("a", "pos").alias("a"), F.max_by("b", "pos").alias("b"), F.sum("length_m").alias("length_m"), F.first("cycled").alias("cycled"),
        F.min_by("before", "pos").alias("start_facility"), F.max_by("after", "pos").alias("end_facility"),
    )
    holes = runs.where(~F.col("cycled") & F.col("start_facility").isNotNull() & F.col("end_facility").isNotNull())
    return holes.where(F.col("length_m").between(T.corridor_min, T.corridor_max)).select("name", "chain", F.col("run").cast("int").alias("hole"), "a", "b", "length_m", "start_facility", "end_facility")


def corridor_gaps(roads: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Holes of streets with three edges or more, 30% or more of whose length is cycled; ends more than 30 m apart."""
    from lowstress.operators.network import _coords

    cycled = F.sum(F.when(cycled_tag(roads).isNotNull(), F.col("length_m")).otherwise(0.0))
    good = roads.where("name <> ''").groupBy("name").agg(F.count("*").alias("n"), (cycled / F.sum("length_m")).alias("share")).where("n >= 3 and share >= 0.30").select("name")
    holes = corridor_holes(street_chains(roads.join(good, "name", "left_semi"), one_task))
    a, b = _coords(F.col("a")), _coords(F.col("b"))
    return holes.where(geo.haversine(a[0], a[1], b[0], b[1]) > T.same_road)
