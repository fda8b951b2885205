"""Topology cleaning: dead ends that almost touch an edge are joined to it, chains of edges become one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions import geo
from lowstress.functions.tags import lookup
from lowstress.lookups import FACILITY_RANK, Thresholds
from lowstress.operators.network import _coords, components
from lowstress.storage import checkpoint, parts

T = Thresholds()
MAX_ROUNDS = 200


def _located(edges: DataFrame) -> DataFrame:
    (la, lo), (lb, lb2) = _coords(F.col("a")), _coords(F.col("b"))
    return edges.select("*", la.alias("alat"), lo.alias("alon"), lb.alias("blat"), lb2.alias("blon"))


def _dead_ends(edges: DataFrame) -> DataFrame:
    """(node, near): the nodes that one edge leads to, and its other end."""
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    met = edges.select(F.explode(both).alias("x")).groupBy("x.node").agg(F.count("*").alias("d"), F.min("x.near").alias("near"))
    return met.where("d = 1").select("node", "near")


def _in_reach(ends: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """(node, a, b, dist, t) of dead ends and edges, not their own, whose inside is within reach. Only keys meet in the cells."""
    size = tolerance / geo.DEGREE_M
    lat, lon = _coords(F.col("node"))
    around = F.array(*[F.struct((geo.cell(lat, size) + i).alias("r"), (geo.cell(lon, size) + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = ends.select("node", F.explode(around).alias("k")).select("node", "k.r", "k.c").hint("merge")
    cells = _located(edges.select("a", "b")).withColumn("k", F.explode(geo.segment_cells(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"), size))).select("a", "b", "k.r", "k.c")
    hit = _located(at.join(cells, ["r", "c"]).where("node <> a and node <> b").select("node", "a", "b"))
    hit = hit.withColumn("p", geo.point_segment(lat, lon, F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    hit = hit.where(F.col("p.dist").between(0, tolerance) & F.col("p.t").between(0.05, 0.95))
    return hit.select("node", "a", "b", F.col("p.dist").alias("dist"), F.col("p.t").alias("t")).distinct()


def _nearest_edges(hits: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each dead end the nearest edge in reach that is not its neighbour's."""
    rn = F.row_number().over(Window.partitionBy("node").orderBy("dist", "a", "b"))
    return hits.join(ends, "node").where("near <> a and near <> b").withColumn("rn", rn).where("rn = 1").drop("rn", "near")


def snap_candidates(edges: DataFrame, tolerance: float = T.edge_snap) -> DataFrame:
    """(node, a, b, dist, t): each dead end and the nearest edge, not its own or a neighbour's, whose inside is within reach."""
    ends = _dead_ends(edges)
    return _nearest_edges(_in_reach(ends, edges, tolerance), ends)


def snap_dead_ends(edges: DataFrame, tolerance: float = T.edge_snap) -> DataFrame:
    """Rounds of at most one snap per edge (the smallest dead end): the edge is split at the dead end, until nothing is in reach.

    Edges are one for each two nodes. The whole network is looked at once; a round reads what is in reach of dead ends, and
    looks for dead ends near the halves that the one before has made, since nothing else can have changed.
    """
    edges = checkpoint(edges)
    ends = checkpoint(_dead_ends(edges))
    own = edges.select("a", "b", "way_id", "facility", "length_m")
    hits = checkpoint(_in_reach(ends, edges, tolerance).join(own, ["a", "b"]))
    halved, halves = None, None  # edges that were split, and what is left of them
    for _ in range(MAX_ROUNDS):
        first = F.row_number().over(Window.partitionBy("a", "b").orderBy("node"))
        snaps = checkpoint(_nearest_edges(hits, ends).withColumn("f", first).where("f = 1").drop("f"))
        if snaps.isEmpty():
            return edges if halves is None else own.join(halved, ["a", "b"], "left_anti").unionByName(halves)
        half = lambda end, share: F.struct(F.least(F.col(end), F.col("node")).alias("a"), F.greatest(F.col(end), F.col("node")).alias("b"), (F.col("length_m") * share).alias("length_m"))
        out = snaps.withColumn("e", F.explode(F.array(half("a", F.col("t")), half("b", 1 - F.col("t"))))).select("e.a", "e.b", "way_id", "facility", "e.length_m")
        # two dead ends that split each other's edges make the same half
        best = F.min_by(F.struct("way_id", "facility", "length_m"), F.struct("way_id", "length_m"))
        new = checkpoint(out.groupBy("a", "b").agg(best.alias("e")).select("a", "b", "e.*"))
        split, snapped = snaps.select("a", "b"), snaps.select("node")
        halved = split if halved is None else halved.unionByName(split)
        halves = new if halves is None else checkpoint(halves.join(split, ["a", "b"], "left_anti").unionByName(new))
        # a dead end whose own edge was split has another neighbour
        moved = snaps.select(F.col("node").alias("by"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x"))
        moved = moved.select("by", "x.node", "x.near")
        ends = ends.join(snapped, "node", "left_anti").join(moved, ["node", "near"], "left")
        ends = checkpoint(ends.select("node", F.coalesce("by", "near").alias("near")))
        left = hits.join(snapped, "node", "left_anti").join(split, ["a", "b"], "left_anti")
        hits = checkpoint(left.unionByName(_in_reach(ends, new, tolerance).join(new, ["a", "b"])))
    raise RuntimeError(f"dead ends were still being snapped after {MAX_ROUNDS} rounds")


def _flagged(e: DataFrame, inner: DataFrame) -> DataFrame:
    """Edges with _a and _b: whether their ends are inner nodes (null: not)."""
    at = lambda end: inner.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}"))
    return e.join(at("a"), "a", "left").join(at("b"), "b", "left")


def _grouped(flagged: DataFrame) -> DataFrame:
    """The edges (a stored table) with an inner end, with _c, the chain that they belong to: edges that meet in an inner node are one chain, named by its smallest inner node.

    Inner nodes are grouped, not edges: their keys follow places.
    """
    comp = components(flagged.where("_a and _b").select("a", "b"))
    own = flagged.where("_a or _b").withColumn("node", F.when(F.col("_a"), F.col("a")).otherwise(F.col("b")))
    return own.join(comp, "node", "left").withColumn("_c", F.coalesce("component", "node")).drop("node", "component")


def _to_cut(chains: DataFrame, single: DataFrame) -> DataFrame:
    """(_c, keep): chains some of whose inner nodes must stay, and how many: three of a ring, two of a ring with one outer node, and one of a
    chain whose outer nodes an edge or a shorter chain joins already."""
    outer = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)) for c in ("a", "b")}
    spans = chains.groupBy("_c").agg(
        F.min(F.least(outer["a"], outer["b"])).alias("a"), F.max(F.greatest(outer["a"], outer["b"])).alias("b"), F.count("*").alias("size"), F.min("eid").alias("g"),
    )
    spans = checkpoint(spans)
    again = F.row_number().over(Window.partitionBy("a", "b").orderBy("size", "g"))
    open_ = spans.where("a <> b")
    beside = single.join(open_.select("a", "b"), ["a", "b"], "left_semi").select(F.lit(None).cast("long").alias("_c"), "a", "b", F.lit(1).cast("long").alias("size"), F.col("eid").alias("g"))
    twice = open_.unionByName(beside).withColumn("again", again).where("again > 1 and _c is not null").select("_c", F.lit(1).alias("keep"))
    return twice.unionByName(spans.where("a is null or a = b").select("_c", F.when(F.col("a").isNull(), 3).otherwise(2).alias("keep")))


def _walked(batches):
    """The row of each chain; a part holds whole chains, none of them a ring."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    table = table.take(pa.array(np.argsort(table["_c"].to_numpy(), kind="stable")))
    c = table["_c"].to_numpy()
    cuts = [*np.flatnonzero(np.r_[True, c[1:] != c[:-1]]).tolist(), len(c)] if len(c) else [0]
    a, b, inner_a, inner_b, way, facility, length = (table[x].to_pylist() for x in ("a", "b", "_a", "_b", "way_id", "facility", "length_m"))
    kinds = [pa.int64(), pa.int64(), pa.list_(table["way_id"].type), pa.string(), pa.float64(), pa.list_(pa.int64())]
    rows = []

    def batch():
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["a", "b", "way_ids", "facility", "length_m", "path"])

    for i, j in zip(cuts, cuts[1:], strict=False):
        met: dict[int, list[int]] = {}
        outer = []
        for k in range(i, j):
            for node, inner in ((a[k], inner_a[k]), (b[k], inner_b[k])):
                if inner:
                    met.setdefault(node, []).append(k)
                else:
                    outer.append((node, k))
        node, k = min(outer)
        path, total = [node], 0.0
        ways: dict = {}
        while k is not None:
            ways.setdefault(way[k])
            total += length[k]
            node = b[k] if a[k] == node else a[k]
            path.append(node)
            k = next((x for x in met.get(node, ()) if x != k), None)
        rows.append((path[0], path[-1], list(ways), next(f for f in facility[i:j] if f is not None), total, path))
        if len(rows) == 10_000:
            yield batch()
            rows = []
    yield batch()


def dissolve(edges: DataFrame) -> DataFrame:
    """Chains through nodes of degree 2 with one facility become one edge: (a, b, way_ids, facility, length_m, path).

    Lengths are added; way ids and ``path``, all nodes from a to b, stand in their order along the chain. Chains never make a
    loop or a second edge between two nodes: a ring keeps three nodes, a ring with one outer node two more, and a chain
    beside an edge (or beside a chain with fewer edges) one, in each case those with the smallest keys.

    A chain is a row of the result, so a task holds it whole; it walks the chains that it was dealt.
    """
    e = checkpoint(edges.withColumn("eid", F.xxhash64("a", "b", F.lit(3))))
    ends = e.select("eid", "facility", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("d"), F.min("facility").alias("f1"), F.max("facility").alias("f2"), F.min("eid").alias("e1"), F.max("eid").alias("e2")).where("d = 2 and f1 = f2 and e1 <> e2").select("node")
    flagged = checkpoint(_flagged(e, inner))
    single = flagged.where("_a is null and _b is null")
    chains = checkpoint(_grouped(flagged))
    cut = checkpoint(_to_cut(chains, single))
    if not cut.isEmpty():
        # only chains that keep a node are grouped again
        touched = checkpoint(chains.join(cut, "_c"))
        inside = touched.select("_c", "keep", F.explode(F.array(F.when(F.col("_a"), F.col("a")), F.when(F.col("_b"), F.col("b")))).alias("node")).where("node is not null").distinct()
        kept = inside.withColumn("rn", F.row_number().over(Window.partitionBy("_c").orderBy("node"))).where("rn <= keep").select("node")
        left = checkpoint(inside.select("node").join(kept, "node", "left_anti"))
        flagged = checkpoint(_flagged(touched.drop("_a", "_b", "_c", "keep"), left))
        single = single.unionByName(flagged.where("_a is null and _b is null"))
        chains = checkpoint(chains.join(cut, "_c", "left_anti").unionByName(_grouped(flagged)))
    way = dict(edges.dtypes)["way_id"]
    dealt = chains.select("_c", "a", "b", "_a", "_b", "way_id", "facility", "length_m").repartition(parts(chains), "_c")
    merged = dealt.mapInArrow(_walked, f"a long, b long, way_ids array<{way}>, facility string, length_m double, path array<long>")
    return merged.unionByName(single.select("a", "b", F.array("way_id").alias("way_ids"), "facility", "length_m", F.array("a", "b").alias("path")))


def clean_topology(edges: DataFrame, tolerance: float = T.edge_snap) -> DataFrame:
    return dissolve(snap_dead_ends(edges, tolerance))


def clean_counts(edges: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: nodes, edges and components before and after cleaning."""
    count = lambda e, suffix: components(e).agg(F.count("*").alias(f"nodes_{suffix}"), F.count_distinct("component").alias(f"components_{suffix}")).crossJoin(e.agg(F.count("*").alias(f"edges_{suffix}")))
    return count(edges, "before").crossJoin(count(cleaned, "after"))  # one row each


def incident_facility(edges: DataFrame) -> DataFrame:
    """(node, facility): the facility of the highest rank that meets in each node; of equal ranks protected tracks and cycle lanes before shared ones."""
    both = edges.select(F.explode(F.array("a", "b")).alias("node"), "facility")
    return both.groupBy("node").agg(F.max_by("facility", F.struct(lookup(F.col("facility"), FACILITY_RANK, 0), F.col("facility") < "q", F.col("facility"))).alias("facility"))
