"""Shortest paths, cell by cell, and betweenness, by blocks of sources."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowstress.graph.cells import CELL_NODES, bounded_cells
from lowstress.graph.components import connected_components
from lowstress.storage import checkpoint, materialize, small_batches

#: Query pairs that one task answers at once within a cell; those of a busy cell are dealt over several tasks.
PAIRS_PER_TASK = 128
#: Rows (a cell with some of its queries) that a Python worker holds at once.
ROWS = 16
#: Sources that one task takes for betweenness.
SOURCES_PER_TASK = 256
MAX_ROUNDS = 10_000

_LABEL = "pair_id long, target long, t_cell long, node long, cell long, dist double, is_end boolean, chain array<long>, via array<long>"


def _adjacency(links: list[dict]) -> dict[int, list[tuple[int, int, float]]]:
    """u -> (v, cell of v, weight), smaller v first."""
    out: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    for x in links:
        out[x["u"]].append((x["v"], x["v_cell"], x["w"]))
    for v in out.values():
        v.sort()
    return out


def settle(graph: dict[int, list[tuple[int, int, float]]], cell: int, entries: list[tuple[int, float]], most: float, targets: set[int] | None = None):
    """Dijkstra inside one cell from several entries (node, distance so far) at once, up to the distance ``most``.

    Returns (distances, the entry that each node was reached from, predecessors, exits); an exit v, in another cell, has
    (distance, u) of the best link u -> v. Ends early once all ``targets`` are settled. Ties go to the smaller node.
    """
    seen: dict[int, float] = {}
    origin, prev, done = {}, {}, {}
    heap = []
    for i, (v, d) in enumerate(entries):
        if d < seen.get(v, float("inf")):
            seen[v], origin[v] = d, i
            heap.append((d, v))
    heapq.heapify(heap)
    exits: dict[int, tuple[float, int]] = {}
    left = None if targets is None else set(targets)
    while heap:
        d, u = heapq.heappop(heap)
        if d >= most:
            break
        if u in done:
            continue
        done[u] = d
        if left is not None:
            left.discard(u)
            if not left:
                break
        for v, v_cell, w in graph.get(u, ()):
            n = d + w
            if n >= most:
                continue
            if v_cell != cell:
                if v not in exits or n < exits[v][0]:
                    exits[v] = (n, u)
            elif v not in done and n < seen.get(v, float("inf")):
                seen[v], prev[v], origin[v] = n, u, origin[u]
                heapq.heappush(heap, (n, v))
    return done, origin, prev, exits


def _expand(batches):
    """Labels that leave a cell, or reach their target in it, from the labels that came into it."""
    key, graph = None, {}
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            cell = batch.column(0)[row].as_py()
            if cell != key:
                key, graph = cell, _adjacency(batch.column(2)[row].as_py())
            for q in batch.column(1)[row].as_py():
                came = sorted(q["labels"], key=lambda x: (x["dist"], x["node"], x["chain"]))
                most = float("inf") if q["best"] is None else q["best"]
                here = {q["target"]} if q["t_cell"] == cell else None
                done, origin, _, exits = settle(graph, cell, [(x["node"], x["dist"]) for x in came], most)
                head = (q["pair_id"], q["target"], q["t_cell"])
                if here and q["target"] in done:
                    t = q["target"]
                    most = done[t]
                    x = came[origin[t]]
                    out.append((*head, t, cell, done[t], True, [*x["chain"], t], [*x["via"], cell]))
                for v, (d, u) in exits.items():
                    if d < most:
                        x = came[origin[u]]
                        out.append((*head, v, None, d, False, [*x["chain"], u, v], [*x["via"], cell]))
        cols = list(zip(*out, strict=True)) or [[]] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pair_id", "target", "t_cell", "node", "cell", "dist", "is_end", "chain", "via"])


def _unfold(batches):
    """The nodes between both ends of every leg, by its cell's links."""
    key, graph = None, {}
    for batch in batches:
        for row in range(batch.num_rows):
            cell = batch.column(0)[row].as_py()
            if cell != key:
                key, graph = cell, _adjacency(batch.column(2)[row].as_py())
            out, wanted = [], defaultdict(list)
            for leg in batch.column(1)[row].as_py():
                wanted[leg["x"], leg["start"]].append(leg)
            for (x, start), legs in wanted.items():
                _, _, prev, _ = settle(graph, cell, [(x, start)], float("inf"), {leg["y"] for leg in legs})
                for leg in legs:
                    path = [leg["y"]]
                    while path[-1] != x:
                        path.append(prev[path[-1]])
                    out.append((leg["pair_id"], leg["leg"], path[::-1]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["pair_id", "leg", "path"])


def _dealt(rows: DataFrame, what: list[str], graph: DataFrame) -> DataFrame:
    """(cell, asks, links): the rows of each cell in shares of about PAIRS_PER_TASK, each with the cell's links."""
    shares = rows.groupBy("cell").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("shares"))
    dealt = rows.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("pair_id"), "shares").cast("int"))
    return dealt.groupBy("cell", "share").agg(F.collect_list(F.struct(*what)).alias("asks")).join(graph, "cell").select("cell", "asks", "links")


def shortest_paths(edges: DataFrame, pairs: DataFrame, weight: str = "length_m", comp: DataFrame | None = None, cell_nodes: int = CELL_NODES) -> DataFrame:
    """(pair_id, cost, path array<long>) of pairs (pair_id, source, target) whose ends are connected; weights are not negative.

    The network is cut into cells of ``cell_nodes`` nodes; a task holds one cell and some of the queries in it. A query
    starts with a label at its source. In each round, every cell that new labels came into is searched from all of a
    query's labels at once, and links that leave the cell carry labels to the next ones; a label lives only while it is
    the best for its node and below the best path found so far, so the search spreads around both ends and
    stops when no label is left that could shorten a path. That is exact; rounds grow with the cells that a path
    crosses. A label remembers where it entered and left cells; the nodes between are filled in at the end.

    Edges without a (finite) weight are not used. Pairs of different components have no row, and only components that hold a pair are read. Equal ends have a
    path of one node and cost 0. Of several shortest paths the one that ties settle (smaller nodes) is returned.
    """
    spark = edges.sparkSession
    comp = connected_components(edges) if comp is None else comp
    p = pairs.join(comp.select(F.col("node").alias("source"), "component"), "source").join(comp.select(F.col("node").alias("target"), F.col("component").alias("_c")), "target").where("component = _c")
    p = checkpoint(p.select("pair_id", "source", "target", "component"))
    inside = comp.join(p.select("component").distinct(), "component", "left_semi")
    cells = checkpoint(bounded_cells(inside, cell_nodes))
    e = edges.select("a", "b", F.col(weight).cast("double").alias("w")).where((F.col("a") != F.col("b")) & (F.col("w") < float("inf")))
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    at = lambda end: cells.select(F.col("node").alias(end), F.col("cell").alias(f"{end}_cell"))
    links = both.join(at("u"), "u").join(at("v"), "v").groupBy(F.col("u_cell").alias("cell")).agg(F.collect_list(F.struct("u", "v", "v_cell", "w")).alias("links"))
    graph = materialize(links, "cell-links")

    # labels: the best way to a node at which a query entered a cell (is_end: to its target)
    state = p.join(cells.withColumnRenamed("node", "source"), "source").join(cells.select(F.col("node").alias("target"), F.col("cell").alias("t_cell")), "target")
    state = state.select("pair_id", "target", "t_cell", F.col("source").alias("node"), "cell", F.lit(0.0).alias("dist"), F.lit(False).alias("is_end"), F.array("source").alias("chain"), F.array().cast("array<long>").alias("via"), F.lit(True).alias("fresh"), F.lit(None).cast("double").alias("best"))
    for _ in range(MAX_ROUNDS):
        came = state.where("fresh").groupBy("cell", "pair_id").agg(F.first("target").alias("target"), F.first("t_cell").alias("t_cell"), F.first("best").alias("best"), F.collect_list(F.struct("node", "dist", "chain", "via")).alias("labels"))
        new = _dealt(came, ["pair_id", "target", "t_cell", "best", "labels"], graph).mapInArrow(_expand, _LABEL)
        known = state.select("pair_id", "target", "t_cell", "node", "cell", "dist", "is_end", "chain", "via", F.col("dist").alias("old"))
        every = known.unionByName(new.withColumn("old", F.lit(None).cast("double"))).repartition("pair_id")
        least = every.groupBy("pair_id", "node", "is_end").agg(F.first("target").alias("target"), F.first("t_cell").alias("t_cell"), F.max("cell").alias("cell"), F.min(F.struct("dist", "chain", "via")).alias("m"), F.min("old").alias("old"))
        best = F.min(F.when(F.col("is_end"), F.col("m.dist"))).over(Window.partitionBy("pair_id"))
        least = least.withColumn("best", best).where(F.col("is_end") | F.col("best").isNull() | (F.col("m.dist") < F.col("best")))
        least = least.select("pair_id", "target", "t_cell", "node", F.col("cell").alias("old_cell"), "m.dist", "is_end", "m.chain", "m.via", (~F.col("is_end") & (F.col("old").isNull() | (F.col("m.dist") < F.col("old")))).alias("fresh"), "best")
        with small_batches(spark, ROWS):
            state = checkpoint(least.join(cells, "node").drop("old_cell"))
        if state.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError("shortest paths did not settle")

    ends = state.where("is_end").select("pair_id", F.col("dist").alias("cost"), "chain", "via")
    # the chain holds the two ends of the leg in each cell, one leg after another
    legs = ends.select("pair_id", "chain", F.posexplode("via").alias("leg", "cell"))
    legs = legs.select("pair_id", "leg", "cell", F.get("chain", F.col("leg") * 2).alias("x"), F.get("chain", F.col("leg") * 2 + 1).alias("y"))
    legs = legs.withColumn("start", F.lit(0.0))
    pieces = _dealt(legs, ["pair_id", "leg", "x", "y", "start"], graph).mapInArrow(_unfold, "pair_id long, leg int, path array<long>")
    with small_batches(spark, ROWS):
        pieces = checkpoint(pieces)
    paths = pieces.groupBy("pair_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("leg", "path"))), lambda s: s["path"])).alias("path"))
    return ends.select("pair_id", "cost").join(paths, "pair_id")


#: Edges of one packed piece of an adjacency.
PIECE = 1 << 16


def _dependencies(graph: dict[int, list[tuple[int, float]]], s: int, score: dict[int, float]) -> None:
    """Adds to ``score`` what the shortest paths from ``s`` owe to each node between (Brandes)."""
    sigma: dict[int, float] = {s: 1.0}
    seen, preds, order, done = {s: 0.0}, {s: []}, [], set()
    heap = [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in graph.get(u, ()):
            n = d + w
            if v not in seen or n < seen[v]:
                seen[v], sigma[v], preds[v] = n, sigma[u], [u]
                heapq.heappush(heap, (n, v))
            elif n == seen[v] and v not in done:
                sigma[v] += sigma[u]
                preds[v].append(u)
    share = dict.fromkeys(order, 0.0)
    for u in reversed(order):
        for v in preds[u]:
            share[v] += sigma[v] / sigma[u] * (1 + share[u])
        if u != s:
            score[u] += share[u]


def betweenness(edges: DataFrame, weight: str = "length_m", sources: int = SOURCES_PER_TASK) -> DataFrame:
    """(node, centrality): weighted betweenness of every node of an edge, scaled by the pairs of the whole graph.

    The sources of a component are dealt over tasks, ``sources`` to each; every task gets the component's edges as packed
    pieces (24 bytes an edge; it needs them all, as paths may lead anywhere) and returns what its own sources
    owe to each node; those parts are added up by a shuffle. Weights are positive; parallel edges count once each.
    """
    comp = checkpoint(connected_components(edges))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / sources).cast("int").alias("shares"))
    e = edges.select("a", "b", F.col(weight).cast("double").alias("w")).where("a <> b").join(comp.select(F.col("node").alias("a"), "component"), "a")
    pieces = e.groupBy("component").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    cut = e.join(pieces, "component").withColumn("piece", F.pmod(F.xxhash64("a", "b"), "pieces").cast("int"))

    def pack(key, table):
        body = [np.ascontiguousarray(table[c].to_numpy()).tobytes() for c in ("a", "b", "w")]
        return pa.table({"component": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip("abw", body, strict=True)}})

    packed = cut.groupBy("component", "piece").applyInArrow(pack, "component long, a binary, b binary, w binary")
    spread = packed.join(sizes, "component").select(F.col("component").alias("e_component"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("e_share"), "a", "b", "w")
    asked = comp.join(sizes, "component").select("component", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), "node")

    def central(key, nodes, links):
        graph: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for a, b, w in zip(*(links[c].to_pylist() for c in "abw"), strict=True):
            for x, y, z in zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist(), np.frombuffer(w, np.float64).tolist(), strict=True):
                graph[x].append((y, z))
                graph[y].append((x, z))
        score: dict[int, float] = defaultdict(float)
        for s in nodes["node"].to_pylist():
            score[s] += 0.0
            _dependencies(graph, s, score)
        return pa.table([pa.array(list(score), pa.int64()), pa.array(list(score.values()), pa.float64())], names=["node", "raw"])

    parts = asked.groupBy("component", "share").cogroup(spread.groupBy("e_component", "e_share")).applyInArrow(central, "node long, raw double")
    n = comp.agg(F.count("*").alias("n"))
    out = parts.groupBy("node").agg((F.sum("raw") / 2).alias("raw")).join(F.broadcast(n))  # one number
    pairs = (F.col("n") - 1) * (F.col("n") - 2) / 2
    return out.select("node", F.when(F.col("n") > 2, F.col("raw") / pairs).otherwise(0.0).alias("centrality"))
