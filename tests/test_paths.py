"""Kernels against tiny brute-force versions."""

import itertools
import math
import random

import numpy as np
import pytest

from lowstress.graph.chains import chain_order, joints_of
from lowstress.graph.components import connected_components
from lowstress.graph.greedy import greedily_dropped
from lowstress.graph.paths import betweenness, shortest_paths
from lowstress.lookups import Thresholds
from lowstress.operators import corridor, refine


def _graph(seed, n=18, m=24):
    rnd = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = sorted(rnd.sample(range(n), 2))
        edges[a, b] = rnd.randint(1, 1000) / 7
    return edges


def _all_pairs(edges, n):
    d = {(i, j): 0.0 if i == j else float("inf") for i in range(n) for j in range(n)}
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


@pytest.mark.parametrize("cell_nodes", [4096, 5, 1])
def test_shortest_paths_equal_floyd_warshall(spark, cell_nodes):
    edges = _graph(1, m=22)
    d = _all_pairs(edges, 18)
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, length_m double")
    pairs = [(i, s, t) for i, (s, t) in enumerate(itertools.combinations_with_replacement(range(18), 2)) if any(s in x for x in edges) and any(t in x for x in edges)]
    got = {r.pair_id: r for r in shortest_paths(e, spark.createDataFrame(pairs, "pair_id long, source long, target long"), cell_nodes=cell_nodes).collect()}
    for i, s, t in pairs:
        assert (i in got) == (d[s, t] < float("inf"))
        if i in got:
            assert abs(got[i].cost - d[s, t]) < 1e-9
            path = got[i].path
            assert path[0] == s and path[-1] == t
            assert abs(sum(edges[tuple(sorted(p))] for p in itertools.pairwise(path)) - d[s, t]) < 1e-9


@pytest.mark.parametrize("sources", [256, 3])
def test_betweenness_counts_paths_through_a_node(spark, sources):
    edges = _graph(3, n=10, m=13)
    d = _all_pairs(edges, 10)
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, length_m double")
    got = {r.node: r.centrality for r in betweenness(e, sources=sources).collect()}
    n = len(got)
    for v in got:
        through = sum(1 for s, t in itertools.combinations(got, 2) if v not in (s, t) and d[s, t] < float("inf") and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9)
        assert abs(got[v] - through / ((n - 1) * (n - 2) / 2)) < 1e-9


def test_components_of_nothing_and_of_a_chain(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_dedup_rounds_equal_the_greedy_pass(spark):
    from lowstress.fixtures import view

    gaps = view(spark, "/root/testdata/sf0.001", "fx_gaps")
    kept = {r.gap_id for r in refine.greedy_dedup(gaps).collect()}
    assert kept == {r.gap_id for r in refine.greedy_dedup(gaps, tile=40, one_task=10).collect()}
    rows = refine.dedup_order(gaps.withColumn("len_m", refine.gap_length())).orderBy("prio").collect()
    import math

    def hav(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 6371000 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    t, greedy = Thresholds(), []
    for g in rows:
        ends = [(g.start_lat, g.start_lon), (g.end_lat, g.end_lon)]
        mid = ((g.start_lat + g.end_lat) / 2, (g.start_lon + g.end_lon) / 2)
        clash = any(hav(*mid, *m) < t.dedup or any(hav(*p, *q) < t.endpoint_dedup for p in ends for q in es) for _, m, es in greedy)
        if not clash:
            greedy.append((g.gap_id, mid, ends))
    assert kept == {g for g, _, _ in greedy} and 1 < len(kept) < len(rows)


def test_components_by_rounds_equal_those_of_one_task(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]  # many groups
    edges += [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(120)] + [(2120, 1300)]  # a hub at the end of a chain
    edges += [(3000 + i, 3001 + i) for i in range(0, 100, 2)] + [(5, 5), (None, 7), (9, None)] + [(-4, 2), (2, -4)]
    want = {}
    for x, y in edges:
        if x is not None and y is not None and x != y:
            old, new = sorted((want.setdefault(x, {x}), want.setdefault(y, {y})), key=len)
            if old is not new:
                new |= old
                want.update(dict.fromkeys(old, new))
    want = {v: min(g) for v, g in want.items()}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for one_task in (1 << 20, 100, 0):
        assert {r.node: r.component for r in connected_components(df, one_task=one_task).collect()} == want


def test_greedy_pass_over_tiles_of_any_size(spark):
    rnd = random.Random(9)
    n = 120
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(260)} | {(i, i + 1) for i in range(n, n + 60)}  # the chain decides one after another
    gone = set()
    for lo in range(n + 61):
        if any(b == lo and a not in gone for a, b in pairs):
            gone.add(lo)
    df = spark.createDataFrame(sorted(pairs), "hi long, lo long").repartition(4)
    for size, one_task in ((10**6, 1 << 20), (25, 0), (1, 40), (10**6, 0)):
        tiles = spark.createDataFrame([(i, i // size if i >= n else i % (n // min(n, size))) for i in range(n + 61)], "node long, tile long")
        assert {r.node for r in greedily_dropped(df, tiles, one_task).collect()} == gone
    assert greedily_dropped(df.limit(0), tiles).count() == 0


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_chain_order_of_chains_forks_and_rings(spark, one_task):
    rnd = random.Random(11)
    lists = [[rnd.sample(range(1000 * k, 1000 * k + 999), n)] for k, n in enumerate((2, 3, 9, 40))]  # nodes of chains in any order
    pairs = [(p, q) for (c,) in lists for p, q in itertools.pairwise(c)]
    ring = [5000, 5003, 5001, 5002]
    pairs += list(zip(ring, ring[1:] + ring[:1], strict=True))
    pairs += [(6000, 6001), (6000, 6002), (6000, 6003), (6003, 6004), (6010, 6011), (6011, 6012), (6012, 6010), (6010, 6013)]  # a fork; a loop on a stem
    pairs = [tuple(p) if rnd.random() < 0.5 else p[::-1] for p in pairs]
    rnd.shuffle(pairs)
    edges = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "eid long, a long, b long").repartition(5)
    ends = edges.selectExpr("eid", "a as node", "0L as s").unionByName(edges.selectExpr("eid", "b as node", "1L as s"))
    got = {}
    for r in chain_order(edges, joints_of(ends, ["node"]), one_task).collect():
        assert {r.u, r.v} == set(pairs[r.eid])
        got.setdefault(r.chain, []).append((r.pos, r.u, r.v))
    walks = []
    for steps in got.values():
        steps.sort()
        assert [s[0] for s in steps] == list(range(len(steps))) and all(p[2] == q[1] for p, q in itertools.pairwise(steps))
        walks.append((steps[0][1], *(s[2] for s in steps)))
    want = [tuple(c if c[0] < c[-1] else c[::-1]) for (c,) in lists] + [(6000, 6001), (6000, 6002), (6000, 6003, 6004), (6010, 6013)]
    loop = [w for w in walks if w[0] == w[-1]]
    assert sorted(w for w in walks if w not in loop) == sorted(want) and len(loop) == 1 and set(loop[0]) == {6010, 6011, 6012}


def test_corridor_holes_lie_between_cycled_edges_of_one_chain(spark):
    spots = {i: (43.0, -80.0 + 0.002 * i) for i in range(8)} | {20: (43.002, -79.996), 21: (43.004, -79.996)}
    key = lambda n: int(math.floor(spots[n][0] * 1e5 + 0.5)) * 10**8 + int(math.floor(spots[n][1] * 1e5 + 0.5)) + 18 * 10**6
    # west to east: track, hole, lane, hole up to a fork, lane; a side street of the same name at the fork
    rows = [(0, 1, "track"), (1, 2, ""), (2, 3, "lane"), (3, 4, ""), (4, 5, ""), (5, 6, "lane"), (6, 7, "")]
    e = [(k, *sorted((key(a), key(b))), 163.0, "residential", "A", c, "") for k, (a, b, c) in enumerate(rows)]
    e += [(50, *sorted((key(4), key(20))), 220.0, "residential", "A", "", ""), (51, *sorted((key(20), key(21))), 220.0, "residential", "A", "", "track"), (60, key(0), key(7), 10.0, "residential", "", "track", "")]
    df = spark.createDataFrame(e, "way_id long, a long, b long, length_m double, highway string, name string, cycleway string, cycleway_left string")
    got = [(r.a, r.b, round(r.length_m), r.start_facility, r.end_facility) for r in corridor.corridor_gaps(df).collect()]
    # 3-4-5 is cut by the fork at 4, so only the first hole lies between cycled edges of one chain
    assert got == [(key(1), key(2), 163, "protected_track", "cycle_lane")] or got == [(key(2), key(1), 163, "cycle_lane", "protected_track")]
    no_fork = df.where("way_id < 50")
    assert sorted(round(r.length_m) for r in corridor.corridor_gaps(no_fork, one_task=0).collect()) == [163, 326]
    assert corridor.corridor_gaps(df.limit(0)).count() == 0


def test_components_by_ranges_of_placed_nodes(spark, tmp_path):
    """Groups that cross the borders of ranges come together again; only those take part in rounds."""
    from lowstress.graph.components import forest

    rng = random.Random(5)
    edges = [(i, i + rng.choice((1, 2, 7))) for i in range(0, 3000) if i % 10] + [(5, 2990), (10_000, 10_001)]
    spark.createDataFrame(edges, "a long, b long").repartition(4).write.parquet(str(tmp_path / "e"))
    got = {r["node"]: r["component"] for r in connected_components(spark.read.parquet(str(tmp_path / "e")), one_task=50, placed=True).collect()}
    nodes, roots = forest(*(np.array(x) for x in zip(*edges, strict=True)))
    assert got == dict(zip(nodes.tolist(), roots.tolist(), strict=True))


def test_large_forest_of_one_partition_goes_on_in_pieces(monkeypatch):
    """What a worker holds does not grow with its partition."""
    import pyarrow as pa

    from lowstress.graph import components as C

    monkeypatch.setattr(C, "HELD", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(s + 1, s + 51)), pa.array(range(s, s + 50))], names=["c", "p"]) for s in range(0, 1000, 50)]
    seen, out = [], []
    for b in C._contracted((seen.append(1) or x for x in batches), False):
        out.append((len(seen), b))
    assert out[0][0] < len(batches)
    a, b = (np.concatenate([x.column(i).to_numpy() for _, x in out]) for i in (0, 1))
    assert set(C.forest(a, b)[1].tolist()) == {0}


def test_network_edges_are_the_merged_edges(spark):
    from lowstress.fixtures import view
    from lowstress.operators import network as N

    d = "/root/testdata/sf0.001"
    w, v = view(spark, d, "fx_ways"), view(spark, d, "fx_vertices")
    key = lambda df: sorted(tuple(r) for r in df.select("a", "b", "way_id", "facility", "source").collect())
    once = N.network_edges(w, v)
    assert key(once) == key(N.merged_edges(N.cycling_edges(w, v), N.road_attribute_edges(w, v)))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1  # one pass over the vertices
    assert once.where("drawn").count() == N.cycling_edges(w, v).count() and once.where("along").count() == N.road_attribute_edges(w, v).count()


def test_spines_read_their_edges_once(spark):
    from pyspark.sql import functions as F

    from lowstress.operators import spines

    # a square of long protected edges; every row that is read for the centralities is counted
    at = [4_300_000_002_000_000 + i * 300_000_000_000 for i in range(4)]
    rows = [(at[i], at[(i + 1) % 4], "protected_track", 300.0 + i) for i in range(4)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    edges = spark.createDataFrame(rows, "a long, b long, facility string, length_m double").mapInArrow(count, "a long, b long, facility string, length_m double")
    roads = spark.createDataFrame([], "way_id long, name string, mid_lat double, mid_lon double")
    found = spines.detect_spines(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "facility", "length_m"), roads).collect()
    assert len(found) == 1 and found[0].n_nodes == 4 and abs(found[0].total_length_m - 1206) < 1e-6 and seen.value == 4
