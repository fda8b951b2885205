"""Connected components over an edge table: contraction inside partitions, then stars that are shuffled while they shrink."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.storage import checkpoint, materialize, parts

MAX_ROUNDS = 60
#: Links that one task may contract at the end (16 bytes each); more take rounds of shuffles.
ONE_TASK = 1 << 20
#: Edges that a task holds before it replaces them by their forest.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find of all edges at once: (node, root) of every end, where root is the smallest node of its component.

    Roots hook to the smallest root next to them and paths are halved until they are flat.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        x, y = root[i], root[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def _contracted(batches, keep_roots: bool):
    """A spanning forest of a partition's edges as links node -> root; with ``keep_roots`` the roots link to themselves."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, held = [], 0
    for batch in batches:
        some.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        held += batch.num_rows
        if held >= HELD:
            a, b = forest(*(np.concatenate(c) for c in zip((a, b), *some, strict=True)))
            inner = a != b
            a, b, held, some = a[inner], b[inner], 0, []
            if len(a) >= HELD and not keep_roots:  # a forest that large goes on by itself
                yield from _rows(a, b)
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = forest(*(np.concatenate(c) for c in zip((a, b), *some, strict=True)))
    if not keep_roots:
        inner = a != b
        a, b = a[inner], b[inner]
    yield from _rows(a, b)


def _rows(a: np.ndarray, b: np.ndarray):
    for s in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[s : s + 100_000]), pa.array(b[s : s + 100_000])], names=["c", "p"])


def _contract(links: DataFrame) -> DataFrame:
    return links.mapInArrow(lambda batches: _contracted(batches, False), "c long, p long")


def _round(links: DataFrame) -> DataFrame:
    """One step of the links child -> parent (c, p, moved): parents of one child link to the smallest of them, links move up one level."""
    least = links.groupBy("c").agg(F.min("p").alias("m"))
    spread = links.join(least, "c").where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p"), F.lit(1).alias("moved"))
    star = least.select("c", F.col("m").alias("p"), F.lit(0).alias("moved")).unionByName(spread)
    star = star.groupBy("c", "p").agg(F.max("moved").alias("moved"))
    up = star.groupBy(F.col("c").alias("p")).agg(F.min("p").alias("q"))
    jumped = star.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.greatest("moved", F.col("q").isNotNull().cast("int")).alias("moved"))
    return jumped.groupBy("c", "p").agg(F.max("moved").alias("moved"))


def _placed(links: DataFrame, n: int, one_task: int) -> DataFrame:
    """Components of links whose numbers follow places: contracted by ranges, so that only groups that cross a range's border take part in rounds."""
    near = links.repartitionByRange(n, "p").mapInArrow(lambda batches: _contracted(batches, True), "node long, root long")
    near = materialize(near.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "near-links")
    across = near.where(F.size("roots") > 1).select("root", F.explode("roots").alias("other")).where("root <> other").distinct()
    far = connected_components(across, "root", "other", one_task).withColumnRenamed("node", "root")
    return near.select("node", "root").join(far, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK, placed: bool = False) -> DataFrame:
    """(node long, component) for every node of an edge (whole numbers); component is the smallest node of the group.

    1. Every partition replaces its edges by a spanning forest (union-find): only that is shuffled.
    2. As long as more than ``one_task`` links are left: every child keeps its smallest parent m, its other parents
       link to m, and every link moves up one level. Components whose links all stood still are done and leave, so
       the rounds shuffle less and less. The minimum is pre-aggregated before its shuffle, and joins have a unique
       right side, so a hub is only ever on the side that can be split.
    3. What is left, ``one_task`` links at most, is contracted by one task.

    With ``placed`` the numbers follow places (node keys) and the edges are a stored table: see ``_placed``.

    Lineage is cut by a reliable checkpoint each round. Null ends and self-loops are dropped; an
    empty edge table gives an empty result.
    """
    links = edges.select(F.greatest(a, b).cast("long").alias("c"), F.least(a, b).cast("long").alias("p")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    if placed and links.count() > one_task:
        return _placed(links, parts(links), one_task)
    links, done = checkpoint(_contract(links)), None
    for _ in range(MAX_ROUNDS):
        if links.count() <= one_task:
            break
        state = checkpoint(_round(links))
        # a parent is done if none of its links moved and none of its children has another parent
        several = state.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
        still = state.join(several, "c", "left").groupBy("p").agg(F.max(F.greatest("moved", F.col("n").isNotNull().cast("int"))).alias("any"))
        split = checkpoint(state.select("c", "p").join(still, "p"))
        stars = split.where("any = 0").select("c", "p")
        done = stars if done is None else done.unionByName(stars)
        links = split.where("any = 1").select("c", "p")
    else:
        raise RuntimeError("connected components did not settle")
    out = links.coalesce(1).mapInArrow(lambda batches: _contracted(batches, True), "node long, component long")
    if done is None:
        return out
    roots = done.select(F.col("p").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return out.unionByName(done.select(F.col("c").alias("node"), F.col("p").alias("component"))).unionByName(roots)
