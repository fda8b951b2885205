"""The result of a greedy pass (best first; whoever conflicts with a better one that stays, goes) without passing through one row after another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.storage import checkpoint

#: Conflicts that one task may settle at the end; more are settled tile by tile first.
ONE_TASK = 1 << 20
MAX_ROUNDS = 10_000


def _settled(hi: np.ndarray, lo: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, stays) of all that can be told here. ``known`` of each conflict: hi stays (1), hi is decided elsewhere and not told yet (0), hi is one of this tile (2)."""
    order = np.argsort(lo, kind="stable")
    stays: dict[int, int] = {}  # 1: stays, -1: goes, 0: not told
    mine = dict.fromkeys(lo.tolist(), 0)
    node, told = None, 1
    for l, h, k in zip(lo[order].tolist(), hi[order].tolist(), known[order].tolist(), strict=True):
        if l != node:
            if node is not None:
                stays[node] = told
            node, told = l, 1
        s = stays[h] if k == 2 and h in mine else 1 if k else 0
        if s == 1:
            told = -1
        elif s == 0 and told == 1:
            told = 0
    if node is not None:
        stays[node] = told
    out = [(l, s == 1) for l, s in stays.items() if s]
    return np.array([l for l, _ in out], np.int64), np.array([s for _, s in out], bool)


def greedily_dropped(pairs: DataFrame, tiles: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node) of those that a greedy pass drops, given conflicts (hi, lo), hi < lo (the better comes first), and tiles (node, tile).

    Each round, every tile decides in order all of its nodes whose better partners are in the tile or decided already; what
    depends on another tile waits for it. So rounds grow with the tiles that a chain of decisions crosses, not with its
    length. Once ``one_task`` conflicts or fewer are open, one task settles them. That is the sequential result, whatever the
    tiles and partitions.
    """
    at = lambda end: tiles.select(F.col("node").alias(end), F.col("tile").alias(f"{end}_tile"))
    left = pairs.join(at("hi"), "hi").join(at("lo"), "lo")
    left = checkpoint(left.select("hi", "lo", F.col("lo_tile").alias("tile"), (F.col("hi_tile") == F.col("lo_tile")).alias("same")))

    def settle(table: pa.Table) -> pa.Table:
        lo, stays = _settled(*(table[c].to_numpy() for c in ("hi", "lo", "known")))
        return pa.table([pa.array(lo, pa.int64()), pa.array(stays, pa.bool_())], names=["node", "stays"])

    def settle_all(batches):
        rows = [[np.zeros(0, np.int64)] for _ in range(2)]
        for batch in batches:
            for r, c in zip(rows, ("hi", "lo"), strict=True):
                r.append(batch.column(batch.schema.get_field_index(c)).to_numpy())
        hi, lo = (np.concatenate(r) for r in rows)
        lo, stays = _settled(hi, lo, np.full(len(lo), 2))  # all that is open is here
        yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(stays, pa.bool_())], names=["node", "stays"])

    dropped = None
    for _ in range(MAX_ROUNDS):
        last = left.count() <= one_task
        # a node without a better partner that is still open stays
        worse = left.select(F.col("lo").alias("hi"), F.lit(True).alias("open")).distinct()
        asked = left.join(worse, "hi", "left").withColumn("known", F.when(F.col("open").isNull(), 1).when(F.col("same"), 2).otherwise(0))
        if last:
            told = left.select("hi", "lo").coalesce(1).mapInArrow(settle_all, "node long, stays boolean")
        else:
            told = checkpoint(asked.select("hi", "lo", "tile", "known").groupBy("tile").applyInArrow(settle, "node long, stays boolean"))
        gone = told.where("not stays").select("node")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        if last:
            return dropped
        left = checkpoint(left.join(told.select(F.col("node").alias("lo")), "lo", "left_anti").join(gone.withColumnRenamed("node", "hi"), "hi", "left_anti").select("hi", "lo", "tile", "same"))
    raise RuntimeError("the greedy pass did not settle")
