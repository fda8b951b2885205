"""From blocking keys to groups: shared by the operators that link rows to rows.

1. ``packed_keys``: a batch's (key, node) pairs, dealt to buckets as packed arrays.
2. ``candidate_links``: nodes that share a key, as a star per key (never all pairs of a group).
3. connected components of those stars give candidate groups; ``verified_components`` checks the
   members of each against each other exactly, in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.graph.components import connected_components
from lowstress.llm.blocks import trim
from lowstress.llm.interpolated_lm import bucket_of, pack, unpack
from lowstress.storage import materialize

KEY_SCHEMA = "bucket int, keys binary, at binary, nodes binary"
#: Members of a candidate group that one task compares; larger groups are cut into tiles of this size.
TILE = 4096


def packed_keys(keys: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its keys in ascending order and, for each, the node it comes from."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        names, at = np.unique(nodes[part], return_inverse=True)
        kind = np.uint8 if len(names) <= 256 else np.uint16 if len(names) <= 65536 else np.uint32
        out.append((b, pack(keys[part]), bytes([np.dtype(kind).itemsize]) + at.astype(kind).tobytes(), names.tobytes()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "at", "nodes"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, a, n in zip(table["keys"], table["at"], table["nodes"], strict=True):
        at = a.as_py()
        keys.append(unpack(k.as_py()))
        nodes.append(np.frombuffer(n.as_py(), np.int64)[np.frombuffer(at, {1: np.uint8, 2: np.uint16, 4: np.uint32}[at[0]], -1, 1)])
    return np.concatenate(keys), np.concatenate(nodes)


def candidate_links(packed: DataFrame, near: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Distinct (a, b) with a < b: in each group of one key, every node linked to a chosen member.

    Without ``near`` that is the group's smallest node. With it, ``near(nodes)`` names for each member
    of a group (distinct nodes, ascending) the position of the member that stands for its part.
    """

    def links(table: pa.Table) -> pa.Table:
        keys, nodes = _unpacked(table)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[fresh], nodes[fresh]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        if near is None:
            hub = np.repeat(nodes[first], size) if len(keys) else nodes
        else:
            hub = nodes.copy()
            pairs = first[size == 2]
            if len(pairs):
                hub[pairs + 1] = np.where(near(np.stack([nodes[pairs], nodes[pairs + 1]], axis=1)), nodes[pairs], nodes[pairs + 1])
            for s, n in zip(first[size > 2], size[size > 2], strict=True):
                hub[s : s + n] = nodes[s : s + n][near(nodes[s : s + n])]
        real = hub != nodes
        edges = np.unique(np.stack([np.minimum(hub, nodes)[real], np.maximum(hub, nodes)[real]], axis=1), axis=0)
        del keys, hub, order
        trim()
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    return packed.groupBy("bucket").applyInArrow(links, "a long, b long").distinct()


class Forest:
    """Components of positions 0..n-1 with labels that are always up to date."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def link(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.links.append((i, j))


def verified_components(members: DataFrame, loaded: DataFrame, link: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]], name: str) -> DataFrame:
    """(node, component) of the nodes that have at least one verified link.

    ``members``: (node, cluster); ``loaded``: the same rows with what ``link`` reads. Each candidate
    group is given to ``link(table, side)`` whole, or, if it has more than TILE members, as pairs of
    tiles (side 0 and 1: compare across; one tile: all 0, compare within), so that a task never holds
    more than two tiles. ``link`` returns positions of verified pairs that connect what is connected.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = loaded.join(sizes, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    # a pair of tiles (x, y) with x <= y; a member of tile t takes part in (t, y) and (x, t)
    unit = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(F.least(o, F.col("tile")).alias("x"), F.greatest(o, F.col("tile")).alias("y"), (F.col("tile") > o).cast("int").alias("side")),
    )
    units = tiled.withColumn("u", F.explode(unit)).select(*loaded.columns, F.col("u.x").alias("x"), F.col("u.y").alias("y"), F.col("u.side").alias("side"))

    def check(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        pairs = np.array(link(table, table["side"].to_numpy()), np.int64).reshape(-1, 2)
        if len(table) > 256:
            trim()
        return pa.table({"a": pa.array(nodes[pairs[:, 0]]), "b": pa.array(nodes[pairs[:, 1]])})

    links = materialize(units.groupBy("cluster", "x", "y").applyInArrow(check, "a long, b long"), name)
    return connected_components(links)


__all__ = ["Forest", "KEY_SCHEMA", "TILE", "candidate_links", "packed_keys", "verified_components"]
