"""N-gram Jaccard join: exact links by set similarity, found with signature trees inside exact blocks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.graph.components import connected_components
from lowstress.llm.blocks import lean
from lowstress.llm import text as T
from lowstress.llm.clusters import KEY_SCHEMA, Forest, candidate_links, packed_keys, verified_components
from lowstress.storage import materialize

LEAF, FANOUT = 32, 6
BATCH = 512
_PREFIX_KEY = np.array([3], np.uint64)
_K = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


# --- exact blocking: two linked sets share a segment ------------------------------------------------


@functools.lru_cache(8)
def _bands(num: int, den: int) -> np.ndarray:
    """Lower ends of size bands: a set's partners are in its band or the next one up or down."""
    ends = [1, 2]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * den // num + 1))
    return np.array(ends)


def _plan(band: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs from a band and the next: segments m, spare equal segments s, and the poor count c.

    Sets A and B of such a pair that are linked differ in at most d elements, so of m = d + 1 + s
    segments (elements dealt by hash) at least s + 1 hold the same elements. Where d is 0, m is 0:
    only equal sets are linked.
    """
    b = _bands(num, den)
    d = (den - num) * (b[band + 1] + b[band + 2] - 2) // (den + num)
    s = np.maximum(1, d * 15 // 100)
    m = np.where(d > 0, d + 1 + s, 0)
    c = np.select([b[band] >= 4 * m, 2 * b[band] >= 5 * m], [2, 1], 0)
    return m, s, c


def blocking_keys(sets: np.ndarray, offs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions of the sets): two linked, unequal sets have at least one key in common."""
    return banded_keys(sets, offs, num, den)[:2]


def banded_keys(sets: np.ndarray, offs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions of the sets, bands): two linked, unequal sets have at least one key of one band in common.

    A segment with more than c elements gives a key. A set with more than s poorer segments gives keys
    for those too, and one with more than s empty segments gives its prefix (the smallest elements, of
    which linked sets share one): if a pair's equal segments are all poor (or empty), both sets do so.
    """
    n = np.diff(offs)
    keys, where, bands = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    band_of = np.searchsorted(_bands(num, den), n, "right") - 1
    mixed = T.mix(sets)
    owner = np.repeat(np.arange(len(n)), n)
    for down in (0, 1):
        band = band_of - down
        m, s, c = _plan(np.maximum(band, 0), num, den)
        m = np.where((n > 0) & (band >= 0), m, 0)
        start = np.cumsum(m) - m
        live = m[owner] > 0
        own, h = owner[live], sets[live]
        seg = start[own] + (h % np.maximum(m, 1).astype(np.uint64)[own]).astype(np.int64)
        total = int(m.sum())
        count = np.bincount(seg, minlength=total)
        value = np.zeros(total, np.uint64)
        np.add.at(value, seg, mixed[live])
        doc = np.repeat(np.arange(len(n)), m)
        number = (np.arange(total) - start[doc]).astype(np.uint64)
        poor = count <= c[doc]
        n_poor = np.bincount(doc, poor, len(n))
        bare = (np.bincount(doc, count == 0, len(n)) > s) & (m > 0)
        emit = ~poor | ((n_poor > s)[doc] & (count > 0))
        kind = np.where(poor, np.uint64(2), np.uint64(1)) * _K[3]
        key = T.mix(value * _K[0] + number * _K[1] + band[doc].astype(np.uint64) * _K[2] + kind)
        keys.append(key[emit])
        where.append(doc[emit])
        bands.append(band[doc[emit]])
        for i in np.flatnonzero(bare):
            k = int(n[i] - -(-int(n[i]) * num // den) + 1)
            keys.append(T.mix(sets[offs[i] : offs[i] + k] * _K[0] + np.uint64(band[i]) * _K[2] + _PREFIX_KEY))
            where.append(np.full(k, i))
            bands.append(np.full(k, band[i]))
    return np.concatenate(keys), np.concatenate(where), np.concatenate(bands)


def _in_band(node: np.ndarray, band: np.ndarray) -> np.ndarray:
    """64-bit names of sets among the pairs of one band: a set is in its own and the one below."""
    return T.to_i64(T.mix(T.mix(node.astype(np.uint64)) + band.astype(np.uint64) * _K[2]))


# --- the tree ---------------------------------------------------------------------------------------


class SignatureTree:
    """Sets in order of size; each node has the OR of its sets' token bitmaps and their size range."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        width = 1 << int(np.clip(2 * self.size.max(initial=1) - 1, 255, 65535)).bit_length()
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in zip(self.bits, sets, strict=True):
            at = (s >> np.uint64(17)) & np.uint64(width - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        #: elements beyond one per bit: the overlap of two sets is at most their common bits plus the smaller of these
        self.excess = self.size - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.levels: list[list[tuple]] = []

    def build(self, start: int, end: int) -> tuple:
        """(start, end, OR bitmap, smallest size, largest size, largest excess, children)."""
        if end - start <= LEAF:
            kids: list[tuple] = []
        else:
            step = LEAF
            while step * FANOUT < end - start:
                step *= FANOUT
            kids = [self.build(i, min(end, i + step)) for i in range(start, end, step)]
        union = np.bitwise_or.reduce(self.bits[start:end], axis=0) if not kids else np.bitwise_or.reduce([k[2] for k in kids])
        size = self.size[start:end]
        return start, end, union, int(size.min()), int(size.max()), int(self.excess[start:end].max()), kids


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Positions of linked pairs (den * overlap >= num * union) that connect all that is connected.

    Dual traversal of a signature tree. A pair of nodes is left out if sizes cannot match, if the most
    their bitmaps allow to overlap is too little, or if all their sets are in one component already.
    """
    order = np.lexsort((side, [len(s) for s in sets]))
    if len(sets) < 2:
        return []
    across = bool(side.any())
    side = side[order]
    tree = SignatureTree([sets[i] for i in order])
    forest = Forest(len(sets))
    root = tree.build(0, len(sets))
    stack = [(root, root)]
    while stack:
        p, q = stack.pop()
        if p[4] * den < num * q[3] or q[4] * den < num * p[3]:
            continue
        label = forest.label
        one = label[p[0]]
        if (label[p[0] : p[1]] == one).all() and (p is q or (label[q[0] : q[1]] == one).all()):
            continue
        room = min(int(np.bitwise_count(p[2] & q[2]).sum()) + min(p[5], q[5]), p[4], q[4])
        if room * (den + num) < num * (p[3] + q[3]):
            continue
        if p[6] or q[6]:
            if p is q:
                kids = p[6]
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i + 1, len(kids))]
                stack += [(k, k) for k in kids]
            elif not q[6] or (p[6] and p[1] - p[0] >= q[1] - q[0]):
                stack += [(k, q) for k in p[6]]
            else:
                stack += [(p, k) for k in q[6]]
            continue
        i, j = np.arange(p[0], p[1]), np.arange(q[0], q[1])
        common = np.bitwise_count(tree.bits[i][:, None] & tree.bits[j][None]).sum(axis=2, dtype=np.int64)
        room = common + np.minimum(tree.excess[i][:, None], tree.excess[j][None])
        open_ = (room * (den + num) >= num * (tree.size[i][:, None] + tree.size[j][None])) & (label[i][:, None] != label[j][None])
        if p is q:
            open_ &= i[:, None] < j[None]
        if across:
            open_ &= side[i][:, None] != side[j][None]
        for a, b in zip(*np.nonzero(open_), strict=True):
            x, y = int(i[a]), int(j[b])
            if forest.label[x] != forest.label[y]:
                s, t = tree.sets[x], tree.sets[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    forest.link(x, y)
    return [(int(order[x]), int(order[y])) for x, y in forest.links]


# --- the operator -----------------------------------------------------------------------------------


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' shingle sets, their offsets, and a 64-bit name of each set."""
    values, offs = T.distinct_sets(*T.shingle_hashes(*T.word_hashes(column), k))
    n = np.diff(offs)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(T.mix(values ^ _K[2]), out=sums[1:])
    name = T.mix((sums[offs[1:]] - sums[offs[:-1]]) * _K[0] + n.astype(np.uint64) * _K[1])
    return values, offs, T.to_i64(name)


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_id, component_id) for every row.

    A row's set holds the distinct k-word shingles of its whole text (lower-cased A-Z; with fewer words
    the whole sequence is one; without words it is empty). Rows link when den * |common| >= num *
    |union|; component_id is the smallest id reachable by links, the row's own if there is none.

    Rows with equal sets are one node, named by a 64-bit hash of the set (set_id), however many there
    are. Nodes get blocking keys that no linked pair can miss; nodes that share a key form candidate
    groups (stars and connected components, never pairs of a group; those of each band of sizes apart, so that
    chance does not chain small sets to large ones), and inside each group a signature
    tree finds the links, verified on the whole sets. Ids are integers; a null id never names a
    component of rows that have ids; repeated ids stay separate rows; empty sets link with nothing;
    other columns are not read; an empty table gives no rows. Three tables in the shared folder cut the
    lineage.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def name(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                _, offs, node = _sets(part.column(1), k)
                n = np.diff(offs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(node, mask=n == 0)], names=["id", "n_shingles", "node"])

    named = materialize(rows.mapInArrow(lean(name), "id long, n_shingles long, node long"), "shingle-sets")
    buckets = int(min(20_000, max(8, -(-named.count() // 1024))))

    def keys(batches):
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            seen: set[int] = set()
            for at in range(0, batch.num_rows, BATCH):
                values, offs, node = _sets(batch.column(1).slice(at, BATCH), k)
                fresh = np.zeros(len(node), bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= np.fromiter((int(x) not in seen for x in node), bool, len(node))
                seen.update(node[fresh].tolist())
                keep = np.repeat(fresh, np.diff(offs))
                new = np.concatenate([[0], np.cumsum(np.diff(offs)[fresh])])
                key, where, band = banded_keys(values[keep], new, num, den)
                found.append((key, _in_band(node[fresh][where], band)))
            if found:
                yield packed_keys(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), buckets)

    candidates = connected_components(candidate_links(rows.mapInArrow(lean(keys), KEY_SCHEMA)))
    sized = named.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("n_shingles").alias("n"))
    chosen = sized.select("node", "id")

    def banded(batches):
        for batch in batches:
            node, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            band = np.searchsorted(_bands(num, den), size, "right") - 1
            for down in (0, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_in_band(node, band - down)), pa.array(np.full(len(node), 1 - down))], names=["node", "id", "alias", "own"])

    members = candidates.select(F.col("node").alias("alias"), F.col("component").alias("cluster")).join(sized.mapInArrow(banded, "node long, id long, alias long, own long"), "alias").drop("alias")
    # pairs from the upper band alone are found among that band's own
    members = materialize(members, "members")
    members = members.join(members.groupBy("cluster").agg(F.max("own").alias("any")).where("any = 1"), "cluster", "left_semi").drop("own")

    def link(table: pa.Table, side: np.ndarray) -> list[tuple[int, int]]:
        column = table["text"].combine_chunks() if len(table) else pa.array([], pa.string())
        parts = [_sets(column.slice(at, BATCH), k) for at in range(0, max(1, len(column)), BATCH)]
        sets = [v[s:e] for v, o, _ in parts for s, e in zip(o[:-1], o[1:], strict=True)]
        node = np.concatenate([n for *_, n in parts])
        # several rows may have a chosen id; those with another text are not the chosen ones
        mine = np.flatnonzero(node == table["node"].to_numpy())
        mine = mine[np.unique(node[mine], return_index=True)[1]]
        pairs = linked_pairs([sets[i] for i in mine], side[mine], num, den)
        return [(int(mine[a]), int(mine[b])) for a, b in pairs]

    groups = verified_components(members, rows.join(members, "id"), link, "shingle-links")
    best = groups.join(chosen, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = groups.join(best, "component").select("node", "component_id")
    # one row for each node on the right; a node with very many rows is on the left, where it can be split
    lone = chosen.join(of_node, "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id"))
    return named.join(lone, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.col("node").alias("set_id"), F.coalesce("component_id", "id").alias("component_id")
    )


__all__ = ["SignatureTree", "blocking_keys", "connected_components", "join_components", "linked_pairs"]
