"""Exact top-k by integer inner product on a bit-sliced index of quantised attributes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one index block and queries of one query block.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 256
#: Low slices of an attribute that the first pass leaves out; their possible share widens the bounds.
LOW_SLICES = 3


class SlicedBlock:
    """Bitmaps of one block of rows: for every attribute, one bitmap per bit, most significant last."""

    def __init__(self, values: np.ndarray):
        self.n, self.dims = values.shape
        self.values = values
        self.low = values.min(axis=0) if self.n else np.zeros(self.dims, np.int64)
        shifted = values - self.low
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.words = (self.n + 63) // 64
        pad = np.zeros((self.words * 64, self.dims), np.int64)
        pad[: self.n] = shifted
        self.slices = np.empty((self.dims, self.bits, self.words), np.uint64)
        for b in range(self.bits):
            plane = ((pad >> b) & 1).astype(np.uint8)
            self.slices[:, b] = np.packbits(plane.T.copy(), axis=1, bitorder="little").view(np.uint64).reshape(self.dims, self.words)

    def weighted_sum(self, q: np.ndarray, skip: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bit slices of sum(q * (x >> skip << skip)) minus a constant, which is returned first.

        q is taken in signed digits; a negative digit adds the complement of a slice instead, so that
        everything added is non-negative. Columns of equal weight are reduced by carry-save adders.
        """
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d in np.flatnonzero(q):
            x, p = int(q[d]), 0
            while x:
                if x & 1:
                    digit = 2 - (x & 3)
                    x -= digit
                    for b in range(skip, self.bits):
                        s = self.slices[d, b]
                        if digit < 0:
                            s, constant = ~s, constant - (1 << (p + b))
                        columns.setdefault(p + b, []).append(s)
                x >>= 1
                p += 1
        out, w = [], 0
        top = max(columns, default=-1)
        while w <= top:
            col = columns.pop(w, [])
            up: list[np.ndarray] = columns.setdefault(w + 1, []) if len(col) > 1 else columns.get(w + 1, [])
            while len(col) > 1:
                if len(col) == 2:
                    a, b = col
                    up.append(a & b)
                    col = [a ^ b]
                else:
                    a, b, c = col.pop(), col.pop(), col.pop()
                    t = a ^ b
                    up.append((a & b) | (t & c))
                    col.insert(0, t ^ c)
            if up:
                top = max(top, w + 1)
            out.append(col[0] if col else np.zeros(self.words, np.uint64))
            w += 1
        return np.int64(constant), out

    def at_least(self, total: list[np.ndarray], k: int) -> tuple[int, np.ndarray]:
        """The k-th largest value of the summed slices and the bitmap of rows that reach it.

        Slices are read from the most significant one downward: rows with the bit set stay if there
        are k or more of them, else they are certain and the rest compete for the remaining places.
        """
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: self.n] = 1
        open_rows = np.packbits(valid, bitorder="little").view(np.uint64)
        sure, need, value = np.zeros(self.words, np.uint64), min(k, self.n), 0
        for b in range(len(total) - 1, -1, -1):
            have = open_rows & total[b]
            count = int(np.bitwise_count(have).sum())
            if count >= need:
                open_rows, value = have, value | (1 << b)
            else:
                sure, need, open_rows = sure | have, need - count, open_rows & ~total[b]
        return value, sure | open_rows

    def select_reaching(self, total: list[np.ndarray], bound: int) -> np.ndarray:
        """Positions of the rows whose summed value is ``bound`` or more."""
        equal = np.full(self.words, ~np.uint64(0))
        above = np.zeros(self.words, np.uint64)
        if bound >> len(total):
            return np.zeros(0, np.int64)
        for b in range(len(total) - 1, -1, -1):
            if (bound >> b) & 1:
                equal = equal & total[b]
            else:
                above |= equal & total[b]
                equal = equal & ~total[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.n])

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) for q without the row ``own``; ties go to the smaller id."""
        skip = min(LOW_SLICES, self.bits - 1)
        _, total = self.weighted_sum(q, skip)
        rest = (1 << skip) - 1
        # a row's exact score is its summed value plus a constant plus something in [-lo, hi]
        hi, lo = int(q[q > 0].sum()) * rest, -int(q[q < 0].sum()) * rest
        kth, _ = self.at_least(total, k + 1)  # one more: the query's own row may be among them
        rows = self.select_reaching(total, max(0, kth - lo - hi))
        rows = rows[ids[rows] != own] if own is not None else rows
        scores = self.values[rows] @ q  # boundary rows, exactly
        best = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][best], scores[best]


def exact_top(values: np.ndarray, q: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``SlicedBlock.top``, in whole numbers of any length; scores beyond a long count as the nearest long."""
    far = np.iinfo(np.int64)
    scores = [min(max(sum(a * b for a, b in zip(x, q.tolist(), strict=True)), far.min), far.max) for x in values.tolist()]
    best = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if i != own)[:k]
    return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, q array<bigint>): floor(scale * x) in doubles; vectors that are null or hold null or non-finite components go."""
    xs = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = ~F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(xs, lambda x: F.floor(F.lit(scale) * x)).alias("q")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Rows and queries meet in blocks: every block of queries is sent to every block of rows of the same
    number of dimensions, a block of rows is sent and indexed once and the queries stream past it, nothing is
    broadcast, and a block yields k rows per query. A block's rows get
    a bit-sliced index; the sum over all but the lowest slices bounds every score, slices are read from
    the top to find the k-th bound, and rows that can still reach it are resolved exactly. Equal vectors
    (a common one may hold a third of all rows) are spread over blocks by a hash of the id.

    A candidate is every row with another id than the query's; repeated ids are separate rows; vectors
    of other lengths are not comparable and do not meet; empty vectors score 0. Blocks whose sums could leave 62 bits are
    resolved in whole numbers of any length instead of slices; scale * x beyond a long, and scores beyond one, count as the
    nearest long. Extra columns are not read; no queries or no candidates give no rows.
    """
    rows, asks = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale)
    n_blocks = rows.groupBy(F.size("q").alias("dims")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.withColumn("dims", F.size("q")).join(n_blocks, "dims").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # where two rows share an id, a random but repeatable split is not needed: they land in one block
    asks = asks.withColumn("dims", F.size("q")).join(n_blocks, "dims").withColumn("qb", F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1), F.col("blocks") * int(BLOCK_ROWS / BLOCK_QUERIES / 50) + 1)).cast("int"))
    q_blocks = asks.groupBy("dims", "qb", "blocks").agg(F.sort_array(F.collect_list(F.struct("id", "q"))).alias("asks"))
    q_blocks = q_blocks.select("dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "qb", F.col("asks").alias("cells"))
    r_blocks = rows.groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct("id", "q"))).alias("cells")).select("dims", "block", F.lit(0).alias("kind"), F.lit(0).alias("qb"), "cells")

    def unpack(cell, dims):
        ids, lists = cell.values.flatten()
        flat = np.asarray(lists.flatten()).astype(np.int64)
        return np.asarray(ids), flat.reshape(len(ids), dims) if dims else np.zeros((len(ids), 1), np.int64)

    def search(batches):
        """Every block comes once, before the queries that look through it."""
        ids = vals = index = held = None
        most = 0
        for batch in batches:
            for i in range(batch.num_rows):
                dims, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if batch.column(2)[i].as_py() == 0:
                    ids, vals = unpack(batch.column(4)[i], dims)
                    most = max(map(abs, (int(vals.min(initial=0)), int(vals.max(initial=0)))))
                    index, held = SlicedBlock(vals) if most < 1 << 40 else None, (dims, block)
                    continue
                if held != (dims, block):  # a block without rows
                    continue
                q_ids, qs = unpack(batch.column(4)[i], dims)
                out = []
                for a, q in zip(q_ids, qs, strict=True):
                    sums = 2 * most * sum(map(abs, q.tolist()))  # a block's values are shifted to be positive
                    t = index.top(q, k, ids, a) if index is not None and sums < 1 << 62 else exact_top(vals, q, k, ids, a)
                    out.append((np.repeat(a, len(t[0])), *t))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    met = r_blocks.unionByName(q_blocks).repartition("dims", "block").sortWithinPartitions("dims", "block", "kind", "qb")
    found = met.select("dims", "block", "kind", "qb", "cells").mapInArrow(search, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
