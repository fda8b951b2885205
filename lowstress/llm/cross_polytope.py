"""Near duplicates among vectors by cross-polytope hashing.

A table hashes a vector by ``hashes`` random rotations (three rounds of random signs and a fast
Hadamard transform each): the nearest corner of the cross-polytope is the axis of the largest
component and its sign. With multiprobe every rotation contributes its ``probes`` nearest corners, so
a vector is filed under probes ^ hashes buckets of a table, and two vectors meet if they share one.
The number of rotations follows from the number of vectors, that of tables from the chance, measured
on random pairs, that two vectors just at the threshold meet in a table.

Vectors that meet are compared exactly, in double precision and in tiles of bounded size. A pair that
meets in several buckets counts in the first that both share, so no list of pairs is ever needed:
tiles return how many partners each vector has and what is connected.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.graph.components import connected_components, forest
from lowstress.llm.blocks import lean, trim
from lowstress.storage import materialize

#: Vectors that a bucket holds on average at most; more vectors get another rotation.
BUCKET = 64
#: Members of a bucket that are compared at once; larger buckets are cut into tiles of this size.
TILE = 2048
#: Chance that a pair at the threshold meets in no table at all.
MISS = 0.01
_FNV = np.uint64(0x100000001B3)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row (its length a power of two), scaled to keep lengths."""
    n, d = x.shape
    s = 1
    while s < d:
        y = x.reshape(n, d // (2 * s), 2, s)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        s *= 2
    return x / math.sqrt(d)


def corners(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest corners of a rotated cross-polytope, nearest first: 2 * axis + sign. Columns of x are padded to a power of two."""
    n, dims = x.shape
    d = 1 << max(0, dims - 1).bit_length()
    y = np.zeros((n, d))
    y[:, :dims] = x
    rng = np.random.Generator(np.random.PCG64([seed, d]))
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    size = np.abs(y)
    axis = np.argsort(-size, axis=1, kind="stable")[:, :probes]
    return axis * 2 + (np.take_along_axis(y, axis, 1) > 0)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes ^ hashes) bucket keys of 32 bits; keys of one table are distinct for one row unless their hashes collide."""
    per = min(probes, 1 << max(0, x.shape[1] - 1).bit_length())
    out = np.empty((len(x), tables, per**hashes), np.int32)
    for t in range(tables):
        found = [corners(x, seed + t * hashes + h, per) for h in range(hashes)]
        for k, choice in enumerate(itertools.product(range(per), repeat=hashes)):
            key = np.full(len(x), t + 1, np.uint64)
            for c, f in zip(choice, found, strict=True):
                key = (key ^ f[:, c].astype(np.uint64)) * _FNV
                key ^= key >> np.uint64(29)
            out[:, t, k] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def plan(n: int, dims: int, cosine: float, probes: int, seed: int) -> tuple[int, int]:
    """(tables, hashes) for n vectors: enough rotations for small buckets, enough tables for pairs just at the threshold."""
    d = 1 << max(0, dims - 1).bit_length()
    hashes = max(1, math.ceil(math.log(max(1, n / BUCKET)) / math.log(max(2, d))))
    rng = np.random.Generator(np.random.PCG64([seed, 1]))
    a, b = rng.normal(size=(2, 2000, max(2, dims)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (corners(a, seed, probes)[:, :, None] == corners(b, seed, probes)[:, None, :]).any(axis=(1, 2)).mean()
    chance = min(0.999, max(0.01, float(met))) ** hashes
    return max(2, math.ceil(math.log(MISS) / math.log(1 - chance))), hashes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; the largest component is scaled to 1 first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    """Every row as bytes: floats where they hold the same numbers, else doubles."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return pa.array([(s if e else d).tobytes() for s, d, e in zip(short, x, exact, strict=True)], pa.binary())


def _unpacked(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims))
    for i, body in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(body, np.float32 if len(body) == 4 * dims else np.float64)
    return out


def _pairs_counted(left: np.ndarray, right: np.ndarray, table: int, key: int) -> np.ndarray:
    """Of pairs that share bucket ``key`` of ``table`` (their keys by row), those that share none before it: in an earlier table, or a smaller one of this."""
    same = np.zeros(len(left), bool)
    for t in range(table + 1):
        both = left[:, t, :, None] == right[:, t, None, :]
        if t == table:
            both &= left[:, t, :, None] < key
        same |= both.any(axis=(1, 2))
    return ~same


def near_groups(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", probes: int = 2, seed: int = 11) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: rows linked to it directly, the smallest id reachable by links, and whether that is its own.

    Two rows link if the cosine of their vectors, in double precision, is ``cosine`` or more; pairs below it never
    do. Equal vectors are one vector first, which counts as often as it occurs, so a vector that a third of all rows share is
    compared once. A pair at the threshold is missed with a chance of about ``MISS``, closer ones less. Buckets are
    never cut short: one with over TILE vectors is compared tile by tile.

    Rows whose vector is null, empty, zero or holds null or non-finite components link with nothing (n_links 0, a group of
    their own). Vectors of different lengths do not meet. Rows that share an id are rows of their own; a null id is never the
    smallest unless a group has no other (then component_id is null; kept compares null-safely). An empty table gives no
    rows. Extra columns are not read. Vectors have few different lengths: the driver holds a plan (two numbers) for each.
    """
    xs = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    sound = ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("x", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), xs.alias("x")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    classes = rows.where("sound").groupBy("x").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    # one number for each length of vectors
    plans = {r["dims"]: plan(r["n"], r["dims"], cosine, probes, seed) for r in classes.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).collect()}

    def keyed(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, int(d))
                keys = bucket_keys(unit(x), *plans[int(d)], probes, seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys[0].size), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), _packed(x), part.column(2), part.column(3), flat], names=["node", "x", "copies", "dims", "keys"])

    def compare(key, table):
        dims, at_table, bucket = (k.as_py() for k in key[:3])
        _, fresh = np.unique(table["node"].to_numpy(), return_index=True)  # a row files twice under one key if its hashes collide
        table = table.take(pa.array(fresh)).combine_chunks()
        node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
        x = unit(_unpacked(table["x"], dims))
        keys = np.asarray(pc.list_flatten(table["keys"])).reshape(len(node), plans[dims][0], -1)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
        within = not side.any()
        partners = np.zeros(len(node), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(left), 256):
            rows_, cols = np.nonzero(x[left[s : s + 256]] @ x[right].T >= cosine)
            i, j = left[s + rows_], right[cols]
            if within:
                i, j = i[i < j], j[i < j]
            a, b = forest(np.concatenate([a, i]), np.concatenate([b, j]))
            for c in range(0, len(i), 1 << 16):
                p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                first = _pairs_counted(keys[p], keys[q], at_table, bucket)
                np.add.at(partners, p[first], copies[q[first]])
                np.add.at(partners, q[first], copies[p[first]])
        inner, some = a != b, partners > 0
        out = pa.table([pa.array(np.concatenate([node[a[inner]], node[some]])), pa.array(np.concatenate([node[b[inner]], node[some]])), pa.array(np.concatenate([np.zeros(inner.sum(), np.int64), partners[some]]))], names=["a", "b", "n"])
        if len(node) > 256:
            trim()
        return out

    hashed = classes.select("node", "x", "copies", F.size("x").alias("dims")).mapInArrow(lean(keyed), "node long, x binary, copies long, dims int, keys array<int>")
    hashed = materialize(hashed, "vector-keys")
    if not plans:  # no sound vector at all
        linked = classes.select("node", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n"))
    else:
        tables = F.create_map(*[F.lit(v) for d, (t, _) in plans.items() for v in (d, t)])
        hashed = hashed.withColumn("width", F.floor(F.size("keys") / tables[F.col("dims")]).cast("int"))
        number = F.floor(F.col("at") / F.col("width")).cast("int").alias("table")
        spread = hashed.select("*", F.posexplode("keys").alias("at", "bucket")).select("dims", number, "bucket", "node", "copies", "x", "keys")
        sizes = hashed.select("dims", "width", F.posexplode("keys").alias("at", "bucket")).groupBy("dims", number, "bucket").agg(F.count("*").alias("n")).where("n > 1")
        sizes = sizes.select("dims", "table", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
        tile = F.pmod(F.xxhash64("node"), "tiles").cast("int")
        with_others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, tile).alias("x"), F.greatest(o, tile).alias("y"), (tile > o).cast("int").alias("side")))
        units = spread.join(sizes, ["dims", "table", "bucket"]).withColumn("u", F.explode(with_others)).select("dims", "table", "bucket", F.col("u.x").alias("tx"), F.col("u.y").alias("ty"), F.col("u.side").alias("side"), "node", "copies", "x", "keys")
        found = materialize(units.groupBy("dims", "table", "bucket", "tx", "ty").applyInArrow(compare, "a long, b long, n long"), "vector-links")
        partners = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        groups = connected_components(found.where("a <> b"))
        member = classes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        names = member.groupBy("component").agg(F.min("least").alias("component_id"))
        linked = member.join(names, "component").join(partners, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    by_class = classes.join(linked, "node").select("x", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.where("sound").join(by_class, "x").select("id", "n_links", "component_id")
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
