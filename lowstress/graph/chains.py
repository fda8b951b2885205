"""The order of edges along chains, by list ranking: no chain is walked in one task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.storage import checkpoint

#: Links that one task may follow by itself (32 bytes each); more are followed by rounds of joins.
ONE_TASK = 1 << 20


def _follow(dart: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dart, last dart of its list, steps to it) by pointer doubling; darts of rings are left out."""
    order = np.argsort(dart)
    dart, after = dart[order], after[order]
    at = np.searchsorted(dart, after)
    at[at == len(dart)] = 0
    to = np.where(dart[at] == after, at, -1) if len(dart) else at  # -1: the next one is the last
    end, steps = after.copy(), np.ones(len(dart), np.int64)
    for _ in range(max(1, len(dart)).bit_length() + 1):
        open_ = np.flatnonzero(to >= 0)
        if not len(open_):
            break
        t = to[open_]
        steps[open_] += steps[t]
        end[open_] = end[t]
        to[open_] = to[t]
    whole = to < 0
    return dart[whole], end[whole], steps[whole]


def last_of(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(dart, end, steps) of every dart that has a next one, given (dart, after); rings have no end and no rows.

    In each round every dart learns what the dart at its present end knows, so distances double. ``one_task`` links or
    fewer are followed in one task.
    """
    links = checkpoint(links)
    n = links.count()
    if n <= one_task:

        def follow(batches):
            parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for batch in batches:
                for p, c in zip(parts, ("dart", "after"), strict=True):
                    p.append(batch.column(batch.schema.get_field_index(c)).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _follow(*(np.concatenate(p) for p in parts))], names=["dart", "end", "steps"])

        return links.coalesce(1).mapInArrow(follow, "dart long, end long, steps long")
    state = links.select("dart", F.col("after").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open"))
    for _ in range(math.ceil(math.log2(n)) + 2):
        ahead = state.select(F.col("dart").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        state = checkpoint(state.join(ahead, "end", "left").select("dart", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_end").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
    return state.where("not open").drop("open")


def chain_order(edges: DataFrame, joints: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(eid, chain, pos, u, v): each edge's chain (a number), its place from 0 on, and the nodes that it leads from and to.

    ``edges`` are (eid, a, b) with small unique eid >= 0; ``joints`` (e1, s1, e2, s2) say which two edges go on into each other
    and with which end (0: a, 1: b) they meet; an end has one joint at most. Chains run from their smaller outer node (ties: the
    smaller dart). Edges of rings have no rows; an edge without a joint is a chain of its own.
    """
    # dart 2e leads from a to b, 2e + 1 back; who arrives by one edge goes on by the other
    go = lambda x, s, y, t: joints.select((F.col(x) * 2 + 1 - F.col(s)).alias("dart"), (F.col(y) * 2 + F.col(t)).alias("after"))
    ends = checkpoint(last_of(go("e1", "s1", "e2", "s2").unionByName(go("e2", "s2", "e1", "s1")), one_task))
    way = lambda side: ends.where(F.col("dart") % 2 == side).select(F.floor(F.col("dart") / 2).alias("eid"), F.col("end").alias(f"end{side}"), F.col("steps").alias(f"steps{side}"))
    has = lambda side: joints.select(F.col("e1").alias("eid"), F.col("s1").alias("s")).unionByName(joints.select(F.col("e2").alias("eid"), F.col("s2").alias("s"))).where(F.col("s") == 1 - side).select("eid", F.lit(True).alias(f"on{side}"))
    out = edges.select("eid", "a", "b")
    for side in (0, 1):
        out = out.join(way(side), "eid", "left").join(has(side), "eid", "left")
        # a dart that goes on but has no end is on a ring
        out = out.where(F.col(f"on{side}").isNull() | F.col(f"end{side}").isNotNull()).drop(f"on{side}")
        out = out.withColumns({f"end{side}": F.coalesce(f"end{side}", F.col("eid") * 2 + side), f"steps{side}": F.coalesce(f"steps{side}", F.lit(0))})
    out = checkpoint(out)
    head = lambda side: edges.select((F.col("eid") * 2).alias(f"end{side}"), F.col("b").alias(f"at{side}")).unionByName(edges.select((F.col("eid") * 2 + 1).alias(f"end{side}"), F.col("a").alias(f"at{side}")))
    out = out.join(head(0), "end0").join(head(1), "end1")
    # going by dart 0 a chain begins where dart 1 leads to
    forth = (F.col("at1") < F.col("at0")) | ((F.col("at1") == F.col("at0")) & (F.col("end1") < F.col("end0")))
    pick = lambda x, y: F.when(forth, F.col(x)).otherwise(F.col(y))
    return out.select("eid", F.least("end0", "end1").alias("chain"), pick("steps1", "steps0").cast("long").alias("pos"), pick("a", "b").alias("u"), pick("b", "a").alias("v"))


def joints_of(ends: DataFrame, by: list[str]) -> DataFrame:
    """(*by, e1, s1, e2, s2) of the nodes in which exactly two edges end; ``ends`` are (*by, eid, s)."""
    met = ends.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("eid", "s")).alias("p"), F.max(F.struct("eid", "s")).alias("q")).where("n = 2 and p.eid <> q.eid")
    return met.select(*by, F.col("p.eid").alias("e1"), F.col("p.s").alias("s1"), F.col("q.eid").alias("e2"), F.col("q.s").alias("s2"))
