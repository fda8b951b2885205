"""Distance joins: both sides meet in grid cells by an equi-join, then the exact distance decides.

A nested-loop join would compare everything with everything; here a left row is sent to its 3 x 3
cells and a right row to one, so the work follows the local density and the join is an ordinary
shuffled (or size-checked broadcast) hash join that AQE can split where a cell is crowded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions.geo import DEGREE_M, cell, haversine

def _height(radius: float, exact: bool) -> float:
    """Degrees of latitude of a cell."""
    return radius / DEGREE_M * (1.01 if exact else 1)


def _width(row: Column, height: float, exact: bool, widest: float | None = None) -> Column:
    """Degrees of longitude of the cells of a row: exact joins widen them with the latitude, up to one cell around a pole, and no wider than ``widest``."""
    if not exact:
        return F.lit(height)
    # a cosine changes by no more than its angle, so this bounds it over two rows to either side; beyond a pole it grows again
    shrink = F.abs(F.cos(F.radians(row * F.lit(height)))) - math.radians(2 * height)
    width = F.when(shrink < 0.001, F.lit(1000.0)).otherwise(F.lit(height) / F.greatest(shrink, F.lit(0.001)))
    return width if widest is None else F.least(width, F.lit(widest))


def _around(lat: Column, lon: Column, height: float, exact: bool, widest: float | None) -> Column:
    rows = [cell(lat, height) + i for i in (-1, 0, 1)]
    return F.array(*[F.struct(r.alias("r"), (cell(lon, _width(r, height, exact, widest)) + j).alias("c")) for r in rows for j in (-1, 0, 1)])


def _folded(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place with a latitude from -90 to 90 and a longitude from -180 to 180."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    over = turn > 180
    return F.when(over, 270 - turn).otherwise(turn - 90), F.pmod(F.when(over, lon + 360).otherwise(lon + 180), F.lit(360.0)) - 180


def grid_join(left: DataFrame, right: DataFrame, radius: float, exact: bool = True, how: str = "inner", least: float | None = None, cut: bool = True, box: tuple[float, float | None] | None = None, fold: bool = False) -> DataFrame:
    """Pairs of rows (lat, lon on the left; r_lat, r_lon on the right) within ``radius``, with ``dist``.

    ``exact``: cells only prune (at any latitude; a pair across the antimeridian is not seen). Otherwise cells are squares in
    degrees and being in neighbouring cells is part of the condition (pairs further apart east to west than one cell are
    left out); without ``cut`` it is the whole condition, whatever the distance. ``box``: degrees of latitude and longitude (None: any) by
    which a pair may differ at most, whatever its distance. ``fold``: coordinates beyond the poles count as the places that they name.

    The exploded side is many times what Spark takes it for, so neither side is broadcast by its estimated size.
    """
    height = _height(radius, exact)
    widest = box[1] * 1.01 if box and box[1] is not None else None
    l_at, r_at = (F.col("lat"), F.col("lon")), (F.col("r_lat"), F.col("r_lon"))
    if fold:
        l_at, r_at = _folded(*l_at), _folded(*r_at)
    l_cells = left.withColumn("_k", F.explode(_around(*l_at, height, exact, widest))).select("*", "_k.r", "_k.c").drop("_k").hint("merge")
    r_row = cell(r_at[0], height)
    r_cells = right.withColumn("r", r_row).withColumn("c", cell(r_at[1], _width(r_row, height, exact, widest)))
    pairs = l_cells.join(r_cells, ["r", "c"]).drop("r", "c").withColumn("dist", haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    pairs = pairs.where(F.col("dist") <= radius) if cut else pairs
    for c, d in zip(("lat", "lon"), box or (), strict=False):
        pairs = pairs if d is None else pairs.where(F.col(f"r_{c}").between(F.col(c) - d, F.col(c) + d))
    return pairs if least is None else pairs.where(F.col("dist") > least)


def in_rows_of(left: DataFrame, right: DataFrame, radius: float, exact: bool = True) -> DataFrame:
    """The left rows that ``grid_join`` could pair with any right row by their latitudes; only the rows of cells that the right side occupies are broadcast."""
    height = _height(radius, exact)
    rows = right.select(F.explode(F.array(*[cell(F.col("r_lat"), height) + i for i in (-1, 0, 1)])).alias("_r")).distinct()
    return left.withColumn("_r", cell(F.col("lat"), height)).join(F.broadcast(rows), "_r", "left_semi").drop("_r")


#: Rows of cells that one task sorts.
CELL_ROWS = 1 << 20


def node_join(left: DataFrame, right: DataFrame, radius: float, least: float | None = None, rows: int = 0) -> DataFrame:
    """Like ``grid_join`` by square degrees, of tables whose coordinates are those of their keys node and r_node: only the keys are shuffled.

    ``rows``: about as many as the left side has; where the session's shuffle partitions would hold too many, there are more.
    """
    from lowstress.operators.network import _coords

    height = _height(radius, False)
    cells = _around(F.col("lat"), F.col("lon"), height, False, None)
    l_cells = left.withColumn("_k", F.explode(cells)).select("*", "_k.r", "_k.c").drop("_k", "lat", "lon").hint("merge")
    r_cells = right.withColumns({"r": cell(F.col("r_lat"), height), "c": cell(F.col("r_lon"), height)}).drop("r_lat", "r_lon")
    n = -(-9 * rows // CELL_ROWS)
    if n > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        l_cells, r_cells = l_cells.repartition(n, "r", "c").hint("merge"), r_cells.repartition(n, "r", "c")
    (la, lo), (ra, ro) = _coords(F.col("node")), _coords(F.col("r_node"))
    pairs = l_cells.join(r_cells, ["r", "c"]).drop("r", "c").withColumns({"lat": la, "lon": lo, "r_lat": ra, "r_lon": ro})
    pairs = pairs.withColumn("dist", haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).where(F.col("dist") <= radius)
    return pairs if least is None else pairs.where(F.col("dist") > least)


def grid_join_limit(left: DataFrame, right: DataFrame, limit: Column, classes: tuple[float, ...] = (100, 400, 1600), box: tuple[float, float | None] | None = None) -> DataFrame:
    """Pairs within a distance that each left row sets itself: one exact join for each class of limits, so that few long ones do not widen the cells of all.

    Limits beyond the largest class are an error where they occur.
    """
    out, low = None, 0.0
    left = left.withColumn("_limit", limit)
    for high in classes:
        bound = F.when(F.col("_limit") > classes[-1], F.raise_error(F.lit("a limit is beyond the classes"))).otherwise(F.col("_limit"))
        part = left.where((bound > low) & (F.col("_limit") <= high)) if low else left.where(bound <= high)
        pairs = grid_join(part, right, high, box=box).where(F.col("dist") <= F.col("_limit"))
        out, low = pairs if out is None else out.unionByName(pairs), high
    return out.drop("_limit")


def nearest(left: DataFrame, right: DataFrame, key: str, radius: float, order: list[str], exact: bool = True, k: int = 1, least: float | None = None, where: Column | None = None, box: tuple[float, float | None] | None = None) -> DataFrame:
    """The k nearest right rows of each left row within ``radius``; ties by ``order``. Adds ``dist`` and ``rn``."""
    pairs = grid_join(left, right, radius, exact, least=least, box=box)
    pairs = pairs if where is None else pairs.where(where)
    rn = F.row_number().over(Window.partitionBy(key).orderBy("dist", *order))
    return pairs.withColumn("rn", rn).where(F.col("rn") <= k)


def within(left: DataFrame, right: DataFrame, key: str, radius: float, exact: bool = True, box: tuple[float, float | None] | None = None) -> DataFrame:
    """Keys of the left rows that have a right row within ``radius``."""
    return grid_join(left, right, radius, exact, box=box).select(key).distinct()
