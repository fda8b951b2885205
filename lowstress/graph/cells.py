"""A network cut into cells of bounded size along a curve that keeps neighbours together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress.operators.ranking import ranked

#: Nodes of a cell.
CELL_NODES = 4096
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    """The low 31 bits of x, each followed by a zero bit."""
    x = x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    for by, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(node: Column) -> Column:
    """Position of a node key on a Z-order curve over its latitude and longitude (other whole numbers get some position as well)."""
    row = F.floor(node / F.lit(100_000_000)).cast("long") + 9_000_000
    column = F.pmod(node, F.lit(100_000_000)).cast("long")
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(column))


def bounded_cells(nodes: DataFrame, size: int = CELL_NODES) -> DataFrame:
    """(node, cell): distinct nodes, ``size`` to a cell, in the order of the curve."""
    placed = ranked(nodes.select("node").withColumn("_z", curve(F.col("node"))), "_n", "_z", "node")
    return placed.select("node", F.floor((F.col("_n") - 1) / size).cast("long").alias("cell"))
