"""Geometry as Catalyst expressions: distances, node keys, grid cells, point to segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M, LON_M, LAT_M = 6371000.0, 111000.0, 111320.0, 110540.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def node_key(lat: Column, lon: Column) -> Column:
    """One integer for a coordinate at five decimals."""
    k = lambda c: F.floor(c * F.lit(1e5) + F.lit(0.5)).cast("long")
    return k(lat) * 100_000_000 + k(lon) + 18_000_000


def cell(x: Column, size: Column | float) -> Column:
    """Grid cell of a coordinate, cut towards zero."""
    return (x / size).cast("long")


def point_segment(plat: Column, plon: Column, alat: Column, alon: Column, blat: Column, blon: Column) -> Column:
    """struct(dist, lat, lon, t): the nearest point of a segment, in a flat projection about its first end."""
    mx = F.lit(LON_M) * F.cos(F.radians(alat))
    my = F.lit(LAT_M)
    bx, by, px, py = (blon - alon) * mx, (blat - alat) * my, (plon - alon) * mx, (plat - alat) * my
    sq = bx * bx + by * by
    t = F.when(sq == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * bx + py * by) / sq)))
    dist = F.hypot(px - t * bx, py - t * by)
    return F.struct(dist.alias("dist"), (alat + t * (blat - alat)).alias("lat"), (alon + t * (blon - alon)).alias("lon"), t.alias("t"))


def polyline_length(coords: Column) -> Column:
    """Sum of the distances between neighbours of array<struct<lat, lon>>."""
    n = F.size(coords)
    pairs = F.arrays_zip(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))).alias("p"), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + haversine(x["p"]["lat"], x["p"]["lon"], x["q"]["lat"], x["q"]["lon"]))


def segment_cells(alat: Column, alon: Column, blat: Column, blon: Column, size: float) -> Column:
    """array<struct<r, c>>: the distinct cells of points less than a cell apart along a segment."""
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(blat - alat), F.abs(blon - alon)) / size * 2).cast("int"))
    at = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(cell(alat + (blat - alat) * i / steps, size).alias("r"), cell(alon + (blon - alon) * i / steps, size).alias("c")))
    return F.array_distinct(at)


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def same_place(p: Column, q: Column, tolerance: float = 1e-7) -> Column:
    return (F.abs(p["lat"] - q["lat"]) < tolerance) & (F.abs(p["lon"] - q["lon"]) < tolerance)


def join_polylines(first: Column, second: Column) -> Column:
    """One line from two that share an end (either may be turned round); where they share none, the second follows the first."""
    n, m = F.size(first), F.size(second)
    head, tail = first[0], F.element_at(first, -1)
    h2, t2 = second[0], F.element_at(second, -1)
    rest = lambda line: F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    joined = (
        F.when(same_place(tail, h2), F.concat(first, rest(second)))
        .when(same_place(tail, t2), F.concat(first, rest(F.reverse(second))))
        .when(same_place(head, t2), F.concat(second, rest(first)))
        .when(same_place(head, h2), F.concat(F.reverse(second), rest(first)))
        .otherwise(F.concat(first, second))
    )
    return F.when(n == 0, second).when(m == 0, first).otherwise(joined)
