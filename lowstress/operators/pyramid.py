"""The nearest point however far away, on a pyramid of occupied cells.

Places are points of the unit sphere, so neither the antimeridian nor a pole is special. Level 0 has cubes of
about 100 m, every further level cubes four times as wide, and the last a single one. Each occupied cube
knows the box of its points, which bounds how near and how far a point in it can be. A place starts
at the finest level where its own cube holds a point; from there the occupied cubes around it are opened
level by level, and only those that can still hold the nearest point are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowstress.functions.geo import EARTH_M, haversine
from lowstress.storage import checkpoint

#: Width of a cube of level 0 on the unit sphere, levels, and bits of a coordinate that a level drops.
WIDTH, TOP, BITS = 100.0 / EARTH_M, 9, 2
_AXES = ("x", "y", "z")
#: Bounds are compared with some room for rounding.
_ROOM = 1 + 1e-9


def _sphere(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def _cube(axis: str) -> Column:
    return F.floor((F.col(axis) + 1) / WIDTH).cast("long").alias(f"c{axis}")


def _nearest2() -> Column:
    """Square of the least chord from (x, y, z) to a box."""
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"lo_{a}") - F.col(a), F.col(a) - F.col(f"hi_{a}"))
    return sum((gap(a) * gap(a) for a in _AXES), F.lit(0.0))


def _farthest2() -> Column:
    far = lambda a: F.greatest(F.abs(F.col(a) - F.col(f"lo_{a}")), F.abs(F.col(a) - F.col(f"hi_{a}")))
    return sum((far(a) * far(a) for a in _AXES), F.lit(0.0))


def pyramid(points: DataFrame) -> DataFrame:
    """(level, cx, cy, cz, px, py, pz, lo_*, hi_*): the occupied cubes of all levels below TOP, their parents and boxes; one shuffle."""
    box = [f(a).alias(f"{n}_{a}") for a in _AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    finest = points.groupBy("cx", "cy", "cz").agg(*box)
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP - 1))))
    up = lambda a, more: F.call_function("shiftright", F.col(f"c{a}"), (F.col("level") + more) * BITS)
    every = every.select("level", *[up(a, 0).alias(f"c{a}") for a in _AXES], *[up(a, 1).alias(f"p{a}") for a in _AXES], *[F.col(f"{n}_{a}") for a in _AXES for n in ("lo", "hi")])
    merged = [f(f"{n}_{a}").alias(f"{n}_{a}") for a in _AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return every.groupBy("level", "cx", "cy", "cz", "px", "py", "pz").agg(*merged)


def nearest_anywhere(places: DataFrame, points: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """(key, order, keep, dist) of the point nearest to each place (key, lat, lon), in metres; ties by ``order``.

    ``points`` have r_lat, r_lon. Places and points without coordinates take no part; without points there are no
    rows. Points at one spot are one (the first by ``order``). The plan has a join for each level between the
    spacing of the points and the largest distance that occurs: three or four in a region.
    """
    where = points.where("r_lat is not null and r_lon is not null").groupBy("r_lat", "r_lon").agg(F.min(F.struct(*order, *keep)).alias("v"))
    where = where.select("r_lat", "r_lon", "v", *_sphere(F.col("r_lat"), F.col("r_lon")))
    where = checkpoint(where.select("*", *[_cube(a) for a in _AXES]))
    cubes = checkpoint(pyramid(where))
    asked = places.where("lat is not null and lon is not null").select(F.col(key).alias("key"), "lat", "lon", *_sphere(F.col("lat"), F.col("lon")))
    asked = asked.select("*", *[_cube(a) for a in _AXES])

    own = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP - 1))))
    own = own.select("key", *_AXES, "level", *[F.call_function("shiftright", F.col(f"c{a}"), F.col("level") * BITS).alias(f"c{a}") for a in _AXES])
    found = own.join(cubes.drop("px", "py", "pz"), ["level", "cx", "cy", "cz"]).groupBy("key").agg(F.min_by(F.struct("level", _farthest2().alias("far")), "level").alias("m"))
    # one level up, the cubes around a place reach further than its own cube, which holds a point, is wide
    start = asked.join(found, "key", "left").select(
        "key", "lat", "lon", *_AXES, "cx", "cy", "cz", F.least(F.lit(TOP), F.coalesce(F.col("m.level") + 1, F.lit(TOP))).alias("from"), F.coalesce(F.col("m.far"), F.lit(5.0)).alias("bound")
    )
    start = checkpoint(start)
    highest = start.agg(F.max("from")).first()[0]
    if highest is None:
        highest = 0

    frontier = None
    for level in range(highest, 0, -1):
        begun = start.where(F.col("from") == level)
        at = {a: F.shiftright(f"c{a}", level * BITS) for a in _AXES}
        steps = (-1, 0, 1) if level < TOP else (0,)
        around = F.array(*[F.struct((at["x"] + i).alias("px"), (at["y"] + j).alias("py"), (at["z"] + k).alias("pz")) for i in steps for j in steps for k in steps])
        wide = WIDTH * (1 << (level * BITS))

        def least(c: Column, wide: float = wide) -> Column:
            """Square of the least chord from a place to a cube."""
            gaps = [F.greatest(F.lit(0.0), c[f"p{a}"] * F.lit(wide) - 1 - F.col(a), F.col(a) - ((c[f"p{a}"] + 1) * F.lit(wide) - 1)) for a in _AXES]
            return sum((g * g for g in gaps), F.lit(0.0))

        near = F.filter(around, lambda c: least(c) <= F.col("bound") * _ROOM) if level < TOP else around
        opened = begun.withColumn("p", F.explode(near)).select("key", "lat", "lon", *_AXES, "bound", "p.*")
        if frontier is not None:
            opened = opened.unionByName(frontier.select("key", "lat", "lon", *_AXES, "bound", *[F.col(f"c{a}").alias(f"p{a}") for a in _AXES]))
        children = opened.join(cubes.where(F.col("level") == level - 1).drop("level"), ["px", "py", "pz"])
        children = children.select("key", "lat", "lon", *_AXES, "cx", "cy", "cz", "bound", _nearest2().alias("near"), _farthest2().alias("far"))
        children = children.where(F.col("near") <= F.col("bound") * _ROOM)
        bound = F.least("bound", F.min("far").over(Window.partitionBy("key")))
        frontier = children.withColumn("bound", bound).where(F.col("near") <= F.col("bound") * _ROOM).drop("near", "far")
    if frontier is None:
        frontier = start
    dist = haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    met = frontier.select("key", "lat", "lon", "cx", "cy", "cz").join(where.select("cx", "cy", "cz", "r_lat", "r_lon", "v"), ["cx", "cy", "cz"])
    best = met.groupBy("key").agg(F.min(F.struct(dist.alias("dist"), "v")).alias("m"))
    return best.select(F.col("key").alias(key), "m.v.*", "m.dist")
