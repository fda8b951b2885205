"""Nearest points at any distance, against a full search."""

import math
import random

import pytest

from lowstress.operators.pyramid import nearest_anywhere


def _far(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371000.0 * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def _check(spark, places, points):
    a = spark.createDataFrame(places, "id long, lat double, lon double").repartition(3)
    b = spark.createDataFrame(points, "ord long, r_lat double, r_lon double, name string").repartition(3)
    got = {r.id: r for r in nearest_anywhere(a, b, "id", ["ord"], ["name"]).collect()}
    whole = [p for p in points if p[1] is not None and p[2] is not None]
    wanted = [p for p in places if p[1] is not None and p[2] is not None and whole]
    assert sorted(got) == sorted(p[0] for p in wanted)
    for i, lat, lon in wanted:
        best = min((_far(lat, lon, y, x), o, n) for o, y, x, n in whole)
        assert abs(got[i].dist - best[0]) < 1e-6 and (got[i].ord, got[i].name) == best[1:], (i, best, got[i])


@pytest.mark.parametrize("seed, spread", [(1, "globe"), (2, "city"), (3, "clusters")])
def test_nearest_equals_a_full_search(spark, seed, spread):
    rnd = random.Random(seed)
    if spread == "globe":
        spot = lambda: (math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180))
    elif spread == "city":
        spot = lambda: (43 + rnd.random() / 20, -80 + rnd.random() / 20)
    else:
        centres = [(43.0, -80.0), (43.4, -80.3), (-17.0, 179.99), (-17.0, -179.99), (89.99, 12.0)]
        spot = lambda: (lambda c: (c[0] + rnd.gauss(0, 0.004), c[1] + rnd.gauss(0, 0.004)))(rnd.choice(centres))
    points = [(i, *spot(), f"n{i}") for i in range(150)]
    points += [(200 + i, *points[i][1:3], "same spot") for i in range(10)] + [(300, None, 1.0, "x"), (301, 1.0, None, "x")]
    places = [(i, *spot()) for i in range(120)] + [(500, *points[4][1:3]), (501, 0.0, 180.0), (502, 90.0, 0.0), (503, -90.0, 77.0), (504, 43.0, None), (505, 0.0, -180.0)]
    _check(spark, places, points)


def test_nearest_of_one_point_and_of_none(spark):
    _check(spark, [(1, 0.0, 0.0), (2, 0.0, 180.0), (3, 10.0, 10.0)], [(7, 10.0, 10.0, "only")])
    _check(spark, [(1, 0.0, 0.0)], [])
    _check(spark, [], [(7, 10.0, 10.0, "only")])
