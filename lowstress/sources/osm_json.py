"""Saved Overpass JSON (``out body geom``): ways, road and cycling selections, destinations, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "elements array<struct<type string, id bigint, lat double, lon double, nodes array<bigint>, geometry array<struct<lat double, lon double>>, tags map<string,string>>>"
#: Bounding boxes (south, west, north, east) of named regions.
REGIONS = {
    "Waterloo Region": (43.37, -80.55, 43.60, -80.20), "City of Kitchener": (43.39, -80.53, 43.50, -80.38), "City of Waterloo": (43.44, -80.56, 43.55, -80.46),
    "City of Cambridge": (43.34, -80.40, 43.43, -80.25), "City of Vancouver": (49.195, -123.225, 49.320, -123.020), "Vancouver": (49.195, -123.225, 49.320, -123.020),
    "City of Victoria": (48.400, -123.440, 48.490, -123.310), "City of San Jose": (37.250, -122.020, 37.470, -121.830), "San Jose": (37.250, -122.020, 37.470, -121.830),
    "City of Toronto": (43.580, -79.640, 43.860, -79.120), "Toronto": (43.580, -79.640, 43.860, -79.120), "City of Ottawa": (45.250, -76.000, 45.530, -75.490),
    "Ottawa": (45.250, -76.000, 45.530, -75.490), "City of Calgary": (50.845, -114.270, 51.210, -113.860), "Calgary": (50.845, -114.270, 51.210, -113.860),
    "City of Edmonton": (53.390, -113.720, 53.700, -113.270),
}
TYPE_KEYS = ("amenity", "public_transport", "railway", "shop", "landuse", "leisure")


def region_box(name: str, lookup=None) -> tuple[float, float, float, float]:
    """The box of a known region, else what ``lookup(name)`` finds (a geocoder's answer, or None); ValueError if nobody knows it."""
    found = REGIONS.get(name) or (lookup(name) if lookup else None)
    if not found:
        raise ValueError(f"unknown region {name!r}: pass a bounding box")
    return tuple(found)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per element, in file order (``ord``)."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.posexplode("elements").alias("ord", "e")).select("ord", "e.*")


def ways(elements: DataFrame) -> DataFrame:
    """(way_id, ord, coords array<struct<lat, lon>>, tags): a way without geometry has no coordinates."""
    empty = F.array().cast("array<struct<lat:double,lon:double>>")
    return elements.where("type = 'way'").select(F.col("id").cast("string").alias("way_id"), "ord", F.coalesce("geometry", empty).alias("coords"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))


def _tag(key: str):
    return F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit(""))


def _any_side():
    """A track or lane on one side of the road or on both."""
    return _tag("cycleway:left").rlike("track|lane") | _tag("cycleway:right").rlike("track|lane") | _tag("cycleway:both").rlike("track|lane")


def select_cycling(w: DataFrame) -> DataFrame:
    hw, path = _tag("highway"), _tag("highway").rlike("path|footway")
    side = _tag("cycleway").rlike("track|lane|opposite_lane") | _any_side()
    return w.where((hw == "cycleway") | (path & (_tag("bicycle") == "designated")) | (path & (_tag("bicycle") == "yes") & (_tag("foot") != "designated") & F.col("tags").isNotNull()) | (hw.rlike("primary|secondary|tertiary") & side))


def select_roads(w: DataFrame) -> DataFrame:
    return w.where(_tag("highway").rlike("motorway|trunk|primary|secondary|tertiary|unclassified|residential|service|living_street") | _tag("cycleway").rlike("track|lane|opposite_lane|shared_lane") | _any_side())


KEYS = ("highway", "cycleway", "cycleway:left", "cycleway:right", "cycleway:both", "bicycle", "foot", "segregated", "route", "maxspeed", "lanes", "name", "junction")


def flat_tags(w: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Ways with one column per tag (missing: empty; a colon in its name becomes an underscore), as the network operators read them."""
    return w.select("way_id", "ord", "coords", *[_tag(k).alias(k.replace(":", "_")) for k in keys])


def vertices(w: DataFrame) -> DataFrame:
    return w.select("way_id", F.posexplode("coords").alias("seq", "p")).select("way_id", F.col("seq").cast("long"), "p.lat", "p.lon")


#: Fixed values: (element type, key, pattern found in the value) of places that create trips.
PLACES = (
    ("node", "amenity", "school|university|college|library|community_centre|hospital|clinic"), ("node", "public_transport", "station|stop_position"),
    ("node", "railway", "station|halt|tram_stop"), ("node", "shop", "^supermarket$"), ("way", "landuse", "commercial|industrial|retail|office"), ("way", "leisure", "^park$"),
)


def select_destinations(elements: DataFrame) -> DataFrame:
    """The elements that are places people travel to."""
    rule = F.lit(False)
    for kind, key, pattern in PLACES:
        rule = rule | ((F.col("type") == kind) & _tag(key).rlike(pattern))
    return elements.where(F.col("tags").isNotNull()).where(rule)


def destinations(elements: DataFrame) -> DataFrame:
    """(lat, lon, type, name): nodes where they are, ways at the mean of their vertices."""
    n = F.size("geometry")
    mean = lambda c: F.aggregate("geometry", F.lit(0.0), lambda s, p: s + p[c]) / n
    kind = F.coalesce(*[F.try_element_at("tags", F.lit(k)) for k in TYPE_KEYS], F.lit("unknown"))
    lat = F.when(F.col("type") == "node", F.col("lat")).when(n > 0, mean("lat"))
    lon = F.when(F.col("type") == "node", F.col("lon")).when(n > 0, mean("lon"))
    return elements.select(lat.alias("lat"), lon.alias("lon"), kind.alias("type"), _tag("name").alias("name")).where("lat is not null and lon is not null")
