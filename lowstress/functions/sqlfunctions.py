"""The scalar functions for use in SQL text: Spark SQL functions that the optimiser inlines, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lowstress import lookups as L
from lowstress.functions import geo


def _case(of: str, table: dict, other: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _stress(table: dict) -> str:
    """The least level of the rows that a speed and a number of lanes fit; 4 if they fit none."""
    return "least(" + ", ".join(f"CASE WHEN speed <= {s} AND n <= {k} THEN {v} ELSE 4 END" for (s, k), v in table.items()) + ")"


FACILITY = """CASE WHEN highway = 'cycleway' OR cycleway = 'track' THEN 'protected_track'
  WHEN highway IN ('path', 'footway') AND bicycle = 'designated' THEN CASE WHEN segregated = 'yes' THEN 'protected_track' ELSE 'shared_path' END
  WHEN cycleway IN ('lane', 'opposite_lane') THEN 'cycle_lane' WHEN cycleway IN ('shared_lane', 'share_busway') THEN 'shared_roadway'
  WHEN bicycle IN ('designated', 'yes') AND highway IN ('residential', 'living_street', 'service') THEN 'shared_roadway' ELSE 'unknown' END"""
_BARE = "trim(replace(replace(lower(trim(coalesce(maxspeed, ''))), 'km/h', ''), 'kmh', ''))"
_NUMBER = f"""coalesce(try_cast(CASE WHEN contains({_BARE}, 'mph') THEN rint(try_cast(trim(replace({_BARE}, 'mph', '')) AS DOUBLE) * 1.60934D)
  WHEN try_cast({_BARE} AS DOUBLE) >= 0 THEN floor(try_cast({_BARE} AS DOUBLE)) ELSE ceil(try_cast({_BARE} AS DOUBLE)) END AS INT), 0)"""
SPEED = _case("lower(trim(coalesce(maxspeed, '')))", L.NAMED_SPEED, _NUMBER)
LANES = "coalesce(try_cast(try_cast(trim(lanes) AS DOUBLE) AS INT), 1)"


def definitions() -> dict[str, str]:
    """SQL text of each function, by name."""
    rad = "radians(lat2 - lat1) / 2", "radians(lon2 - lon1) / 2"
    a = f"(pow(sin({rad[0]}), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin({rad[1]}), 2))"
    px, py = f"((plon - alon) * {geo.LON_M}D * cos(radians(alat)))", f"((plat - alat) * {geo.LAT_M}D)"
    bx, by = f"((blon - alon) * {geo.LON_M}D * cos(radians(alat)))", f"((blat - alat) * {geo.LAT_M}D)"
    t = f"CASE WHEN {bx} * {bx} + {by} * {by} = 0 THEN 0D ELSE least(1D, greatest(0D, ({px} * {bx} + {py} * {by}) / ({bx} * {bx} + {by} * {by}))) END"
    return {
        "haversine_m": f"(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {geo.EARTH_M}D * 2 * atan2(sqrt{a}, sqrt(1 - {a}))",
        "point_segment_m": f"(plat DOUBLE, plon DOUBLE, alat DOUBLE, alon DOUBLE, blat DOUBLE, blon DOUBLE) RETURNS DOUBLE RETURN hypot({px} - ({t}) * {bx}, {py} - ({t}) * {by})",
        "facility_class": "(highway STRING, cycleway STRING, bicycle STRING, segregated STRING) RETURNS STRING RETURN " + FACILITY,
        "speed_kmh": "(maxspeed STRING) RETURNS INT RETURN " + SPEED,
        "lane_count": "(lanes STRING) RETURNS INT RETURN " + LANES,
        "stress_mixed": "(speed INT, n INT) RETURNS INT RETURN " + _stress(L.LTS_MIXED),
        "stress_painted": "(speed INT, n INT) RETURNS INT RETURN " + _stress(L.LTS_PAINTED),
        "segment_stress": f"""(highway STRING, maxspeed INT, n INT, facility STRING) RETURNS INT RETURN CASE WHEN facility IN ('protected_track', 'shared_path') THEN 1
          WHEN highway IN ({", ".join(f"'{x}'" for x in L.MOTOR_ONLY)}) THEN 4
          WHEN facility = 'cycle_lane' THEN stress_painted(CASE WHEN maxspeed > 0 THEN maxspeed ELSE {_case("highway", L.DEFAULT_SPEED, "50")} END, n)
          ELSE stress_mixed(CASE WHEN maxspeed > 0 THEN maxspeed ELSE {_case("highway", L.DEFAULT_SPEED, "50")} END, n) END""",
        "aadt_proxy": "(highway STRING) RETURNS STRING RETURN " + _case("highway", L.AADT_PROXY, "'unknown'"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session (temporary; existing ones of these names are replaced); returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
