"""Tag parsing and classification as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowstress import lookups as L


def lookup(value: Column, table: dict, default) -> Column:
    """A small table as a CASE expression."""
    whens = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), table.items(), F)
    return whens.otherwise(default if isinstance(default, Column) else F.lit(default))


def facility_class(highway: Column, cycleway: Column, bicycle: Column, segregated: Column, route: Column | None = None) -> Column:
    route = F.lit("") if route is None else route
    return (
        F.when(highway == "cycleway", "protected_track")
        .when(cycleway == "track", "protected_track")
        .when(highway.isin("path", "footway") & (bicycle == "designated"), F.when(segregated == "yes", "protected_track").otherwise("shared_path"))
        .when(cycleway.isin("lane", "opposite_lane"), "cycle_lane")
        .when(cycleway.isin("shared_lane", "share_busway"), "shared_roadway")
        .when(bicycle.isin("designated", "yes") & highway.isin("residential", "living_street", "service"), "shared_roadway")
        .when(route == "bicycle", "signed_route")
        .otherwise("unknown")
    )


def parse_speed(tag: Column) -> Column:
    """km/h of a maxspeed tag; 0 where it cannot be read."""
    t = F.trim(F.lower(F.coalesce(tag, F.lit(""))))
    bare = F.trim(F.replace(F.replace(t, F.lit("km/h"), F.lit("")), F.lit("kmh"), F.lit("")))
    mph = F.trim(F.replace(bare, F.lit("mph"), F.lit(""))).try_cast("double") * 1.60934
    plain = bare.try_cast("double")
    number = F.when(bare.contains("mph"), F.rint(mph)).otherwise(F.when(plain >= 0, F.floor(plain)).otherwise(F.ceil(plain)).cast("double"))
    return lookup(t, L.NAMED_SPEED, F.coalesce(number.cast("int"), F.lit(0)))


def parse_lanes(tag: Column) -> Column:
    return F.coalesce(F.trim(tag).try_cast("double").try_cast("int"), F.lit(1))


def aadt_proxy(highway: Column) -> Column:
    return lookup(highway, L.AADT_PROXY, "unknown")


def map_facility(raw: Column, table: dict[str, str], fallback: str) -> Column:
    """A source's facility value by its field map: exact, then by case-folded value; else the fallback."""
    folded = {k.lower(): v for k, v in table.items()}
    found = F.when(F.trim(raw) == "", F.lit(fallback)).otherwise(F.coalesce(lookup(raw, table, F.lit(None)), lookup(F.lower(raw), folded, F.lit(None)), F.lit(fallback)))
    found = F.coalesce(found, F.lit(fallback))
    return F.when(found.isin(*L.FACILITY_RANK), found).otherwise(F.lit(fallback))


def status_passes(status: Column, wanted: tuple[str, ...]) -> Column:
    return F.lit(True) if not wanted else F.coalesce(F.lower(F.trim(status)).isin(*[w.lower() for w in wanted]), F.lit(False))


def _table_lts(speed: Column, lanes: Column, table: dict) -> Column:
    fits = [F.when((speed <= s) & (lanes <= n), F.lit(v)).otherwise(F.lit(4)) for (s, n), v in table.items()]
    return F.least(*fits)


def used_speed(highway: Column, maxspeed: Column) -> Column:
    return F.when(maxspeed > 0, maxspeed).otherwise(lookup(highway, L.DEFAULT_SPEED, 50))


def segment_lts(highway: Column, maxspeed: Column, lanes: Column, cycleway: Column, facility: Column | None = None, parking: Column | None = None) -> Column:
    """Level of traffic stress 1 to 4 of a road segment."""
    fac = lookup(cycleway, L.CYCLEWAY_FACILITY, "none")
    fac = fac if facility is None else F.coalesce(F.nullif(facility, F.lit("")), fac)
    speed, parked = used_speed(highway, maxspeed), F.lit(False) if parking is None else parking
    return (
        F.when(fac.isin("protected_track", "shared_path"), 1)
        .when(highway.isin(*L.MOTOR_ONLY), 4)
        .when((fac == "cycle_lane") & ~parked, _table_lts(speed, lanes, L.LTS_PAINTED))
        .otherwise(_table_lts(speed, lanes, L.LTS_MIXED))
    )


def infer_facility(cycleway: Column) -> Column:
    return lookup(cycleway, L.CYCLEWAY_FACILITY, "unknown")


def priority_band(score: Column) -> Column:
    return F.when(score >= 66, "high").when(score >= 33, "medium").otherwise("low")


def facility_tags(facility: Column, name: Column) -> Column:
    """map<string, string>: tags of a way that would be classified as ``facility``; classes that nobody knows count as unknown."""
    plain = lambda tags: F.create_map(F.lit("name"), name, *[F.lit(x) for kv in tags.items() for x in kv])
    out = plain(L.FACILITY_TAGS["unknown"])
    for kind, tags in L.FACILITY_TAGS.items():
        out = F.when(facility == kind, plain(tags)).otherwise(out)
    return out


def better_facility(a: Column, b: Column) -> Column:
    """The one of higher rank; the first if both have the same."""
    return F.when(lookup(b, L.FACILITY_RANK, 0) > lookup(a, L.FACILITY_RANK, 0), b).otherwise(a)


def gap_label(start: Column, end: Column, arrow: bool = False) -> Column:
    """The streets at both ends in one text; one that is missing counts as empty."""
    return F.concat(F.coalesce(start, F.lit("")), F.lit(" \u2192 " if arrow else " "), F.coalesce(end, F.lit("")))


def to_float(text: Column) -> Column:
    """A number from CSV text; null for empty, infinite or other texts."""
    v = F.trim(text).try_cast("double")
    return F.when((F.abs(v) != float("inf")) & ~F.isnan(v), v)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the shifted double, as SQL engines round; ``F.round`` looks at the shortest decimal text (52.449999999999996 has one digit 52.4 there, 52.5 here)."""
    shift = float(10**digits)
    return F.round(x * shift, 0) / shift


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
