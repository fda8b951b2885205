"""Pieces of DuckDB text that the oracles share (written apart from the Column expressions they check)."""

from __future__ import annotations

from lowstress.fixtures import ctes
from lowstress.plans import sqlvalues as V


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(6371000.0::double * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def key(lat: str, lon: str) -> str:
    return f"(cast(floor({lat} * 1e5::double + 0.5::double) as bigint) * 100000000 + cast(floor({lon} * 1e5::double + 0.5::double) as bigint) + 18000000)"


def case(value: str, table: dict, default: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return f"case {value} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {default} end"


def cell(x: str, size: float) -> str:
    return f"cast(trunc(({x}) / {size!r}::double) as bigint)"


FACILITY = """case when highway = 'cycleway' or cycleway = 'track' then 'protected_track'
  when highway in ('path', 'footway') and bicycle = 'designated' then case when segregated = 'yes' then 'protected_track' else 'shared_path' end
  when cycleway in ('lane', 'opposite_lane') then 'cycle_lane' when cycleway in ('shared_lane', 'share_busway') then 'shared_roadway'
  when bicycle in ('designated', 'yes') and highway in ('residential', 'living_street', 'service') then 'shared_roadway' else 'unknown' end"""
SPEED = """case lower(trim(maxspeed)) when 'ca:urban' then 50 when 'ca:rural' then 80 when 'ca:motorway' then 100 when 'urban' then 50 when 'rural' then 80 else
  coalesce(case when lower(maxspeed) like '%mph%' then cast(round(try_cast(trim(replace(lower(maxspeed), 'mph', '')) as double) * 1.60934::double) as int)
  else cast(trunc(try_cast(trim(replace(replace(lower(maxspeed), 'km/h', ''), 'kmh', '')) as double)) as int) end, 0) end"""
LANES = "coalesce(cast(trunc(try_cast(trim(lanes) as double)) as int), 1)"


def lts(highway: str, speed: str, lanes: str, facility: str) -> str:
    used = f"(case when {speed} > 0 then {speed} else {case(highway, V.USUAL_SPEED, '50')} end)"
    row = lambda t: f"case when {lanes} <= 1 then {t[0]} when {lanes} <= 2 then {t[1]} when {lanes} <= 99 then {t[2]} else 4 end"
    table = lambda t: "(case " + " ".join(f"when {used} <= {s} then {row(x)}" for s, x in t.items()) + " else 4 end)"
    motor = ", ".join(f"'{x}'" for x in V.MOTOR_ONLY)
    return f"case when {facility} in ('protected_track', 'shared_path') then 1 when {highway} in ({motor}) then 4 when {facility} = 'cycle_lane' then {table(V.PAINTED)} else {table(V.MIXED)} end"


SEGS = f"""select way_id, seq, lat, lon, lat2, lon2, least({key('lat', 'lon')}, {key('lat2', 'lon2')}) as a, greatest({key('lat', 'lon')}, {key('lat2', 'lon2')}) as b,
  {hav('lat', 'lon', 'lat2', 'lon2')} as length_m
  from (select *, lead(lat) over w as lat2, lead(lon) over w as lon2 from fx_vertices window w as (partition by way_id order by seq)) where lat2 is not null"""
_EDGES = """select a, b, arg_min({{'way_id': way_id, 'facility': facility, 'length_m': length_m}}, (way_id, seq)) as e
  from segs join (select way_id, {facility} as facility from fx_ways where {which}) w using (way_id)
  where facility not in ('shared_roadway', 'signed_route', 'unknown') and a <> b group by a, b"""
_SIDE = "regexp_matches(cycleway_left, 'track|lane') or regexp_matches(cycleway_both, 'track|lane')"
#: Ways drawn for cycling, and road ways.
DRAWN = f"""(highway = 'cycleway' or (highway in ('path', 'footway') and (bicycle = 'designated' or (bicycle = 'yes' and foot <> 'designated')))
  or (highway in ('primary', 'secondary', 'tertiary') and (cycleway in ('track', 'lane', 'opposite_lane', 'shared_lane') or {_SIDE})))"""
ROAD = f"(highway in ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential', 'living_street', 'service') or cycleway in ('track', 'lane', 'opposite_lane', 'shared_lane') or {_SIDE})"
_CARRIES = "(cycleway in ('track', 'lane') or cycleway_left in ('track', 'lane') or cycleway_both in ('track', 'lane'))"
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "segs": (SEGS, ("fx_vertices",)),
    "cyc": ("select a, b, e.way_id, e.facility, e.length_m from (" + _EDGES.format(facility=FACILITY, which=DRAWN) + ")", ("segs",)),
    "attr": ("select a, b, e.way_id, e.facility, e.length_m from (" + _EDGES.format(facility=FACILITY, which=f"{ROAD} and {_CARRIES}") + ")", ("segs",)),
    "net": ("select *, 'way' as source from cyc union all select *, 'road_attribute' from attr where not exists (select 1 from cyc where cyc.a = attr.a and cyc.b = attr.b)", ("cyc", "attr")),
    "ends": ("select a as node, facility, length_m, a, b from net union all select b, facility, length_m, a, b from net", ("net",)),
    "nodes": ("select node, floor(node / 100000000)::double / 1e5::double as lat, ((node % 100000000) - 18000000)::double / 1e5::double as lon from (select distinct node from ends)", ("ends",)),
    "roads": (
        f"""select a, b, e.* from (select a, b, arg_max({{'way_id': way_id, 'length_m': length_m, 'highway': highway, 'maxspeed': maxspeed, 'lanes': lanes, 'name': name, 'junction': junction,
      'cycleway': cycleway, 'aadt_proxy': aadt_proxy, 'mid_lat': (la1 + la2) / 2, 'mid_lon': (lo1 + lo2) / 2, 'lat1': la1, 'lon1': lo1, 'lat2': la2, 'lon2': lo2}}, way_id) as e from (
      select way_id, least({key('la1', 'lo1')}, {key('la2', 'lo2')}) as a, greatest({key('la1', 'lo1')}, {key('la2', 'lo2')}) as b, length_m, highway, {SPEED} as maxspeed, {LANES} as lanes,
        name, junction, cycleway, {case('highway', V.TRAFFIC, "'unknown'")} as aadt_proxy, la1, lo1, la2, lo2
      from fx_ways join (select way_id, arg_min(lat, seq) as la1, arg_min(lon, seq) as lo1, arg_max(lat, seq) as la2, arg_max(lon, seq) as lo2 from fx_vertices group by way_id) using (way_id)
      join (select way_id, sum(length_m) as length_m from segs group by way_id) using (way_id)
      where {ROAD})
      where a <> b group by a, b)""",
        ("segs", "fx_ways"),
    ),
    "rounds": ("select w.way_id, arg_min(lat, seq) as la1, arg_min(lon, seq) as lo1, arg_max(lat, seq) as la2, arg_max(lon, seq) as lo2 from fx_vertices join (select way_id from fx_ways where junction = 'roundabout') w using (way_id) group by w.way_id", ("fx_vertices", "fx_ways")),
    "cc": (
        """select node, comp as component from cc_run""", ("cc_run",)),
    "cc_run": ("", ("net",)),
}
#: Minimum-label propagation with one row per node.
CC_RUN = """cc_run(node, comp) using key (node) as (
  select node, node as comp from nodes
  union
  select r.node, min(c.comp) from cc_run c join adj on adj.u = c.node join recurring.cc_run r on r.node = adj.v where c.comp < r.comp group by r.node)"""


def sql(body: str, *parts: str) -> str:
    """A statement that sees the named parts and all they need."""
    order: list[tuple[str, str]] = []

    def need(n: str) -> None:
        if n in dict(order):
            return
        if n.startswith("fx_"):
            order.extend(c for c in ctes(n) if c[0] not in dict(order))
            return
        if n == "cc_run":
            for m in ("net", "nodes"):
                need(m)
            order.append(("adj", "select a as u, b as v from net union all select b, a from net"))
            order.append((n, ""))
            return
        for m in PARTS[n][1]:
            need(m)
        if n == "roads" or n in ("cyc", "attr"):
            need("fx_ways")
        order.append((n, PARTS[n][0]))

    for p in parts:
        need(p)
    if not order:
        return body
    recursive = "recursive " if "cc_run" in dict(order) else ""
    return f"with {recursive}" + ",\n".join(CC_RUN if n == "cc_run" else f"{n} as ({t})" for n, t in order) + "\n" + body


_ROUND_ENDS = f"select {key('la1', 'lo1')} as a, {key('la2', 'lo2')} as b, la1, lo1, la2, lo2 from rounds"
#: Common tables up to ``circles``: clusters of touching roundabout ways (none of the fixture's is closed).
CIRCLE_PARTS = [
    f"round_ends as ({_ROUND_ENDS})",
    "round_nodes as (select node, min(lat) as lat, min(lon) as lon from (select a as node, la1 as lat, lo1 as lon from round_ends where a <> b union all select b, la2, lo2 from round_ends where a <> b) group by node)",
    "round_walk as (select node, node as seen from round_nodes union select w.node, case when e.a = w.seen then e.b else e.a end from round_walk w join round_ends e on e.a = w.seen or e.b = w.seen)",
    "round_of as (select node, min(seen) as cluster from round_walk group by node)",
    f"circles as (select cluster, clat as lat, clon as lon, greatest(12::double, max({hav('clat', 'clon', 'lat', 'lon')})) as radius from (select cluster, lat, lon, avg(lat) over (partition by cluster) as clat, avg(lon) over (partition by cluster) as clon from round_nodes join round_of using (node)) group by cluster, clat, clon)",
]


def circles_sql(body: str) -> str:
    """A statement that sees ``circles``."""
    text = sql("@@", "rounds").replace("\n@@", ",\n" + ",\n".join(CIRCLE_PARTS) + "\n" + body)
    return text.replace("with ", "with recursive ", 1)
