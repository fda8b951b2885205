"""Queries over the projected network: parsing, edge tables, distance joins, components and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowstress.fixtures import view
from lowstress.functions import geo, tags
from lowstress.lookups import Thresholds
from lowstress.operators import network as N
from lowstress.operators import spatial as S
from lowstress.plans import sqlvalues as V
from lowstress.storage import materialize
from lowstress.plans.sqltext import DRAWN, FACILITY, LANES, SPEED, case, cell, circles_sql, hav, key, lts, sql

T = Thresholds()
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def r(c, d: int = 3):
    return F.round(c, d)


def ways(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_ways")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_vertices")


def net(spark: SparkSession, d: str) -> DataFrame:
    return N.network_edges(ways(spark, d), vertices(spark, d)).drop("drawn", "along")


def stored_net(spark: SparkSession, d: str) -> DataFrame:
    """The network as a stored table, for what reads it several times."""
    return materialize(net(spark, d), "net")


def roads(spark: SparkSession, d: str) -> DataFrame:
    return N.road_edges(ways(spark, d), vertices(spark, d))


@query("way_segments", sql("select way_id, seq, round(lat2, 9) as lat2, round(lon2, 9) as lon2, a, b, round(length_m, 3) as length_m from segs", "segs"))
def way_segments(spark, d):
    return N.segments(vertices(spark, d)).select("way_id", "seq", r(F.col("lat2"), 9).alias("lat2"), r(F.col("lon2"), 9).alias("lon2"), "a", "b", r(F.col("length_m")).alias("length_m"))


@query("node_keys", sql(f"select way_id, seq, {key('lat', 'lon')} as node from fx_vertices", "fx_vertices"))
def node_keys(spark, d):
    return vertices(spark, d).select("way_id", "seq", geo.node_key(F.col("lat"), F.col("lon")).alias("node"))


@query("way_length", sql("select way_id, round(sum(length_m), 3) as length_m from segs group by way_id", "segs"))
def way_length(spark, d):
    coords = vertices(spark, d).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("coords"))
    return coords.select("way_id", r(geo.polyline_length(F.col("coords"))).alias("length_m"))


@query("facility_class", sql(f"select way_id, {FACILITY} as facility from fx_ways", "fx_ways"))
def facility_class(spark, d):
    return N.with_facility(ways(spark, d)).select("way_id", "facility")


@query("parse_speed_lanes", sql(f"select way_id, {SPEED} as speed, {LANES} as lanes from fx_ways", "fx_ways"))
def parse_speed_lanes(spark, d):
    return ways(spark, d).select("way_id", tags.parse_speed(F.col("maxspeed")).alias("speed"), tags.parse_lanes(F.col("lanes")).alias("lanes"))


@query("aadt_proxy", sql(f"""select way_id, {case('highway', V.TRAFFIC, "'unknown'")} as aadt_proxy from fx_ways""", "fx_ways"))
def aadt_proxy(spark, d):
    return ways(spark, d).select("way_id", tags.aadt_proxy(F.col("highway")).alias("aadt_proxy"))


FIELD_MAP = {"Multi-Use Path": "protected_track", "Bike Lane": "cycle_lane", "Shared Path": "shared_path", "Sharrow": "shared_roadway"}


@query(
    "facility_map",
    sql("""select feature_id, case lower(fac_type) when 'multi-use path' then 'protected_track' when 'bike lane' then 'cycle_lane' when 'shared path' then 'shared_path' when 'sharrow' then 'shared_roadway' else 'unknown' end as facility,
      coalesce(lower(trim(status)) in ('existing', 'built'), false) as kept from fx_features""", "fx_features"),
)
def facility_map(spark, d):
    f = view(spark, d, "fx_features")
    return f.select("feature_id", tags.map_facility(F.col("fac_type"), FIELD_MAP, "unknown").alias("facility"), tags.status_passes(F.col("status"), ("existing", "built")).alias("kept"))


_ROAD_COLS = ["a", "b", "way_id", "highway", "maxspeed", "lanes", "name", "junction", "cycleway", "aadt_proxy"]


@query("road_edges", sql(f"select {', '.join(_ROAD_COLS)}, round(length_m, 3) as length_m from roads", "roads"))
def road_edges(spark, d):
    return roads(spark, d).select(*_ROAD_COLS, r(F.col("length_m")).alias("length_m"))


def _edge_query(name: str, part: str, build) -> None:
    extra = ", source" if part == "net" else ""
    cols = ["a", "b", "way_id", "facility"] + (["source"] if part == "net" else [])
    query(name, sql(f"select a, b, way_id, facility{extra}, round(length_m, 3) as length_m from {part}", part))(lambda s, d: build(s, d).select(*cols, r(F.col("length_m")).alias("length_m")))


_edge_query("cycling_edges", "cyc", lambda s, d: N.cycling_edges(ways(s, d), vertices(s, d)))
_edge_query("road_attr_edges", "attr", lambda s, d: N.road_attribute_edges(ways(s, d), vertices(s, d)))
_edge_query("merged_edges", "net", net)


def with_lts(edges: DataFrame) -> DataFrame:
    return edges.withColumn("lts", tags.segment_lts(F.col("highway"), F.col("maxspeed"), F.col("lanes"), F.col("cycleway")))


_FAC = case("cycleway", V.CYCLEWAY_FACILITY, "'none'")


@query("segment_lts", sql(f"select a, b, way_id, {lts('highway', 'maxspeed', 'lanes', f'({_FAC})')} as lts from roads", "roads"))
def segment_lts(spark, d):
    return with_lts(roads(spark, d)).select("a", "b", "way_id", "lts")


@query(
    "lts_by_street",
    sql(f"""select name, count(*) as edges, round(sum(length_m), 3) as length_m, round(sum(lts * length_m) / sum(length_m), 6) as mean_lts, max(lts) as worst_lts,
      round(sum(case when lts >= 3 then length_m else 0 end) / sum(length_m), 6) as stressful from (select *, {lts('highway', 'maxspeed', 'lanes', f'({_FAC})')} as lts from roads) where name <> '' group by name""", "roads"),
)
def lts_by_street(spark, d):
    e = with_lts(roads(spark, d)).where("name <> ''")
    n = F.sum("length_m")
    return e.groupBy("name").agg(
        F.count("*").alias("edges"), r(n).alias("length_m"), r(F.sum(F.col("lts") * F.col("length_m")) / n, 6).alias("mean_lts"), F.max("lts").alias("worst_lts"),
        r(F.sum(F.when(F.col("lts") >= 3, F.col("length_m")).otherwise(0.0)) / n, 6).alias("stressful"),
    )


@query(
    "corridor_streets",
    sql("""select name, count(*) as edges, round(sum(length_m), 3) as total_m, round(sum(case when cycleway in ('track', 'lane') then length_m else 0 end), 3) as cycled_m from roads where name <> ''
      group by name having count(*) >= 3 and sum(case when cycleway in ('track', 'lane') then length_m else 0 end) / sum(length_m) >= 0.30""", "roads"),
)
def corridor_streets(spark, d):
    cycled = F.sum(F.when(F.col("cycleway").isin("track", "lane"), F.col("length_m")).otherwise(0.0))
    g = roads(spark, d).where("name <> ''").groupBy("name").agg(F.count("*").alias("edges"), F.sum("length_m").alias("t"), cycled.alias("c"))
    return g.where("edges >= 3 and c / t >= 0.30").select("name", "edges", r(F.col("t")).alias("total_m"), r(F.col("c")).alias("cycled_m"))


@query("node_degree", sql("select node, count(*) as degree from ends group by node", "ends"))
def node_degree(spark, d):
    return N.degrees(net(spark, d))


@query(
    "endpoint_facility",
    sql("""select node, case max(case facility when 'protected_track' then 3 when 'shared_path' then 2 when 'cycle_lane' then 1 else 0 end)
      when 3 then 'protected_track' when 2 then 'shared_path' when 1 then 'cycle_lane' else 'unknown' end as facility from ends group by node""", "ends"),
)
def endpoint_facility(spark, d):
    return N.endpoint_facility(net(spark, d))


@query(
    "facility_terminus",
    sql("""select * from (select node, count(*) as degree, count_if(q) as qualifying, count(distinct case when q then facility end) as kinds
      from (select *, facility in ('protected_track', 'shared_path', 'cycle_lane') as q from ends) group by node)
      where qualifying > 0 and (degree = 1 or (qualifying = 1 and degree >= 2) or kinds >= 2)""", "ends"),
)
def facility_terminus(spark, d):
    return N.facility_termini(net(spark, d))


_SNAP = 15 / 111000
_NEAR = "abs({0}.r - {1}.r) <= 1 and abs({0}.c - {1}.c) <= 1"
_SNAP_SQL = f"""select a, b, dist from (select p.node as a, q.node as b, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} as dist
  from (select *, {cell('lat', _SNAP)} as r, {cell('lon', _SNAP)} as c, unnest([-1, 0, 1]) as dr from nodes) p join (select *, {cell('lat', _SNAP)} as r, {cell('lon', _SNAP)} as c from nodes) q
  on q.r = p.r + p.dr and abs(p.c - q.c) <= 1 and p.node < q.node) where dist <= 15"""


@query("snap_pairs", sql(f"select a, b, round(dist, 3) as dist from ({_SNAP_SQL})", "nodes"))
def snap_pairs(spark, d):
    return N.snap_pairs(stored_net(spark, d), T.snap).select("a", "b", r(F.col("dist")).alias("dist"))


@query("snapped_edges", sql(f"""select a, b, e.way_id as way_id, e.facility as facility, round(e.length_m, 3) as length_m from (
  select a, b, arg_max({{'way_id': way_id, 'facility': facility, 'length_m': length_m}}, (way_id, length_m, facility)) as e from (
    select least(x, y) as a, greatest(x, y) as b, way_id, facility, length_m from (
      select coalesce(s.comp, net.a) as x, coalesce(t.comp, net.b) as y, way_id, facility, length_m from net left join cc_run s on s.node = net.a left join cc_run t on t.node = net.b))
  where a <> b group by a, b)""", "nodes", "cc_run").replace("adj as (select a as u, b as v from net union all select b, a from net)", f"sp as ({_SNAP_SQL}), adj as (select a as u, b as v from sp union all select b, a from sp)"))  # fmt: skip
def snapped_edges(spark, d):
    return N.snapped_edges(net(spark, d).drop("source"), T.snap).select("a", "b", "way_id", "facility", r(F.col("length_m")).alias("length_m"))


@query("components", sql("select node, component from cc", "cc"))
def components(spark, d):
    return N.components(stored_net(spark, d))


_STATS = "(select component, count(*) as size, any_value(len) as length_m, row_number() over (order by count(*) desc, component) - 1 as rank from cc join (select component, sum(length_m) as len from net join cc on cc.node = net.a group by component) using (component) group by component)"


@query("component_length", sql(f"select component, size, round(length_m, 3) as length_m, rank from {_STATS}", "cc"))
def component_length(spark, d):
    e = stored_net(spark, d)
    return N.component_stats(e, N.components(e)).withColumn("length_m", r(F.col("length_m")))


@query("grid_cells", sql(f"select way_id, seq, {cell('lat', 300 / 111000)} as r, {cell('lon', 300 / 111000)} as c from fx_vertices", "fx_vertices"))
def grid_cells(spark, d):
    return vertices(spark, d).select("way_id", "seq", geo.cell(F.col("lat"), 300 / 111000).alias("r"), geo.cell(F.col("lon"), 300 / 111000).alias("c"))


_EC = 25 / 111000


@query(
    "edge_cells",
    sql(f"""select distinct way_id, {cell('lat1 + (lat2 - lat1) * i / steps', _EC)} as r, {cell('lon1 + (lon2 - lon1) * i / steps', _EC)} as c from (
      select *, unnest(range(0, steps + 1)) as i from (select *, greatest(1, cast(ceil(greatest(abs(lat2 - lat1), abs(lon2 - lon1)) / {_EC!r}::double * 2) as int)) as steps from roads))""", "roads"),
)
def edge_cells(spark, d):
    e = roads(spark, d).select("way_id", F.explode(geo.segment_cells(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), _EC)).alias("k"))
    return e.select("way_id", "k.r", "k.c")


@query("bbox", sql("select round(min(lat) - 0.005, 6) as south, round(min(lon) - 0.005, 6) as west, round(max(lat) + 0.005, 6) as north, round(max(lon) + 0.005, 6) as east from fx_vertices", "fx_vertices"))
def bbox(spark, d):
    return vertices(spark, d).agg(
        r(F.min("lat") - 0.005, 6).alias("south"), r(F.min("lon") - 0.005, 6).alias("west"), r(F.max("lat") + 0.005, 6).alias("north"), r(F.max("lon") + 0.005, 6).alias("east")
    )


@query("bbox_ways", sql(f"select way_id, {FACILITY} as facility, length_m from fx_ways join (select way_id, round(sum(length_m), 3) as length_m from segs group by way_id) using (way_id) where way_id in (select way_id from fx_vertices where lat between 43.01 and 43.03 and lon between -80.58 and -80.54)", "segs", "fx_ways"))
def bbox_ways(spark, d):
    v = vertices(spark, d)
    inside = v.where(geo.in_bbox(F.col("lat"), F.col("lon"), 43.01, -80.58, 43.03, -80.54)).select("way_id").distinct()
    length = N.segments(v).groupBy("way_id").agg(r(F.sum("length_m")).alias("length_m"))
    return N.with_facility(ways(spark, d)).join(inside, "way_id", "left_semi").join(length, "way_id").select("way_id", "facility", "length_m")


@query(
    "roundabouts",
    circles_sql("select cluster, round(lat, 6) as lat, round(lon, 6) as lon, round(radius, 3) as radius from circles"),
)
def roundabouts(spark, d):
    from lowstress.operators.refine import roundabout_circles

    return roundabout_circles(ways(spark, d), vertices(spark, d)).select("cluster", r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"), r(F.col("radius")).alias("radius"))


# --- detectors --------------------------------------------------------------------------------------

_CN = "(select node, lat, lon, component, ef.facility from nodes join cc using (node) join ef using (node))"
_EF = "(select node, case max(case facility when 'protected_track' then 3 when 'shared_path' then 2 when 'cycle_lane' then 1 else 0 end) when 3 then 'protected_track' when 2 then 'shared_path' when 1 then 'cycle_lane' else 'unknown' end as facility from ends group by node)"


def _pairs_sql(radius: float, least: str, cond: str) -> str:
    """Ordered pairs of the nodes table cn within a radius, in neighbouring square-degree cells."""
    size = radius / 111000
    return f"""(select p.node, q.node as r_node, p.component, q.component as r_component, p.facility, q.facility as r_facility, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} as dist
      from (select *, {cell('lat', size)} as r, {cell('lon', size)} as c, unnest([-1, 0, 1]) as dr from cn) p join (select *, {cell('lat', size)} as r, {cell('lon', size)} as c from cn) q
      on q.r = p.r + p.dr and abs(p.c - q.c) <= 1 and {cond} where {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} between {least} and {radius})"""


def _with(body: str, *more: str) -> str:
    text = sql("@@", "cc", "ends", "nodes", *more)
    return text.replace("\n@@", f",\nef as {_EF},\ncn as {_CN},\nstats as {_STATS}\n{body}")


@query(
    "dangling_gaps_raw",
    _with(f"""select node, r_node, facility, r_facility, round(dist, 3) as dist from (select *, row_number() over (partition by node order by dist, r_node) as rn from {_pairs_sql(400, '30.0000001', 'p.component <> q.component')}
      where r_facility <> 'unknown' and node in (select node from ends group by node having count(*) = 1) and component in (select component from stats where length_m >= 50)
      and not exists (select 1 from roads where roads.a = least(node, r_node) and roads.b = greatest(node, r_node))) where rn = 1""", "roads"),
)
def dangling_gaps_raw(spark, d):
    from lowstress.operators.detect import dangling_pairs

    return dangling_pairs(net(spark, d), roads(spark, d)).select("node", "r_node", "facility", "r_facility", r(F.col("dist")).alias("dist"))


@query(
    "near_miss_pairs",
    _with(f"""select c1, c2, node, r_node, round(dist, 3) as dist from (select component as c1, r_component as c2, node, r_node, dist, row_number() over (partition by component, r_component order by dist, node, r_node) as rn
      from {_pairs_sql(300, '30', 'p.component < q.component')}) where rn = 1"""),
)
def near_miss_pairs(spark, d):
    from lowstress.operators.detect import near_miss

    return near_miss(net(spark, d)).select("c1", "c2", "node", "r_node", r(F.col("dist")).alias("dist"))


_ISLANDS = f"""isl as (select n.*, s.size from cn n join stats s using (component) where s.rank > 0 and s.length_m >= 250),
mainn as (select n.node, n.lat, n.lon, n.facility from cn n join stats s using (component) where s.rank = 0),
ipairs as (select i.component, i.size, i.node, m.node as r_node, i.facility, m.facility as r_facility, {hav('i.lat', 'i.lon', 'm.lat', 'm.lon')} as dist,
  abs({cell('i.lat', 600 / 111000)} - {cell('m.lat', 600 / 111000)}) <= 1 and abs({cell('i.lon', 600 / 111000)} - {cell('m.lon', 600 / 111000)}) <= 1 as close
  from isl i join mainn m on m.lat between i.lat - 0.04 and i.lat + 0.04),
ibest as (select *, row_number() over (partition by component order by close desc, dist, node, r_node) as rn from ipairs where close or dist <= 3000),
islands as (select component, size, node, r_node, dist from ibest where rn = 1 and dist <= case when size >= 10 then 3000 when size >= 5 then 1500 else 900 end and facility <> 'unknown' and r_facility <> 'unknown')"""


def _islands(body: str) -> str:
    return _with("@body").replace("\n@body", f",\n{_ISLANDS}\n{body}")


@query("island_gaps", _islands("select component, size, node, r_node, round(dist, 3) as dist from islands"))
def island_gaps(spark, d):
    from lowstress.operators.detect import island_pairs

    return island_pairs(net(spark, d)).select("component", "size", "node", "r_node", r(F.col("dist")).alias("dist"))


@query("islands_by_anchor", _islands("select r_node, arg_min(component, (dist, component)) as component, cast(sum(size) as bigint) as size, round(min(dist), 3) as dist from islands group by r_node"))
def islands_by_anchor(spark, d):
    from lowstress.operators.detect import by_anchor, island_pairs

    return by_anchor(island_pairs(net(spark, d))).select("r_node", "component", F.col("size").cast("long").alias("size"), r(F.col("dist")).alias("dist"))


@query(
    "connector_gaps",
    _with(f"""select node, r_node, round(dist, 3) as dist, case when dist <= 150 then 'quick_win' else 'network_link' end as connector_class from (select *, row_number() over (partition by node order by dist, r_node) as rn
      from {_pairs_sql(500, '30.0000001', 'p.component <> q.component')} where r_facility <> 'unknown' and component in (select component from stats where length_m >= 50)
      and node in (select node from (select node, count(*) as degree, count_if(q) as qualifying, count(distinct case when q then facility end) as kinds
        from (select *, facility in ('protected_track', 'shared_path', 'cycle_lane') as q from ends) group by node) where qualifying > 0 and (degree = 1 or (qualifying = 1 and degree >= 2) or kinds >= 2))
      and not exists (select 1 from roads where roads.a = least(node, r_node) and roads.b = greatest(node, r_node))) where rn = 1""", "roads"),
)
def connector_gaps(spark, d):
    from lowstress.operators.detect import connector_pairs

    return connector_pairs(net(spark, d), roads(spark, d)).select("node", "r_node", r(F.col("dist")).alias("dist"), "connector_class")


@query(
    "dangling_capped",
    _with("""select node, component from (select node, component, row_number() over (order by size desc, component, node) as rn from cn join stats using (component) where node in (select node from ends group by node having count(*) = 1)) where rn <= 500"""),
)
def dangling_capped(spark, d):
    """The 500 dead ends of the largest components: the cap is the feature."""
    from lowstress.operators.detect import cap_anchors, prepare

    p = prepare(net(spark, d))
    ends = p.nodes.join(p.degrees.where("degree = 1").select("node"), "node", "left_semi")
    return cap_anchors(ends, p.stats).select("node", "component")


@query("mutual_dangling", _with(f"""select x.node, x.r_node, round(x.dist, 3) as dist from d500 x where not exists (select 1 from d500 y where y.node = x.r_node and y.r_node = x.node and y.node < x.node)""").replace("\nselect x.node", f""",
d500 as (select node, r_node, dist from (select *, row_number() over (partition by node order by dist, r_node) as rn from {_pairs_sql(400, '30.0000001', 'p.component <> q.component')}
  where r_facility <> 'unknown' and node in (select node from ends group by node having count(*) = 1) and component in (select component from stats where length_m >= 50)) where rn = 1)\nselect x.node"""))  # fmt: skip
def mutual_dangling(spark, d):
    from lowstress.operators.detect import dangling_pairs, mutual_once

    return mutual_once(dangling_pairs(net(spark, d))).select("node", "r_node", r(F.col("dist")).alias("dist"))


@query("component_bounds", _with("select component, round(min(lat), 6) as south, round(min(lon), 6) as west, round(max(lat), 6) as north, round(max(lon), 6) as east, round(avg(lat), 10) as lat, round(avg(lon), 10) as lon from cn group by component"))
def component_bounds(spark, d):
    e = stored_net(spark, d)
    out = N.component_bounds(e, N.components(e))
    return out.select("component", *[r(F.col(c), 6).alias(c) for c in ("south", "west", "north", "east")], r(F.col("lat"), 10).alias("lat"), r(F.col("lon"), 10).alias("lon"))


@query(
    "incident_facility",
    sql("""select node, case max(case facility when 'protected_track' then 31 when 'shared_path' then 30 when 'cycle_lane' then 20 when 'shared_roadway' then 10 when 'signed_route' then 10 else 0 end)
      when 31 then 'protected_track' when 30 then 'shared_path' when 20 then 'cycle_lane' end as facility from ends group by node""", "ends"),
)
def incident_facility(spark, d):
    from lowstress.operators.clean import incident_facility as f

    return f(net(spark, d))


@query(
    "facility_tags",
    sql(f"""select way_id, case f when 'protected_track' then 'cycleway' when 'cycle_lane' then 'secondary' when 'shared_path' then 'path' when 'shared_roadway' then 'residential' when 'signed_route' then null else 'path' end as highway,
      case f when 'protected_track' then 'designated' when 'shared_path' then 'designated' when 'shared_roadway' then 'yes' when 'unknown' then 'yes' end as bicycle, name
      from (select *, {FACILITY} as f from fx_ways)""", "fx_ways"),
)
def facility_tags(spark, d):
    m = tags.facility_tags(F.col("facility"), F.col("name"))
    return N.with_facility(ways(spark, d)).withColumn("m", m).select("way_id", F.col("m")["highway"].alias("highway"), F.col("m")["bicycle"].alias("bicycle"), F.col("m")["name"].alias("name"))


@query(
    "sql_functions",
    sql(f"""select way_id, {FACILITY} as facility, {SPEED} as speed, {LANES} as lanes, {case('highway', V.TRAFFIC, "'unknown'")} as aadt, {lts('highway', SPEED, LANES, FACILITY)} as stress, round({hav('lat0', 'lon0', 'lat1', 'lon1')}, 3) as length_m from fx_ways""", "fx_ways"),
)
def sql_functions(spark, d):
    """The scalar functions through SQL text (temporary functions of the session)."""
    from lowstress.functions.sqlfunctions import register

    register(spark)
    return spark.sql(
        """select way_id, facility_class(highway, cycleway, bicycle, segregated) as facility, speed_kmh(maxspeed) as speed, lane_count(lanes) as lanes, aadt_proxy(highway) as aadt,
        segment_stress(highway, speed_kmh(maxspeed), lane_count(lanes), facility_class(highway, cycleway, bicycle, segregated)) as stress, round(haversine_m(lat0, lon0, lat1, lon1), 3) as length_m from {w}""",
        w=ways(spark, d),
    )


@query("display_layer", sql("select way_id, highway, cycleway from fx_ways where " + DRAWN + " or cycleway in ('track', 'lane', 'opposite_lane')", "fx_ways"))
def display_layer(spark, d):
    from lowstress.sources.sinks import display_ways

    w = ways(spark, d)
    drawn = N.is_cycling_way(w)
    return display_ways(w.where(drawn), w.where(~drawn & N.is_road_way(w))).select("way_id", "highway", "cycleway")


__all__ = ["DataFrame", "ORACLES", "QUERIES", "S", "SparkSession"]
