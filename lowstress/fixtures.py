"""A bicycle network projected from the driver's tables: the same SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lowstress.storage import parts

FX = {}
FX["fx_ways"] = """
select way_id, name, highway, cycleway, cycleway_left, cycleway_both, bicycle, foot, segregated, maxspeed, lanes, junction, horiz, tile,
  lat0, lon0,
  lat0 + (case when way_id % 17 = 0 then cast(0.6 as double) else cast(1.0 as double) end) * (tlat - lat0) as lat1,
  lon0 + (case when way_id % 17 = 0 then cast(0.6 as double) else cast(1.0 as double) end) * (tlon - lon0) as lon1
from (
select way_id, tile, horiz,
  cast(43.0 as double) + tile * cast(0.25 as double) + gy * cast(0.0020 as double) + (ck % 3) * cast(0.00003 as double) as lat0,
  cast(-80.6 as double) + gx * cast(0.0027 as double) + (ck % 3) * cast(0.00003 as double) as lon0,
  cast(43.0 as double) + tile * cast(0.25 as double) + (gy + 1 - horiz) * cast(0.0020 as double) + (ck % 2) * cast(0.00003 as double) as tlat,
  cast(-80.6 as double) + (gx + horiz) * cast(0.0027 as double) + (ck % 2) * cast(0.00003 as double) as tlon,
  case when pct >= 92 then '' when horiz = 1 then concat('Street ', tile, '-', gy) else concat('Avenue ', tile, '-', gx) end as name,
  case when pct < 14 then 'cycleway' when pct < 18 then 'path' when pct < 20 then 'footway' when pct < 32 then 'primary' when pct < 52 then 'secondary'
       when pct < 66 then 'tertiary' when pct < 67 then 'motorway' when pct < 92 then 'residential' else 'service' end as highway,
  case when pct < 20 then '' when pct < 26 then 'track' when pct < 44 then 'lane' when pct < 47 then 'shared_lane' when pct < 49 then 'opposite_lane' when pct in (72, 73) then 'lane' else '' end as cycleway,
  case when pct in (48, 70) then 'lane' when pct = 30 then 'no' else '' end as cycleway_left,
  case when pct in (60, 88) then 'track' else '' end as cycleway_both,
  case when pct in (15, 16) then 'designated' else '' end as foot,
  case when pct in (16, 17) then 'yes' when pct >= 14 and pct < 20 then 'designated' when pct >= 88 then 'yes' else '' end as bicycle,
  case when pct = 14 then 'yes' else '' end as segregated,
  case way_id % 6 when 0 then '50' when 1 then '60 km/h' when 2 then '30 mph' when 3 then 'CA:urban' when 4 then 'signals' else '' end as maxspeed,
  case way_id % 5 when 0 then '2' when 1 then '4' when 2 then '1' when 3 then '' else '2;3' end as lanes,
  case when way_id % 397 = 5 then 'roundabout' else '' end as junction
from (
  select o_orderkey as way_id, o_custkey as ck,
    cast(floor(o_orderkey / 4096) as bigint) as tile,
    (o_orderkey * 31 + o_custkey * 17) % 100 as pct,
    case when (o_orderkey * 7919 + o_custkey * 104729) % 3120 < 1560 then 1 else 0 end as horiz,
    case when (o_orderkey * 7919 + o_custkey * 104729) % 3120 < 1560
         then ((o_orderkey * 7919 + o_custkey * 104729) % 3120) % 39
         else (((o_orderkey * 7919 + o_custkey * 104729) % 3120) - 1560) % 40 end as gx,
    case when (o_orderkey * 7919 + o_custkey * 104729) % 3120 < 1560
         then cast(floor(((o_orderkey * 7919 + o_custkey * 104729) % 3120) / 39) as bigint)
         else cast(floor((((o_orderkey * 7919 + o_custkey * 104729) % 3120) - 1560) / 40) as bigint) end as gy
  from orders) b ) c"""
FX["fx_vertices"] = """
select w.way_id, v.seq,
  w.lat0 + (w.lat1 - w.lat0) * v.f + v.jit * cast(0.00001 as double) * w.horiz as lat,
  w.lon0 + (w.lon1 - w.lon0) * v.f + v.jit * cast(0.00001 as double) * (1 - w.horiz) as lon
from fx_ways w join (
  select o_orderkey as way_id, cast(0 as bigint) as seq, cast(0 as double) as f, cast(0 as bigint) as jit from orders
  union all
  select l_orderkey, rn, cast(rn as double) / (n + 1), l_partkey % 5 - 2 from (
    select l_orderkey, l_partkey,
      row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn,
      count(*) over (partition by l_orderkey) as n from lineitem) t
  union all
  select o_orderkey, cast(1000 as bigint), cast(1 as double), cast(0 as bigint) from orders
) v on w.way_id = v.way_id"""
FX["fx_destinations"] = """
select c_custkey as dest_id, c_name as name,
  case c_mktsegment when 'MACHINERY' then 'industrial' when 'FURNITURE' then 'supermarket' when 'BUILDING' then 'school' when 'AUTOMOBILE' then 'station' else 'park' end as type,
  cast(43.0 as double) + cast(floor(c_custkey / 410) as bigint) * cast(0.25 as double) + (c_custkey * 37 % 800) * cast(0.0001 as double) as lat,
  cast(-80.6 as double) + (c_custkey * 53 % 1000) * cast(0.000108 as double) as lon
from customer"""
FX["fx_da"] = """
select s_suppkey as da_id, cast(1 + s_suppkey % 5 as int) as quintile,
  cast(43.0 as double) + cast(floor(s_suppkey / 28) as bigint) * cast(0.25 as double) + (s_suppkey * 7 % 27) * cast(0.003 as double) as lat,
  cast(-80.6 as double) + (s_suppkey * 11 % 27) * cast(0.004 as double) as lon
from supplier"""
FX["fx_plan"] = """
select n_nationkey as feature_ord, n_name as name, p as pt,
  cast(43.0 as double) + (n_nationkey % 5) * cast(0.016 as double) + p * cast(0.001 as double) as lat,
  cast(-80.6 as double) + cast(floor(n_nationkey / 5) as int) * cast(0.02 as double) + p * cast(0.0015 as double) as lon
from nation cross join (select 0 as p union all select 1 union all select 2) q"""
FX["fx_features"] = """
select p_partkey as feature_id, p_name as name,
  case p_type when 'ECONOMY' then 'Multi-Use Path' when 'STANDARD' then 'bike lane' when 'LARGE' then 'Shared Path' when 'SMALL' then 'Sharrow' when 'PROMO' then 'Mystery' else '' end as fac_type,
  case p_partkey % 4 when 0 then 'Existing' when 1 then 'BUILT' when 2 then 'Planned' else null end as status,
  cast(p_size as double) * cast(0.00002 as double) as dlat
from part"""
FX["fx_decisions"] = """
select concat('GAP-', lpad(cast(user_id % 120 + 1 as varchar(9)), 3, '0')) as gap_id,
  case event_type when 'signup' then 'Already connected' when 'error' then 'Data error' when 'click' then 'Parallel facility' when 'view' then 'Same corridor (fragmentation)' else 'Not feasible' end as reason,
  ts, event_id
from events"""
#: Gaps with everything that refinement and scoring read, one per customer.
FX["fx_gaps"] = """
select c_custkey as ord, concat('GAP-', cast(c_custkey as varchar(12))) as gap_id,
  case c_custkey % 5 when 0 then 'island' when 1 then 'detour' when 2 then 'dangling' when 3 then 'corridor' else 'connector' end as gap_type,
  lat as start_lat, lon as start_lon,
  lat + (c_custkey % 13) * cast(0.0003 as double) as end_lat, lon + (c_custkey % 7) * cast(0.0004 as double) + cast(0.0002 as double) as end_lon,
  case c_custkey % 6 when 0 then 'protected_track' when 1 then 'cycle_lane' when 2 then 'shared_path' when 3 then 'shared_roadway' when 4 then 'signed_route' else 'unknown' end as start_facility,
  case c_custkey % 4 when 0 then 'protected_track' when 1 then 'cycle_lane' when 2 then 'shared_path' else 'unknown' end as end_facility,
  c_custkey % 11 = 0 as crosses_barrier,
  cast(c_custkey % 90 + 2 as bigint) as component_size,
  cast(2 as double) + (c_custkey % 37) * cast(0.1 as double) as detour_factor,
  case when c_custkey % 8 = 0 then null when c_custkey % 8 = 1 then cast('Infinity' as double) else cast(1 as double) + (c_custkey % 29) * cast(0.125 as double) end as separation_ratio,
  case when c_custkey % 4 = 1 then 'quick_win' when c_custkey % 4 = 3 then 'network_link' end as connector_class,
  case when c_custkey % 9 = 0 then null when c_custkey % 9 < 3 then 'residential' when c_custkey % 9 < 5 then 'tertiary' when c_custkey % 9 = 5 then 'secondary' when c_custkey % 9 = 6 then 'primary' when c_custkey % 9 = 7 then 'motorway' else 'service' end as road_highway,
  case when c_custkey % 9 = 0 then null else cast(c_custkey % 4 * 20 as int) end as road_maxspeed,
  case when c_custkey % 9 = 0 then null else cast(c_custkey % 3 + 1 as int) end as road_lanes,
  c_custkey % 10 = 3 as plan_match
from (select c_custkey,
  cast(43.0 as double) + cast(floor(c_custkey / 410) as bigint) * cast(0.25 as double) + (c_custkey * 41 % 790) * cast(0.0001 as double) as lat,
  cast(-80.6 as double) + (c_custkey * 59 % 990) * cast(0.000108 as double) as lon
from customer) c"""
BASE = {
    "fx_ways": ["orders"], "fx_vertices": ["orders", "lineitem", "fx_ways"], "fx_destinations": ["customer"], "fx_da": ["supplier"], "fx_plan": ["nation"],
    "fx_features": ["part"], "fx_decisions": ["events"], "fx_gaps": ["customer"],
}


#: Columns by which the tables of a view are dealt: all that it does with them then needs no other shuffle of the larger ones.
DEALT = {"fx_vertices": {"orders": "o_orderkey", "lineitem": "l_orderkey", "fx_ways": "way_id"}}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One projected table, without registering anything in the session."""
    import re

    text, frames = FX[name], {}
    n = parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet")) if name in DEALT else 0
    for t in BASE[name]:
        frames[t] = view(spark, sf_dir, t) if t in FX else spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t in DEALT.get(name, {}):  # not to be broadcast by an estimate either
            frames[t] = frames[t].repartition(n, DEALT[name][t]).hint("merge")
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text.replace("varchar(9)", "string").replace("varchar(12)", "string"), **frames)


def ctes(*names: str) -> list[tuple[str, str]]:
    """(name, text) of the projected tables for a DuckDB statement, in order of dependence."""
    out: list[tuple[str, str]] = []
    for n in names:
        for d in BASE[n]:
            if d in FX:
                out += [c for c in ctes(d) if c not in out]
        if (n, FX[n]) not in out:
            out.append((n, FX[n]))
    return out
