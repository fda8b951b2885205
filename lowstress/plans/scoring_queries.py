"""Queries over the projected gaps: refinement, scoring, routing and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowstress.fixtures import view
from lowstress.lookups import Thresholds
from lowstress.operators import refine, review, route, score
from lowstress.operators import spatial as S
from lowstress.plans import sqlvalues as V
from lowstress.plans.network_queries import r, roads, vertices, ways
from lowstress.plans.sqltext import CIRCLE_PARTS, case, hav, lts, sql
from lowstress.storage import materialize, settled

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


#: Degrees of latitude and longitude that the statements look at around a gap: places, roads, the streets of its ends, network nodes, roads along it.
PLACE_BOX, ROAD_BOX, STREET_BOX, NODE_BOX, FOLLOW_BOX = (0.01, 0.02), (0.006, 0.01), (0.003, 0.005), (0.001, 0.001), 0.0005


def gaps(spark, d):
    return view(spark, d, "fx_gaps")


def spines(spark, d):
    return view(spark, d, "fx_plan").where("pt = 1").select(F.col("feature_ord").alias("ord"), "name", "lat", "lon")


_LEN = hav("start_lat", "start_lon", "end_lat", "end_lon")
_LTS = f"case when road_highway is null then 4 else {lts('road_highway', 'road_maxspeed', 'road_lanes', chr(39) + 'none' + chr(39))} end"
_CTX = f"""select *, case when s <= 2 and e <= 2 and c <= 2 then 'completes_low_stress' when s <= 2 and e <= 2 and c = 3 then 'reduces_stress' when c = 4 then 'high_stress_barrier' else 'reduces_stress' end as context
  from (select *, {_LEN} as len_m, (start_lat + end_lat) / 2 as lat, (start_lon + end_lon) / 2 as lon, {_LTS} as c, {case('start_facility', V.ENDPOINT_STRESS, '3')} as s, {case('end_facility', V.ENDPOINT_STRESS, '3')} as e from fx_gaps)"""
_SPD = "(case when coalesce(road_maxspeed, 0) = 0 then 50 else road_maxspeed end)"
_PROXY = case("road_highway", V.TRAFFIC, "'unknown'")
_AADT = case(f"({_PROXY})", V.VEHICLES, "2500")
_REC = f"""select *, case when crosses_barrier then 'barrier_crossing' when {_SPD} > 60 or aadt > 8000 then 'grade_separated_path' when {_SPD} >= 50 or aadt >= 3000 then 'protected_cycle_track'
  when {_SPD} >= 40 or aadt >= 1000 then case when start_facility in ('protected_track', 'shared_path') or end_facility in ('protected_track', 'shared_path') then 'protected_cycle_track' else 'painted_cycle_lane' end
  else 'shared_roadway' end as recommended from (select *, {_AADT} as aadt from ctx)"""
_BUILD = f"""select *, least(1::double, greatest(0::double, (0.5 + 0.5 * greatest(0::double, 1 - len_m / 800)) * {case('recommended', V.EASE, '0.5::double')} * case when crosses_barrier then 0.3::double else 1::double end
  * case when road_highway is not null then 1.15::double else 1::double end)) as build_score from rec"""
_BASE = """select coalesce(max(case when gap_type = 'island' then component_size end), 50) as max_island_size, coalesce(max(case when gap_type = 'detour' and detour_factor <> 0 then detour_factor end), 5.0::double) as max_detour_factor,
  coalesce(avg(case when gap_type = 'detour' and detour_factor <> 0 then detour_factor end), 2.5::double) as mean_detour_factor,
  coalesce(max(case when gap_type in ('dangling', 'corridor', 'connector') and len_m <> 0 then len_m end), 600.0::double) as max_short_gap_m, count(*) as total_gaps from ctx"""
_SHORT = "(0.35::double + 0.65::double * greatest(0::double, 1 - len_m / max_short_gap_m))"
_CONN = f"""select *, case gap_type when 'island' then least(1::double, component_size / max_island_size::double) when 'detour' then least(1::double, (detour_factor - 2) / 3)
  else round(least(1::double, case when gap_type = 'corridor' then least(1::double, {_SHORT} + 0.1::double) else {_SHORT} end), 4) end as conn_base,
  case when separation_ratio is null then 0.5::double when isinf(separation_ratio) then 1::double else least(1::double, greatest(0::double, (separation_ratio - 1) / 3)) end as sep_score from build, base"""
_DEST = f"""select gap_id, least(1::double, coalesce(sum(case when dist <= 500 then w when dist <= 1000 then w * 0.5 else 0 end), 0::double) / 5) as dest_score from (
  select g.gap_id, {case('p.type', V.PLACE_WEIGHT, '0.3::double')} as w, {hav('g.lat', 'g.lon', 'p.lat', 'p.lon')} as dist from ctx g left join fx_destinations p on p.lat between g.lat - 0.01 and g.lat + 0.01 and p.lon between g.lon - 0.02 and g.lon + 0.02) group by gap_id"""
_EQ = f"""select gap_id, greatest(0.1::double, (6 - arg_min(quintile, (dist, da_id))) / 5::double) as equity_score from (select g.gap_id, a.da_id, a.quintile, {hav('g.lat', 'g.lon', 'a.lat', 'a.lon')} as dist from ctx g, fx_da a) group by gap_id"""
_SPINE = f"""select gap_id, case when safe then least(1::double, d * 1.25::double) else d end as spine_score from (select gap_id, safe, greatest(0.1::double, 1 - min(dist) / 2000) as d from (
  select g.gap_id, g.start_facility in ('protected_track', 'shared_path') or g.end_facility in ('protected_track', 'shared_path') as safe, {hav('g.lat', 'g.lon', 'a.lat', 'a.lon')} as dist from ctx g, (select * from fx_plan where pt = 1) a) group by gap_id, safe)"""
_COMP = """select *, row_number() over (order by composite desc, ord) as rank, case when composite >= 66 then 'high' when composite >= 33 then 'medium' else 'low' end as band from (select *, round(least(1::double, 0.40::double * (0.55::double * conn_base + 0.20::double * spine_score + 0.25::double * sep_score)
  + 0.20::double * build_score + 0.20::double * dest_score + 0.15::double * case context when 'completes_low_stress' then 1.0::double when 'reduces_stress' then 0.65::double else 0.30::double end + 0.05::double * equity_score
  + case when plan_match then 0.05::double else 0 end + case gap_type when 'corridor' then 0.12::double when 'dangling' then case when start_facility = end_facility and start_facility in ('protected_track', 'cycle_lane', 'shared_path') then 0.08::double else 0.04::double end
    when 'connector' then case when connector_class = 'quick_win' then 0.06::double else 0.02::double end else 0 end) * 100, 1) as composite
  from conn join dest using (gap_id) join eq using (gap_id) join spine using (gap_id))"""
_CHAIN = {"ctx": _CTX, "rec": _REC, "build": _BUILD, "base": _BASE, "conn": _CONN, "dest": _DEST, "eq": _EQ, "spine": _SPINE, "comp": _COMP}


def gsql(body: str, upto: str, *more: str) -> str:
    names = list(_CHAIN)[: list(_CHAIN).index(upto) + 1]
    text = sql("@@", "fx_gaps", "fx_destinations", "fx_da", "fx_plan", *more)
    return text.replace("\n@@", "".join(f",\n{n} as ({_CHAIN[n]})" for n in names) + "\n" + body)


@query("gap_lts_context", gsql("select gap_id, c as corridor_lts, s as endpoint_lts_start, e as endpoint_lts_end, context from ctx", "ctx"))
def gap_lts_context(spark, d):
    return score.lts_context(gaps(spark, d)).select("gap_id", "corridor_lts", "endpoint_lts_start", "endpoint_lts_end", "context")


@query("facility_recommendation", gsql("select gap_id, recommended from rec", "rec"))
def facility_recommendation(spark, d):
    return score.recommend(gaps(spark, d)).select("gap_id", "recommended")


@query("buildability", gsql("select gap_id, round(build_score, 6) as build_score from build", "build"))
def buildability(spark, d):
    return score.buildability(score.recommend(score.with_length(gaps(spark, d)))).select("gap_id", r(F.col("build_score"), 6).alias("build_score"))


@query("network_baseline", gsql("select max_island_size, round(max_detour_factor, 6) as max_detour_factor, round(mean_detour_factor, 6) as mean_detour_factor, round(max_short_gap_m, 3) as max_short_gap_m, total_gaps from base", "base"))
def network_baseline(spark, d):
    b = score.baseline(score.with_length(gaps(spark, d)))
    return b.select("max_island_size", r(F.col("max_detour_factor"), 6).alias("max_detour_factor"), r(F.col("mean_detour_factor"), 6).alias("mean_detour_factor"), r(F.col("max_short_gap_m")).alias("max_short_gap_m"), "total_gaps")


@query("connectivity", gsql("select gap_id, round(conn_base, 4) as conn_base, round(sep_score, 6) as sep_score from conn", "conn"))
def connectivity(spark, d):
    return score.connectivity(score.with_length(gaps(spark, d))).select("gap_id", r(F.col("conn_base"), 4).alias("conn_base"), r(F.col("sep_score"), 6).alias("sep_score"))


@query("destination_score", gsql("select gap_id, round(dest_score, 6) as dest_score from dest", "dest"))
def destination_score(spark, d):
    return score.destinations(gaps(spark, d), view(spark, d, "fx_destinations"), PLACE_BOX).select("gap_id", r(F.col("dest_score"), 6).alias("dest_score"))


@query("equity_score", gsql("select gap_id, round(equity_score, 6) as equity_score from eq", "eq"))
def equity_score(spark, d):
    return score.equity(gaps(spark, d), view(spark, d, "fx_da")).select("gap_id", r(F.col("equity_score"), 6).alias("equity_score"))


@query("spine_proximity", gsql("select gap_id, round(spine_score, 6) as spine_score from spine", "spine"))
def spine_proximity(spark, d):
    return score.spine_proximity(gaps(spark, d), spines(spark, d)).select("gap_id", r(F.col("spine_score"), 6).alias("spine_score"))


def scored(spark, d):
    return score.score_gaps(gaps(spark, d), view(spark, d, "fx_destinations"), view(spark, d, "fx_da"), spines(spark, d), PLACE_BOX)


@query("composite_rank", gsql("select gap_id, composite, rank, band from comp", "comp"))
def composite_rank(spark, d):
    return scored(spark, d).select("gap_id", "composite", "rank", "band")


@query("priority_bands", gsql("select band, gap_type, count(*) as gaps, count_if(crosses_barrier) as barriers, count_if(plan_match) as planned from comp group by band, gap_type", "comp"))
def priority_bands(spark, d):
    return scored(spark, d).groupBy("band", "gap_type").agg(F.count("*").alias("gaps"), F.count_if("crosses_barrier").alias("barriers"), F.count_if("plan_match").alias("planned"))


_DISMISSED = "(select gap_id, arg_max(reason, (ts, event_id)) as reason from (select 'GAP-' || cast(substr(gap_id, 5) as int) as gap_id, reason, ts, event_id from fx_decisions) group by gap_id)"


@query("run_summary", gsql("""select cast(place as int) as place, line from (select unnest(range(11)) as place, unnest([printf('Total gaps: %d', count(*)), printf('Island: %d', count_if(gap_type = 'island')), printf('Detour: %d', count_if(gap_type = 'detour')),
  printf('Dangling: %d', count_if(gap_type = 'dangling')), printf('Corridor: %d', count_if(gap_type = 'corridor')), printf('Connector: %d', count_if(gap_type = 'connector')), printf('High priority: %d', count_if(band = 'high')),
  printf('Medium priority: %d', count_if(band = 'medium')), printf('Low priority: %d', count_if(band = 'low')), printf('Barrier crossings: %d', count_if(crosses_barrier)), printf('Master plan matches: %d', count_if(plan_match))]) as line from comp)
  union all select cast(rank + 10 as int), printf('#%d %s: %.1f/100, %s, %.0f m%s%s', rank, gap_id, composite, case recommended when 'grade_separated_path' then 'Multi-use path (grade separated)' when 'protected_cycle_track' then 'Protected cycle track (physically separated)'
    when 'painted_cycle_lane' then 'Painted cycle lane' when 'shared_roadway' then 'Signed shared roadway / neighbourhood greenway' else 'Barrier crossing \u2014 engineering review required' end, len_m,
    case when plan_match then ' [PLAN MATCH]' else '' end, case when crosses_barrier then ' [BARRIER]' else '' end) from comp where rank <= 5""", "comp"))
def run_summary(spark, d):
    from lowstress.sources.sinks import run_summary as f

    return f(scored(spark, d))


def dismissed(spark, d):
    x = view(spark, d, "fx_decisions")
    return review.latest_decisions(x.withColumn("gap_id", F.concat(F.lit("GAP-"), F.substring("gap_id", 5, 9).cast("int").cast("string"))))


@query("latest_decision", sql("select gap_id, arg_max(reason, (ts, event_id)) as reason from fx_decisions group by gap_id", "fx_decisions"))
def latest_decision(spark, d):
    return review.latest_decisions(view(spark, d, "fx_decisions")).select("gap_id", "reason")


@query("active_rank", gsql(f"select gap_id, x.reason is not null as dismissed, case when x.reason is null then row_number() over (partition by x.reason is null order by composite desc, ord) end as active_rank from comp left join {_DISMISSED} x using (gap_id)", "comp", "fx_decisions"))
def active_rank(spark, d):
    return review.active_rank(scored(spark, d), dismissed(spark, d)).select("gap_id", "dismissed", "active_rank")


@query("dismissals_by_reason", sql(f"select reason, count(*) as n, reason in ('Already connected', 'Data error', 'Parallel facility', 'Same corridor (fragmentation)') as false_positive from {_DISMISSED} group by reason", "fx_decisions"))
def dismissals_by_reason(spark, d):
    return review.by_reason(dismissed(spark, d))


@query("dismissal_metric_dist", gsql(f"select reason, count(*) as n, min(separation_ratio) as low, median(separation_ratio) as mid, max(separation_ratio) as high from {_DISMISSED} join ctx using (gap_id) where separation_ratio is not null and not isinf(separation_ratio) group by reason", "ctx", "fx_decisions"))
def dismissal_metric_dist(spark, d):
    return review.metric_distribution(dismissed(spark, d), gaps(spark, d), "separation_ratio")


@query("threshold_suggestions", gsql(f"select reason, printf('raise the connected ratio to %.2f', max(separation_ratio) + 0.05::double) as suggestion from {_DISMISSED} join ctx using (gap_id) where reason = 'Already connected' and separation_ratio is not null and not isinf(separation_ratio) group by reason", "ctx", "fx_decisions"))
def threshold_suggestions(spark, d):
    return review.suggestions(dismissed(spark, d), gaps(spark, d))


@query("master_plan_match", gsql(f"select gap_id, arg_min(name, feature_ord) as plan_name from (select g.gap_id, p.name, p.feature_ord, {hav('g.lat', 'g.lon', 'p.lat', 'p.lon')} as dist from ctx g, fx_plan p) where dist < 200 group by gap_id", "ctx"))
def master_plan_match(spark, d):
    return refine.plan_match(gaps(spark, d), view(spark, d, "fx_plan"))


# --- gaps and roads ---------------------------------------------------------------------------------


def _mid(spark, d):
    g = refine.with_midpoint(score.with_length(gaps(spark, d)))
    return g.select("gap_id", "lat", "lon", "len_m")


def _road_points(spark, d):
    return roads(spark, d).select("way_id", "highway", F.col("name").alias("road"), F.col("mid_lat").alias("r_lat"), F.col("mid_lon").alias("r_lon"))


_ROADMID = f"(select g.gap_id, g.len_m, x.way_id, x.highway, x.name, {hav('g.lat', 'g.lon', 'x.mid_lat', 'x.mid_lon')} as dist from ctx g join roads x on x.mid_lat between g.lat - 0.006 and g.lat + 0.006 and x.mid_lon between g.lon - 0.01 and g.lon + 0.01)"


_PX, _PY = "((plon - x.lon1) * 111320.0::double * cos(radians(x.lat1)))", "((plat - x.lat1) * 110540.0::double)"
_BX, _BY = "((x.lon2 - x.lon1) * 111320.0::double * cos(radians(x.lat1)))", "((x.lat2 - x.lat1) * 110540.0::double)"
_TT = f"(case when {_BX} * {_BX} + {_BY} * {_BY} = 0 then 0::double else least(1::double, greatest(0::double, ({_PX} * {_BX} + {_PY} * {_BY}) / ({_BX} * {_BX} + {_BY} * {_BY}))) end)"
_SEGMENT = f"sqrt(pow({_PX} - {_TT} * {_BX}, 2) + pow({_PY} - {_TT} * {_BY}, 2))"


@query("candidate_roads", gsql(f"select gap_id, way_id, highway, round(dist, 3) as dist, rn from (select *, row_number() over (partition by gap_id order by dist, way_id) as rn from {_ROADMID} where dist <= greatest(100, 0.3 * len_m)) where rn <= 5", "ctx", "roads"))
def candidate_roads(spark, d):
    from lowstress.operators.attach import candidate_roads as f

    return f(gaps(spark, d), roads(spark, d), "gap_id", ROAD_BOX).select("gap_id", "way_id", "highway", r(F.col("dist")).alias("dist"), "rn")


@query("barrier_flag", gsql(f"select gap_id, coalesce(bool_or(dist <= 0.5 * len_m and highway in ('motorway', 'trunk', 'motorway_link', 'trunk_link')), false) as crosses from ctx left join {_ROADMID} using (gap_id) group by gap_id".replace("dist <= 0.5 * len_m", "dist <= 0.5 * ctx.len_m"), "ctx", "roads"))
def barrier_flag(spark, d):
    from lowstress.operators.attach import barriers

    hit = barriers(gaps(spark, d), roads(spark, d), "gap_id", ROAD_BOX)
    return gaps(spark, d).select("gap_id").join(hit.withColumn("h", F.lit(True)), "gap_id", "left").select("gap_id", F.coalesce("h", F.lit(False)).alias("crosses"))


def _label_sql(e: str) -> str:
    near = f"(select g.gap_id, x.way_id, x.highway, x.name, {hav(f'g.{e}_lat', f'g.{e}_lon', 'x.mid_lat', 'x.mid_lon')} as dist from ctx g join roads x on x.mid_lat between g.{e}_lat - 0.003 and g.{e}_lat + 0.003 and x.mid_lon between g.{e}_lon - 0.005 and g.{e}_lon + 0.005)"
    return f"""(select gap_id, coalesce(arg_min(name, (dist, way_id)) filter (where name <> '' and dist <= 150), 'Unnamed ' || arg_min(highway, (dist, way_id)) filter (where dist <= 200), 'Unknown') as {e}
      from ctx left join {near} using (gap_id) group by gap_id)"""


@query("street_labels", gsql(f"select gap_id, s.\"start\" as from_street, e.\"end\" as to_street, s.\"start\" || ' \u2192 ' || e.\"end\" as label from {_label_sql('start').replace('as start', 'as ' + chr(34) + 'start' + chr(34))} s join {_label_sql('end').replace('as end', 'as ' + chr(34) + 'end' + chr(34))} e using (gap_id)", "ctx", "roads"))
def street_labels(spark, d):
    from lowstress.functions.tags import gap_label
    from lowstress.operators.attach import end_labels

    out = end_labels(gaps(spark, d), roads(spark, d), "gap_id", STREET_BOX)
    return out.withColumn("label", gap_label(F.col("from_street"), F.col("to_street"), arrow=True))


@query("follows_road", gsql(f"""select gap_id, count(distinct i) >= 3.5 as buildable from (select *, start_lat + (end_lat - start_lat) * i / 6.0::double as plat, start_lon + (end_lon - start_lon) * i / 6.0::double as plon from (select *, unnest(range(0, 7)) as i from ctx)) p
  left join roads x on greatest(x.lat1, x.lat2) >= plat - 0.0005 and least(x.lat1, x.lat2) <= plat + 0.0005 and greatest(x.lon1, x.lon2) >= plon - 0.0005 and least(x.lon1, x.lon2) <= plon + 0.0005
    and {_SEGMENT} <= 25 group by gap_id having count(x.a) > 0""".replace("count(distinct i) >= 3.5", "count(distinct case when x.a is not null then i end) >= 3.5"), "ctx", "roads"))
def follows_road(spark, d):
    from lowstress.operators.attach import follows_road as f

    g = gaps(spark, d)
    some = f(g, roads(spark, d), "gap_id", least=1 / 7, box=FOLLOW_BOX).select("gap_id")
    yes = f(g, roads(spark, d), "gap_id", box=FOLLOW_BOX).withColumn("y", F.lit(True))
    return some.join(yes, "gap_id", "left").select("gap_id", F.coalesce("y", F.lit(False)).alias("buildable"))


@query("nearest_named_road", gsql(f"select gap_id, way_id, round(dist, 3) as dist from (select gap_id, way_id, dist, row_number() over (partition by gap_id order by dist, way_id) as rn from {_ROADMID.replace('0.006', '0.03').replace('0.01)', '0.04)').replace('- 0.01 ', '- 0.04 ')} where name <> '') where rn = 1", "ctx", "roads"))
def nearest_named_road(spark, d):
    from lowstress.operators.attach import nearest_named_road as f

    return f(_mid(spark, d), roads(spark, d), "gap_id").select("gap_id", "way_id", r(F.col("dist")).alias("dist"))


@query("uncovered_gaps", gsql(f"""select gap_id from ctx g where gap_type = 'dangling' and not exists (select 1 from ctx e where e.gap_type <> 'dangling'
  and e.lat between g.lat - 0.002 and g.lat + 0.002 and {hav('g.lat', 'g.lon', 'e.lat', 'e.lon')} < 200)""", "ctx"))
def uncovered_gaps(spark, d):
    g = gaps(spark, d)
    return refine.without_covered(g.where("gap_type = 'dangling'"), g.where("gap_type <> 'dangling'")).select("gap_id")


def _ranked(spark, d):
    return review.active_rank(scored(spark, d), dismissed(spark, d))


@query("review_stats", gsql(f"select count_if(x.reason is null) as active, count_if(x.reason is not null) as dismissed, count_if(x.reason is null and composite >= 66) as high, count_if(x.reason is null and composite >= 33 and composite < 66) as medium from comp left join {_DISMISSED} x using (gap_id)", "comp", "fx_decisions"))
def review_stats(spark, d):
    return review.review_stats(_ranked(spark, d))


@query("review_filters", gsql(f"""select f as filter, gap_id from (select gap_id, gap_type, x.reason is not null as off, composite from comp left join {_DISMISSED} x using (gap_id)), (select unnest(['all', 'active', 'dismissed', 'high', 'island', 'corridor']) as f)
  where f = 'all' or (f = 'active' and not off) or (f = 'dismissed' and off) or (f = 'high' and not off and composite >= 66) or gap_type = f""", "comp", "fx_decisions"))
def review_filters(spark, d):
    from lowstress.storage import checkpoint

    g, out = checkpoint(_ranked(spark, d).select("gap_id", "gap_type", "dismissed", "composite")), None
    for f in ("all", "active", "dismissed", "high", "island", "corridor"):
        one = review.filtered(g, f).select(F.lit(f).alias("filter"), "gap_id")
        out = one if out is None else out.unionByName(one)
    return out


_SHORT_NAME = """case recommended when 'grade_separated_path' then 'Multi-use path (grade separated)' when 'protected_cycle_track' then 'Protected cycle track (physically separated)' when 'painted_cycle_lane' then 'Painted cycle lane'
  when 'shared_roadway' then 'Signed shared roadway / neighbourhood greenway' else 'Barrier crossing \u2014 engineering review required' end"""
_ACHIEVABLE = "case when recommended in ('painted_cycle_lane', 'shared_roadway') then 2 else 1 end"
_TIER = "case recommended when 'grade_separated_path' then 'high' when 'protected_cycle_track' then 'medium-high' when 'barrier_crossing' then 'very high' else 'low' end"
_BASIS = f"""case recommended when 'barrier_crossing' then 'Barrier crossing \u2014 OTM Book 18 Section 3.5' when 'grade_separated_path' then 'OTM Book 18 Fig 3-1: Speed >60 km/h or AADT >8,000 \u2192 grade-separated path'
  when 'protected_cycle_track' then case when {_SPD} >= 50 or aadt >= 3000 then 'OTM Book 18 Fig 3-1: Speed 50-60 km/h or AADT 3,000-8,000 \u2192 protected cycle track'
    else 'OTM Book 18 Fig 3-1: Speed 40-50 km/h + endpoint context (connecting to protected track) \u2192 protected cycle track recommended' end
  when 'painted_cycle_lane' then 'OTM Book 18 Fig 3-1: Speed 40-50 km/h, AADT <3,000 \u2192 painted cycle lane' else 'OTM Book 18 Fig 3-1: Speed \u226430 km/h, low volume \u2192 shared roadway' end"""


@query("final_table", gsql(f"""select cast(row_number() over (order by composite desc, ord) as int) as rank, gap_id, gap_type, '' as from_street, '' as to_street, composite as composite_score, round(len_m, 0) as straight_line_m,
  {_SHORT_NAME} as recommended_facility, {_ACHIEVABLE} as lts_achievable, {_TIER} as cost_tier, crosses_barrier
  from comp left join {_DISMISSED} x using (gap_id) where x.reason is null""", "comp", "fx_decisions"))
def final_table(spark, d):
    from lowstress.sources.sinks import final_table as f

    return f(_ranked(spark, d)).withColumn("rank", F.col("rank").cast("int"))


@query("gap_table", gsql(f"""select rank, gap_id, gap_type, coalesce(connector_class, '') as connector_class, '' as from_street, '' as to_street, composite as composite_score,
  round((0.55::double * conn_base + 0.20::double * spine_score + 0.25::double * sep_score) * 100, 1) as score_connectivity, round(build_score * 100, 1) as score_buildability, round(dest_score * 100, 1) as score_destination,
  case context when 'completes_low_stress' then 100.0::double when 'reduces_stress' then 65.0::double else 30.0::double end as score_lts, round(equity_score * 100, 1) as score_equity,
  start_lat, start_lon, end_lat, end_lon, round(len_m, 0) as straight_line_m, detour_factor, case when isinf(separation_ratio) then 'inf' else cast(round(separation_ratio, 2) as varchar) end as separation_ratio,
  cast(null as double) as current_network_m, {_SHORT_NAME} as recommended_facility, {_ACHIEVABLE} as lts_achievable, {_TIER} as cost_tier, {_BASIS} as otm18_basis, start_facility, end_facility, context as lts_context,
  c as corridor_lts, crosses_barrier, plan_match as master_plan_match, plan_match as plan_bonus_applied, 'AADT proxy used \u2014 verify with municipal traffic model' as aadt_note from comp""", "comp"))
def gap_table(spark, d):
    from lowstress.sources.sinks import gap_table as f

    return f(scored(spark, d))


@query("dismissal_advice", gsql(f"""select reason, n, case reason when 'Already connected' then coalesce(printf('raise the connected ratio to %.2f', ratio + 0.05::double), 'no values of these gaps')
  when 'Same corridor (fragmentation)' then coalesce(printf('raise the edge snap to %.0f m', least(span, 30::double)), 'no values of these gaps')
  when 'Data error' then 'check the source data' else 'raise the distance between parallel gaps' end as suggestion
  from (select reason, count(*) as n, max(case when not isinf(separation_ratio) then separation_ratio end) as ratio, max(len_m) as span from {_DISMISSED} left join ctx using (gap_id)
    where reason in ('Already connected', 'Data error', 'Parallel facility', 'Same corridor (fragmentation)') group by reason)""", "ctx", "fx_decisions"))
def dismissal_advice(spark, d):
    return review.advice(dismissed(spark, d), score.with_length(gaps(spark, d)))


_NODEPAIRS = f"(select g.gap_id, n.node, {hav('g.start_lat', 'g.start_lon', 'n.lat', 'n.lon')} as dist from ctx g join nodes n on n.lat between g.start_lat - 0.001 and g.start_lat + 0.001 and n.lon between g.start_lon - 0.001 and g.start_lon + 0.001)"


def _starts(spark, d):
    return gaps(spark, d).select("gap_id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))


def _net_nodes(spark, d):
    from lowstress.operators.network import nodes
    from lowstress.plans.network_queries import net

    return nodes(net(spark, d)).select("node", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))


@query("cycling_within_35m", gsql(f"select distinct gap_id from {_NODEPAIRS} where dist <= 35", "ctx", "nodes"))
def cycling_within_35m(spark, d):
    return S.within(_starts(spark, d), _net_nodes(spark, d), "gap_id", T.corridor_near_cycling, box=NODE_BOX)


@query("nearest_cycling_node", gsql(f"select gap_id, node, round(dist, 3) as dist from (select *, row_number() over (partition by gap_id order by dist, node) as rn from {_NODEPAIRS} where dist <= 50) where rn = 1", "ctx", "nodes"))
def nearest_cycling_node(spark, d):
    return S.nearest(_starts(spark, d), _net_nodes(spark, d), "gap_id", T.endpoint_to_cycling, ["node"], box=NODE_BOX).select("gap_id", "node", r(F.col("dist")).alias("dist"))


_SEGD = """sqrt(pow(px - t * bx, 2) + pow(py - t * by_, 2))"""


@query(
    "roundabout_filter",
    gsql(f"""select gap_id from ctx where gap_id not in (select gap_id from (select *, case when bx * bx + by_ * by_ = 0 then 0 else least(1, greatest(0, (px * bx + py * by_) / (bx * bx + by_ * by_))) end as t from (
      select gap_id, radius as rad, (g.end_lon - g.start_lon) * 111320 * cos(radians(g.start_lat)) as bx, (g.end_lat - g.start_lat) * 110540 as by_, (c.lon - g.start_lon) * 111320 * cos(radians(g.start_lat)) as px, (c.lat - g.start_lat) * 110540 as py
      from ctx g, circles c where g.len_m <= 300)) where {_SEGD} <= rad + 25)""", "ctx", "rounds").replace("\nselect gap_id from ctx where", ",\n" + ",\n".join(CIRCLE_PARTS) + "\nselect gap_id from ctx where").replace("with ", "with recursive ", 1),
)
def roundabout_filter(spark, d):
    hits = refine.roundabout_hits(gaps(spark, d), refine.roundabout_circles(ways(spark, d), vertices(spark, d)))
    return gaps(spark, d).join(hits, "gap_id", "left_anti").select("gap_id")


# --- routes: each street stands for the route of a gap ----------------------------------------------

_SEG_REC = f"""case when {_SPD} > 60 or aadt > 8000 then 'grade_separated_path' when {_SPD} >= 50 or aadt >= 3000 then 'protected_cycle_track' when {_SPD} >= 40 or aadt >= 1000 then 'painted_cycle_lane' else 'shared_roadway' end""".replace("road_maxspeed", "maxspeed")
_FAC = case("cycleway", V.CYCLEWAY_FACILITY, "'none'")
_SEGROUTE = f"select name as gap_id, length_m, lts, {_SEG_REC} as recommended from (select *, {lts('highway', 'maxspeed', 'lanes', f'({_FAC})')} as lts, {case('aadt_proxy', V.VEHICLES, '2500')} as aadt from roads) where name <> ''"
_ROLL = f"""select *, case when worst_lts <= 2 then 'straightforward' when problem_pct <= 30 then 'moderate' else 'complex' end as complexity from (select gap_id, sum(m) as total_length_m, max(w) as worst_lts, sum(p) as problem_m, round(100 * sum(p) / sum(m), 1) as problem_pct, 100 * sum(p4) / sum(m) as lts4_pct, sum(c) as estimated_cost, arg_max(recommended, (m, recommended)) as dominant_facility
  from (select gap_id, recommended, sum(length_m) as m, max(lts) as w, sum(case when lts >= 3 then length_m else 0 end) as p, sum(case when lts >= 4 then length_m else 0 end) as p4, sum(length_m * {case('recommended', V.METRE_COST, '500')}) as c from ({_SEGROUTE}) group by gap_id, recommended) group by gap_id)"""


def _routes(spark, d):
    e = route.segment_facility(route.weighted_edges(roads(spark, d))).where("name <> ''").withColumnRenamed("name", "gap_id")
    return route.roll_up(e)


@query("weighted_road_edges", sql(f"select a, b, lts, round(length_m * case lts when 1 then 1.0 when 2 then 1.5 when 3 then 3.0 else 8.0 end, 3) as lts_cost from (select *, {lts('highway', 'maxspeed', 'lanes', f'({_FAC})')} as lts from roads)", "roads"))
def weighted_road_edges(spark, d):
    return route.weighted_edges(roads(spark, d)).select("a", "b", "lts", r(F.col("lts_cost")).alias("lts_cost"))


@query("route_rollup", sql(f"select gap_id, round(total_length_m, 2) as total_length_m, worst_lts, round(problem_m, 2) as problem_m, problem_pct, round(estimated_cost, 0) as estimated_cost, dominant_facility, complexity from ({_ROLL})", "roads"))
def route_rollup(spark, d):
    return _routes(spark, d).select("gap_id", r(F.col("total_length_m"), 2).alias("total_length_m"), "worst_lts", r(F.col("problem_m"), 2).alias("problem_m"), "problem_pct", r(F.col("estimated_cost"), 0).alias("estimated_cost"), "dominant_facility", "complexity")


@query("route_quality", sql(f"""select gap_id, round(detour_ratio, 6) as detour_ratio, case when worst_lts = 1 then '' when detour_ratio > 2.5 or lts4_pct > 40 then 'poor' when high <= 5 and detour_ratio <= 1.4 then 'excellent' when high <= 20 and lts4_pct <= 10 then 'good'
  when lts4_pct <= 25 and detour_ratio <= 2.0 then 'fair' else 'poor' end as quality from (select *, total_length_m / (1000 + 250 * length(gap_id)) as detour_ratio, 100 * problem_m / total_length_m as high from ({_ROLL}))""", "roads"))
def route_quality(spark, d):
    x = _routes(spark, d).withColumn("straight_line_m", (1000 + 250 * F.length("gap_id")).cast("double")).withColumn("found", F.col("worst_lts") != 1).withColumn("fallback", F.lit(False))
    return route.with_quality(x).select("gap_id", r(F.col("detour_ratio"), 6).alias("detour_ratio"), "quality")


@query("route_verdict", sql(f"""select gap_id, length_ratio, case when not found then 'incomplete' when s_worst <= 2 then 'direct_is_comfortable' when worst_lts >= 4 then 'no_comfortable_route' when length_ratio <= 1.1 then 'comfort_for_free' else 'detour_buys_comfort' end as verdict from (
  select *, case when found then round(total_length_m / s_len, 2) end as length_ratio from (select gap_id, total_length_m, worst_lts, length(gap_id) % 3 <> 0 as found, total_length_m - problem_m * 0.5 as s_len, greatest(1, worst_lts - 1) as s_worst from ({_ROLL})))""", "roads"))
def route_verdict(spark, d):
    x = _routes(spark, d).withColumn("fallback", F.lit(False))
    found = F.length("gap_id") % 3 != 0
    s = x.select("gap_id", F.lit(True).alias("found"), (F.col("total_length_m") - F.col("problem_m") * 0.5).alias("total_length_m"), F.greatest(F.lit(1), F.col("worst_lts") - 1).alias("worst_lts"))
    return route.compare(x.withColumn("found", found), s)


# --- loops and kernels: no single SQL statement says the same; tests/test_operators.py and tests/test_paths.py hold them against brute force on small inputs ----


#: A greedy pass by rounds: who meets a better one that stays goes, who has only better ones that go stays.
_GREEDY = ["""ordered as (select *, row_number() over (order by case gap_type when 'island' then 4 when 'corridor' then 3 when 'detour' then 2 else 1 end desc, detour_factor desc, len_m desc, ord) as prio from ctx)""",
  f"""clash as (select a.prio as hi, b.prio as lo from ordered a join ordered b on a.prio < b.prio and abs(a.lat - b.lat) < 0.02 and abs(a.lon - b.lon) < 0.03 and ({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 300
    or least({", ".join(hav(f'a.{e}_lat', f'a.{e}_lon', f'b.{f}_lat', f'b.{f}_lon') for e in ('start', 'end') for f in ('start', 'end'))}) < 150))""",
  """verdict(prio, s) using key (prio) as (
  select prio, case when exists (select 1 from clash where lo = prio) then 0 else 1 end from ordered
  union
  select l.prio, case when bool_or(h.s = 1) then -1 else 1 end from (select distinct c.lo from verdict v join clash c on c.hi = v.prio where v.s <> 0) t join recurring.verdict l on l.prio = t.lo and l.s = 0
    join clash c on c.lo = l.prio join recurring.verdict h on h.prio = c.hi group by l.prio having bool_or(h.s = 1) or bool_and(h.s = -1))"""]


@query("dedup", gsql("""select printf('GAP-%03d', row_number() over (order by prio)) as gap_id, ord, gap_type, prio from ordered join verdict v using (prio) where v.s = 1""", "ctx").replace("\nselect printf", ",\n" + ",\n".join(_GREEDY) + "\nselect printf").replace("with ", "with recursive ", 1))
def dedup(spark, d):
    return refine.number_gaps(refine.greedy_dedup(gaps(spark, d))).select("gap_id", "ord", "gap_type", "prio")


@query("topology_clean")
def topology_clean(spark, d):
    from lowstress.operators.clean import clean_topology
    from lowstress.plans.network_queries import net

    return clean_topology(net(spark, d).drop("source")).select("a", "b", "way_ids", "facility", r(F.col("length_m")).alias("length_m"))


@query("betweenness_spines")
def betweenness_spines(spark, d):
    from lowstress.operators.clean import dissolve
    from lowstress.operators.spines import detect_spines
    from lowstress.plans.network_queries import net

    edges = dissolve(net(spark, d).drop("source"))
    return detect_spines(edges, roads(spark, d)).select("spine", "name", r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"), r(F.col("total_length_m")).alias("total_length_m"), "facility", "n_nodes")


@query("spines_by_name", sql("select spine as name, round(avg(mid_lat), 6) as lat, round(avg(mid_lon), 6) as lon, round(sum(length_m), 3) as total_length_m from (select *, case when lower(name) like '%street 0-1%' then 'STREET 0-1' when lower(name) like '%avenue 0-3%' then 'avenue 0-3' end as spine from roads) where spine is not null group by spine", "roads"))
def spines_by_name(spark, d):
    from lowstress.operators.spines import spines_by_name as f

    return f(roads(spark, d), ["STREET 0-1", "avenue 0-3"]).select("name", r(F.col("lat"), 6).alias("lat"), r(F.col("lon"), 6).alias("lon"), r(F.col("total_length_m")).alias("total_length_m"))


BOX = (43.0, -80.6, 43.03, -80.55)


@query("diagnose_nodes")
def diagnose_nodes(spark, d):
    from lowstress.operators.diagnose import nodes_in
    from lowstress.plans.network_queries import net

    return nodes_in(net(spark, d), BOX).select("node", "degree", "component", "facility", "facilities")


@query("diagnose_islands")
def diagnose_islands(spark, d):
    from lowstress.operators.diagnose import island_trace
    from lowstress.plans.network_queries import net

    return island_trace(net(spark, d), BOX).select("component", "size", r(F.col("length_m")).alias("length_m"), r(F.col("dist")).alias("dist"), "reason")


@query("diagnose_dangling")
def diagnose_dangling(spark, d):
    from lowstress.operators.diagnose import dangling_trace
    from lowstress.plans.network_queries import net

    return dangling_trace(net(spark, d), BOX)


@query("gap_geojson", gsql("select gap_id, 0 as part, 'Point' as type, round(lon, 6) as lon from ctx union all select gap_id, 1, 'LineString', round(start_lon, 6) from ctx", "ctx"))
def gap_geojson(spark, d):
    from lowstress.sources.sinks import gap_features

    f = gap_features(gaps(spark, d))
    first = F.when(F.col("part") == 0, F.get_json_object("feature", "$.geometry.coordinates[0]")).otherwise(F.get_json_object("feature", "$.geometry.coordinates[0][0]"))
    return f.select("gap_id", "part", F.get_json_object("feature", "$.geometry.type").alias("type"), r(first.cast("double"), 6).alias("lon"))


@query("union_detectors")
def union_detectors(spark, d):
    """All detectors on the plain network, without deduplication: components are computed once."""
    from lowstress.operators import corridor, detect
    from lowstress.operators import separation as sep
    from lowstress.plans.network_queries import net

    n, x = detect.prepare(net(spark, d)), materialize(roads(spark, d), "roads")
    parts = [
        ("island", 0, lambda: detect.by_anchor(detect.island_pairs(n))), ("detour", 1, lambda: detect.detour_ends(sep.detour_gaps(n.edges), n)), ("dangling", 2, lambda: detect.mutual_once(detect.dangling_pairs(n, x))),
        ("corridor", 3, lambda: detect.corridor_ends(corridor.corridor_gaps(x), n)), ("dangling", 4, lambda: detect.near_miss(n)), ("connector", 5, lambda: detect.mutual_once(detect.connector_pairs(n, x))),
    ]
    out, cols = None, ("gap_type", "src_ord", "start_lat", "start_lon", "end_lat", "end_lon", "start_facility", "end_facility")
    for kind, src, pairs in parts:
        # one after another, so that the disk holds what one of them shuffles
        one = settled(spark, lambda k=kind, s=src, p=pairs: detect.pairs_as_gaps(p(), k, s).select(*cols), "detector")
        out = one if out is None else out.unionByName(one)
    return out


@query("gap_analysis")
def gap_analysis(spark, d):
    """From ways to ranked gaps: snapped and cleaned network, all detectors, refinement, scores."""
    from lowstress.plans.analysis import gap_analysis as f

    found = f(ways(spark, d), vertices(spark, d), view(spark, d, "fx_destinations"), view(spark, d, "fx_da"), view(spark, d, "fx_plan"))
    return found.select("gap_id", "gap_type", "src_ord", "composite", "rank", "band", "from_street", "to_street", "crosses_barrier", "recommended", r(F.col("len_m")).alias("len_m"))


@query("diagnose_near_misses")
def diagnose_near_misses(spark, d):
    from lowstress.operators.diagnose import near_miss_trace
    from lowstress.plans.network_queries import net

    return near_miss_trace(net(spark, d), BOX).select("node", "r_node", "component", "r_component", "status", r(F.col("dist")).alias("dist"))


@query("diagnose_summary")
def diagnose_summary(spark, d):
    from lowstress.operators.diagnose import summary
    from lowstress.plans.network_queries import net

    return summary(net(spark, d), BOX)


def _counts_sql() -> str:
    one = lambda i, name, part: f"select {i} as step_no, '{name}' as step, (select count(*) from {part}_label) as nodes, (select count(*) from {part}) as edges, (select count(distinct c) from {part}_label) as components"
    more = []
    for p in ("cyc", "attr", "net", "roads"):
        more.append(f"{p}_links as (select a as u, b as v from {p} union all select b, a from {p})")
        more.append(f"""{p}_label(n, c) using key (n) as (select distinct u, u from {p}_links union
  select k.n, min(x.c) from {p}_label x join {p}_links l on l.u = x.n join recurring.{p}_label k on k.n = l.v where x.c < k.c group by k.n)""")
    body = " union all ".join([one(0, "cycling", "cyc"), one(1, "road attributes", "attr"), one(2, "merged", "net"), one(3, "roads", "roads")])
    return sql("@@", "net", "roads").replace("\n@@", ",\n" + ",\n".join(more) + "\n" + body).replace("with ", "with recursive ", 1)


@query("build_counts", _counts_sql())
def build_counts(spark, d):
    from lowstress.operators import network as N
    from lowstress.operators.diagnose import build_counts as f

    w, v = ways(spark, d), vertices(spark, d)
    merged = materialize(N.network_edges(w, v).select("a", "b", "drawn", "along"), "net")
    return f({"cycling": merged.where("drawn"), "road attributes": merged.where("along"), "merged": merged, "roads": N.road_edges(w, v)})


@query("cleaned_counts")
def cleaned_counts(spark, d):
    """The snapped network before and after its topology is cleaned, step by step."""
    from lowstress.operators import clean
    from lowstress.operators import network as N
    from lowstress.operators.diagnose import build_counts as f
    from lowstress.plans.network_queries import net
    from lowstress.storage import checkpoint

    snapped = checkpoint(N.snapped_edges(net(spark, d).drop("source"), T.snap))
    joined = clean.snap_dead_ends(snapped)
    return f({"snapped": snapped, "dead ends joined": joined, "chains dissolved": clean.dissolve(joined)})


@query("diagnose_report")
def diagnose_report(spark, d):
    from lowstress.operators import network as N
    from lowstress.operators.diagnose import report

    w, v = ways(spark, d), vertices(spark, d)
    merged = materialize(N.network_edges(w, v), "net")
    return report(w, v, {"cycling": merged.where("drawn"), "road attributes": merged.where("along"), "merged": merged.drop("drawn", "along")}, BOX, "Region")
