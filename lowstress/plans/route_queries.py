"""Queries that need paths through a network; their DuckDB texts find them by relaxing edges until nothing gets shorter."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowstress.lookups import Thresholds
from lowstress.plans import sqlvalues as V
from lowstress.plans.network_queries import net, r, roads
from lowstress.plans.scoring_queries import gaps
from lowstress.plans.sqltext import case, cell, hav, lts, sql

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


def _walk(name: str, starts: str, links: str) -> str:
    """A common table of the least cost, and its path, from every start (column s) to every node, over links (u, v, w)."""
    return f"""{name}(src, node, dist, path) using key (src, node) as (
  select distinct s, s, 0::double, [s] from ({starts})
  union
  select c.src, c.node, min(c.dist), arg_min(c.path, c.dist) from (select w.src, x.v as node, w.dist + x.w as dist, list_append(w.path, x.v) as path from {name} w join {links} x on x.u = w.node) c
  left join recurring.{name} k on k.src = c.src and k.node = c.node where k.dist is null or c.dist < k.dist group by c.src, c.node)"""


def _with(body: str, more: list[str], *parts: str) -> str:
    """The parts, then more common tables (in order, they may recurse), then the statement."""
    text = sql("@@", *parts).replace("\n@@", ",\n" + ",\n".join(more) + "\n" + body)
    return text if text.startswith("with recursive") else text.replace("with ", "with recursive ", 1)


def _near(points: str, e: str, radius: float, to: str) -> str:
    """(gap_id, node) of the nearest node of ``to`` within the radius of the gaps' starts or ends."""
    pad = radius / 100_000
    return f"""select gap_id, arg_min(node, (dist, node)) as node from (select g.gap_id, n.node, {hav(f'g.{e}_lat', f'g.{e}_lon', 'n.lat', 'n.lon')} as dist from {points} g join {to} n
    on n.lat between g.{e}_lat - {pad} and g.{e}_lat + {pad} and n.lon between g.{e}_lon - {2 * pad} and g.{e}_lon + {2 * pad}) where dist <= {radius} group by gap_id"""


_LINKS = "links as (select a as u, b as v, length_m as w from net union all select b, a, length_m from net)"
_COORD = "floor(node / 100000000)::double / 1e5::double as lat, ((node % 100000000) - 18000000)::double / 1e5::double as lon"

_SIZE = 1000.0 / 111000.0
_SAMPLE = [
    "sizes as (select comp, count(*) as n from cc_run group by comp)",
    "main as (select node, lat, lon, md5(node::varchar) as h from cc_run join nodes using (node) where comp = (select comp from sizes order by n desc, comp limit 1))",
    f"placed as (select *, {cell('lat', _SIZE)} as r, {cell('lon', _SIZE)} as c from main)",
    f"dealt as (select *, row_number() over (partition by r, c order by h, node) <= (select greatest(1, floor({T.detour_sample} / count(*))) from (select distinct r, c from placed)) as taken from placed)",
    f"sample as (select node, lat, lon from dealt where taken union all (select node, lat, lon from dealt where not taken order by h, node limit greatest(0, {T.detour_sample} - (select count(*) from dealt where taken))))",
    f"pairs as (select a.node as source, b.node as target, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as straight_m from sample a join sample b on a.node < b.node)",
    "near as (select * from pairs where straight_m between 50 and 600)",
]


@query("detour_gaps", _with("select source, target, round(straight_m, 3) as straight_m, round(dist, 3) as network_m, round(dist / straight_m, 6) as detour_factor from near join walk on src = source and node = target where dist / straight_m >= 2",
    [*_SAMPLE, _LINKS, _walk("walk", "select source as s from near", "links")], "cc_run"))
def detour_gaps(spark, d):
    from lowstress.operators.separation import detour_gaps as f

    return f(net(spark, d)).select("source", "target", r(F.col("straight_m")).alias("straight_m"), r(F.col("network_m")).alias("network_m"), r(F.col("detour_factor"), 6).alias("detour_factor"))


@query("separation", _with("""select gap_id, round(network_m, 3) as network_m, round(separation_ratio, 6) as separation_ratio, not (separation_ratio <= 1.4 and straight_m <= 60) as keep
  from (select *, case when network_m is null or straight_m = 0 then 'inf'::double else network_m / straight_m end as separation_ratio from (
    select b.gap_id, b.straight_m, case when b.s <> b.e then w.dist end as network_m from both_ends b left join walk w on w.src = b.s and w.node = b.e))""",
    [_LINKS, f"s_end as ({_near('fx_gaps', 'start', T.endpoint_to_cycling, 'nodes')})", f"e_end as ({_near('fx_gaps', 'end', T.endpoint_to_cycling, 'nodes')})",
     f"both_ends as (select gap_id, s.node as s, e.node as e, {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} as straight_m from fx_gaps join s_end s using (gap_id) join e_end e using (gap_id))",
     _walk("walk", "select s from both_ends where s <> e", "links")], "net", "nodes", "fx_gaps"))
def separation(spark, d):
    from lowstress.operators.separation import separation as f

    return f(gaps(spark, d), net(spark, d)).select("gap_id", r(F.col("network_m")).alias("network_m"), r(F.col("separation_ratio"), 6).alias("separation_ratio"), "keep")


# --- streets -----------------------------------------------------------------------------------------------------------------

_STREETS = [
    "streets as (select name, a, b, length_m, cycleway in ('track', 'lane') as cycled, case cycleway when 'track' then 'protected_track' when 'lane' then 'cycle_lane' end as fac from roads where name <> '')",
    "corners as (select name, node, count(*) as n from (select name, a as node from streets union all select name, b from streets) group by all)",
    "steps as (select name, a, b, a as u, b as v, length_m, cycled, fac from streets union all select name, a, b, b, a, length_m, cycled, fac from streets)",
    """street_walk as (
  select s.*, s.u as start, s.a as first_a, s.b as first_b, 0 as pos from steps s join corners c on c.name = s.name and c.node = s.u where c.n <> 2
  union all
  select s.*, w.start, w.first_a, w.first_b, w.pos + 1 from street_walk w join corners c on c.name = w.name and c.node = w.v and c.n = 2 join steps s on s.name = w.name and s.u = w.v and (s.a <> w.a or s.b <> w.b))""",
    "walked as (select *, arg_max(v, pos) over (partition by name, start, first_a, first_b) as finish from street_walk)",
]


@query("street_chains", _with("select name, start, pos, u as a, v as b, round(length_m, 3) as length_m, cycled from walked where start < finish", _STREETS, "roads"))
def street_chains(spark, d):
    """Chains with two different outer nodes (those of a loop may run either way)."""
    from lowstress.operators.corridor import street_chains as f

    out = f(roads(spark, d))
    ends = out.groupBy("chain").agg(F.min_by("a", "pos").alias("start"), F.max_by("b", "pos").alias("finish")).where("start <> finish")
    return out.join(ends, "chain").select("name", "start", "pos", "a", "b", r(F.col("length_m")).alias("length_m"), "cycled")


@query("corridor_gaps", _with(f"""select distinct name, least(h.a, h.b) as a, greatest(h.a, h.b) as b, round(length_m, 3) as length_m, case when h.a < h.b then f1 else f2 end as start_facility, case when h.a < h.b then f2 else f1 end as end_facility from (
    select name, start, first_a, first_b, run, arg_min(u, pos) as a, arg_max(v, pos) as b, sum(length_m) as length_m, arg_min(coalesce(before, ''), pos) as f1, arg_max(coalesce(after, ''), pos) as f2 from (
      select *, sum(turn) over (partition by name, start, first_a, first_b order by pos) as run from (
        select *, case when lag(cycled) over w <> cycled then 1 else 0 end as turn, lag(fac) over w as before, lead(fac) over w as after from walked window w as (partition by name, start, first_a, first_b order by pos)))
    where not cycled group by name, start, first_a, first_b, run) h
  join (select name, count(*) as n, sum(case when cycled then length_m else 0 end) / sum(length_m) as part from streets group by name) using (name)
  where n >= 3 and part >= 0.3 and f1 <> '' and f2 <> '' and length_m between 20 and 800 and {hav('floor(h.a / 100000000)::double / 1e5', '((h.a % 100000000) - 18000000)::double / 1e5', 'floor(h.b / 100000000)::double / 1e5', '((h.b % 100000000) - 18000000)::double / 1e5')} > 30""",
    _STREETS, "roads"))
def corridor_gaps(spark, d):
    from lowstress.operators.corridor import corridor_gaps as f

    forth = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(forth, F.col(x)).otherwise(F.col(y))
    return f(roads(spark, d)).select("name", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), r(F.col("length_m")).alias("length_m"), pick("start_facility", "end_facility").alias("start_facility"), pick("end_facility", "start_facility").alias("end_facility"))


# --- routes ------------------------------------------------------------------------------------------------------------------

_FAC = case("cycleway", V.CYCLEWAY_FACILITY, "'none'")
_SPD = "(case when coalesce(maxspeed, 0) = 0 then 50 else maxspeed end)"
_ROADS = [
    f"""graph as (select *, length_m * case lts when 1 then 1.0::double when 2 then 1.5::double when 3 then 3.0::double else 8.0::double end as lts_cost,
    case when {_SPD} > 60 or aadt > 8000 then 'grade_separated_path' when {_SPD} >= 50 or aadt >= 3000 then 'protected_cycle_track' when {_SPD} >= 40 or aadt >= 1000 then 'painted_cycle_lane' else 'shared_roadway' end as recommended
    from (select *, {lts('highway', 'maxspeed', 'lanes', f'({_FAC})')} as lts, {case('aadt_proxy', V.VEHICLES, '2500')} as aadt from roads))""",
    f"road_nodes as (select node, {_COORD} from (select a as node from graph union select b from graph))",
    f"s_end as ({_near('fx_gaps', 'start', 1500, 'road_nodes')})",
    f"e_end as ({_near('fx_gaps', 'end', 1500, 'road_nodes')})",
    f"ends as (select g.*, s.node as s, e.node as e, {hav('start_lat', 'start_lon', 'end_lat', 'end_lon')} as straight_m from fx_gaps g left join s_end s using (gap_id) left join e_end e using (gap_id))",
]


def _routed(name: str, weight: str) -> list[str]:
    """Common tables up to ``name``: the routes that minimise a weight, rolled up."""
    cost = case("recommended", V.METRE_COST, "500")
    return [
        f"{name}_links as (select a as u, b as v, {weight} as w from graph union all select b, a, {weight} from graph)",
        _walk(f"{name}_walk", "select s from ends where s <> e", f"{name}_links"),
        f"{name}_steps as (select gap_id, i, [path[i], path[i + 1]] as x from (select gap_id, path, unnest(range(1, len(path))) as i from ends join {name}_walk on src = s and node = e where s <> e))",
        f"{name}_segments as (select gap_id, length_m, lts, recommended from {name}_steps join graph on a = least(x[1], x[2]) and b = greatest(x[1], x[2]))",
        f"{name}_kinds as (select gap_id, recommended, sum(length_m) as m from {name}_segments group by all)",
        f"""{name} as (select gap_id, count(*) as n, sum(length_m) as total, max(lts) as worst, sum(case when lts >= 3 then length_m else 0 end) as problem, 100 * sum(case when lts >= 4 then length_m else 0 end) / sum(length_m) as pct4,
        sum(length_m * {cost}) as cost, (select arg_max(recommended, (m, recommended)) from {name}_kinds k where k.gap_id = q.gap_id) as dominant from {name}_segments q group by gap_id)""",
    ]


_QUALITY = """case when n is null then '' when ratio > 2.5 or pct4 > 40 then 'poor' when 100 * problem / total <= 5 and ratio <= 1.4 then 'excellent' when 100 * problem / total <= 20 and pct4 <= 10 then 'good'
  when pct4 <= 25 and ratio <= 2.0 then 'fair' else 'poor' end"""
_ROUTE_BODY = f"""select gap_id, gap_type, 'lts' as strategy, '' as from_street, '' as to_street, n is not null as route_found, false as fallback_route, round(coalesce(total, 0), 1) as total_length_m, round(straight_m, 1) as straight_line_m,
  round(case when n is null then 1 else ratio end, 2) as detour_ratio, coalesce(worst, 1) as worst_lts, round(coalesce(problem, 0), 1) as lts_problem_length_m, coalesce(round(100 * problem / total, 1), 0) as lts_problem_pct,
  case when n is null then '' when worst <= 2 then 'straightforward' when round(100 * problem / total, 1) <= 30 then 'moderate' else 'complex' end as upgrade_complexity, coalesce(dominant, '') as dominant_facility,
  cast(round(coalesce(cost, 0), 0) as bigint) as estimated_cost_cad, {_QUALITY} as route_quality,
  case when s is null or e is null then 'Could not snap endpoints to road network' when s = e then 'Start and end snap to same road node \u2014 gap too small to route'
    when n is null then 'No road network path found between endpoints. Check if endpoints are in disconnected road graph areas.'
    when ratio > 2.5 then printf('Route detour ratio %.1fx exceeds threshold (2.5x) \u2014 direct corridor study recommended.', ratio) else '' end as notes,
  case when n is not null then round(t_total, 1) end as compare_shortest_length_m, case when n is not null then round(total / t_total, 2) end as compare_length_ratio, case when n is not null then t_worst end as compare_shortest_worst_lts,
  case when n is null then 'incomplete' when t_worst <= 2 then 'direct_is_comfortable' when worst >= 4 then 'no_comfortable_route' when round(total / t_total, 2) <= 1.1 then 'comfort_for_free' else 'detour_buys_comfort' end as compare_verdict
  from (select ends.*, f.n, f.total, f.worst, f.problem, f.pct4, f.cost, f.dominant, t.total as t_total, t.worst as t_worst, case when straight_m > 0 then f.total / straight_m else 1 end as ratio from ends left join easy f using (gap_id) left join direct t using (gap_id))"""
_ROUTES = [*_ROADS, *_routed("easy", "lts_cost"), *_routed("direct", "length_m")]


@query("route_table", _with(_ROUTE_BODY, _ROUTES, "roads", "fx_gaps"))
def route_table(spark, d):
    from lowstress.operators.routing import route_gaps
    from lowstress.sources.sinks import route_table as f

    return f(route_gaps(gaps(spark, d), roads(spark, d), "compare"))


_POINT = "[((x[{i}] % 100000000) - 18000000)::double / 1e5::double, floor(x[{i}] / 100000000)::double / 1e5::double]"


@query("route_lines", _with(f"""select gap_id, case when count(*) = 1 then 'LineString' else 'MultiLineString' end as kind, list([{_POINT.format(i=1)}, {_POINT.format(i=2)}] order by i) as lines, list(coalesce(name, 'Unnamed road') order by i) as names
  from direct_steps join graph on a = least(x[1], x[2]) and b = greatest(x[1], x[2]) group by gap_id""",
    [*_ROADS, *_routed("direct", "length_m")], "roads", "fx_gaps"))
def route_lines(spark, d):
    """Geometry and street names of the shortest routes, read back from their features."""
    from lowstress.operators.routing import route_gaps
    from lowstress.sources.sinks import route_features

    routes = route_gaps(gaps(spark, d), roads(spark, d), "shortest")
    made = route_features(spark.createDataFrame([], "feature string"), routes)
    one, many = (f"geometry struct<type string, coordinates {c}>" for c in ("array<array<double>>", "array<array<array<double>>>"))
    rest = "properties struct<gap_id string, segments array<struct<road_name string>>>"
    as_ = lambda kind: made.where(F.get_json_object("feature", "$.geometry.type") == kind)
    single = as_("LineString").select(F.from_json("feature", f"{one}, {rest}").alias("f")).select("f.properties.gap_id", "f.geometry.type", F.array("f.geometry.coordinates").alias("lines"), "f.properties.segments.road_name")
    several = as_("MultiLineString").select(F.from_json("feature", f"{many}, {rest}").alias("f")).select("f.properties.gap_id", "f.geometry.type", F.col("f.geometry.coordinates").alias("lines"), "f.properties.segments.road_name")
    return single.unionByName(several).select("gap_id", F.col("type").alias("kind"), "lines", F.col("road_name").alias("names"))


@query("route_summary", _with(f"""select count(*) as gaps, count_if(route_found) as found, count_if(fallback_route) as fallback, count_if(route_quality = 'excellent') as excellent, count_if(route_quality = 'good') as good, count_if(route_quality = 'fair') as fair,
  count_if(route_quality = 'poor' or not route_found) as poor_or_not_found, round((select sum(total) from easy), 1) as total_length_m, round((select sum(cost) from easy), 0) as total_cost from ({_ROUTE_BODY})""", _ROUTES, "roads", "fx_gaps"))
def route_summary(spark, d):
    from lowstress.operators.routing import route_gaps
    from lowstress.operators.routing import route_summary as f

    return f(route_gaps(gaps(spark, d), roads(spark, d))).withColumns({"total_length_m": F.round("total_length_m", 1), "total_cost": F.round("total_cost", 0)})


@query("lts_routes", _with(f"select gap_id, route_found as found, notes, round(total_length_m, 1) as total_length_m, worst_lts, lts_problem_pct, upgrade_complexity, route_quality from ({_ROUTE_BODY})", _ROUTES, "roads", "fx_gaps"))
def lts_routes(spark, d):
    from lowstress.operators.routing import route_gaps

    out = route_gaps(gaps(spark, d), roads(spark, d))
    return out.select("gap_id", "found", F.array_join("notes", "; ").alias("notes"), r(F.col("total_length_m"), 1).alias("total_length_m"), "worst_lts", "lts_problem_pct", "upgrade_complexity", "route_quality")


@query("compared_routes", _with(f"select gap_id, compare_length_ratio as length_ratio, compare_verdict as verdict from ({_ROUTE_BODY})", _ROUTES, "roads", "fx_gaps"))
def compared_routes(spark, d):
    from lowstress.operators.routing import compare_strategies

    return compare_strategies(gaps(spark, d), roads(spark, d))
