"""Writers: gaps and routes as GeoJSON and CSV, the dismissal sidecar, and a static review page."""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowstress import lookups as L
from lowstress.functions import tags


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def _line(*ends: tuple[Column, Column]) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(lon, lat) for lat, lon in ends]).alias("coordinates"))


def gap_features(gaps: DataFrame) -> DataFrame:
    """(gap_id, feature): a point at the midpoint with all properties and a line with four, for gaps with coordinates."""
    g = gaps.where("start_lat is not null and end_lat is not null")
    a, b = (F.col("start_lat"), F.col("start_lon")), (F.col("end_lat"), F.col("end_lon"))
    feature = lambda geometry, *names: F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*names).alias("properties")))
    few = [c for c in ("gap_id", "gap_type", "composite", "band") if c in gaps.columns]
    both = F.array(feature(_point((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), *gaps.columns), feature(_line(a, b), *few))
    return g.select("gap_id", F.posexplode(both).alias("part", "feature"))


def way_features(ways: DataFrame, *names: str) -> DataFrame:
    line = F.struct(F.lit("LineString").alias("type"), F.transform("coords", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return ways.select(F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct(*names).alias("properties"))).alias("feature"))


def write_geojson(features: DataFrame, path: str, files: int = 1) -> None:
    """One FeatureCollection in each of ``files`` files; a task passes features on as they come and holds none of them."""

    def collection(batches):
        yield pa.RecordBatch.from_arrays([pa.array([HEAD])], names=["value"])
        first = True
        for batch in batches:
            lines = [x if first and i == 0 else "," + x for i, x in enumerate(batch.column(0).to_pylist())]
            first = first and not lines
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    features.select("feature").repartition(files).mapInArrow(collection, "value string").write.text(path)


HEAD = '{"type":"FeatureCollection","features":['


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features: for results that one task should not hold."""
    features.select("feature").write.text(path)


def write_csv(rows: DataFrame, path: str, order: str = "rank") -> None:
    """CSV files in the order of ``order`` (a range sort: the files' names follow it); one file for few rows."""
    rows.orderBy(order).write.csv(path, header=True)


def _pick(rows: DataFrame, columns: tuple[str, ...], values: dict[str, Column], optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns in the given order, by ``values`` or the column of that name; those in ``optional`` are null text where the rows have none, others are an error."""
    missing = [c for c in columns if c not in values and c not in rows.columns and c not in optional]
    if missing:
        raise ValueError(f"the rows lack {', '.join(missing)}")
    return rows.select(*[(values[c] if c in values else F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns])


#: What some detectors do not find out.
OPTIONAL = ("connector_class", "from_street", "to_street", "detour_factor")


def _hundred(score: str) -> Column:
    return tags.rounded(F.col(score) * 100, 1)


def _gap_values(scored: DataFrame) -> dict[str, Column]:
    ratio = F.col("separation_ratio") if "separation_ratio" in scored.columns else F.lit(None).cast("double")
    walked = F.col("current_network_m") if "current_network_m" in scored.columns else F.lit(None).cast("double")
    return {
        "composite_score": F.col("composite"), "score_connectivity": _hundred("conn_score"), "score_buildability": _hundred("build_score"), "score_destination": _hundred("dest_score"),
        "score_lts": _hundred("lts_score"), "score_equity": _hundred("equity_score"), "straight_line_m": F.round("len_m", 0), "recommended_facility": F.col("facility_short"), "lts_context": F.col("context"),
        "master_plan_match": F.col("plan_match"), "plan_bonus_applied": F.col("plan_match"), "current_network_m": F.round(walked, 0),
        "separation_ratio": F.when(ratio == float("inf"), "inf").otherwise(tags.rounded(ratio, 2).cast("string")), "aadt_note": F.lit(L.AADT_NOTE),
    }


def gap_table(scored: DataFrame) -> DataFrame:
    """The gap table: 32 columns in a fixed order (scores from 0 to 100), the note on traffic volumes in each row; missing labels are empty."""
    return _pick(scored, L.GAP_COLUMNS, _gap_values(scored), OPTIONAL).fillna("", subset=["connector_class", "from_street", "to_street"])


def final_table(scored: DataFrame) -> DataFrame:
    """Reviewed gaps: what is active, by active rank, in 11 columns."""
    active = scored.where("not dismissed").drop("rank").withColumnRenamed("active_rank", "rank")
    return _pick(active, L.FINAL_COLUMNS, _gap_values(active), OPTIONAL).fillna("", subset=["from_street", "to_street"])


def run_summary(scored: DataFrame, top: int = 5) -> DataFrame:
    """(place, line): gaps by type and band, barriers, plan matches, and the ``top`` gaps, as lines of text."""
    kinds = ("island", "detour", "dangling", "corridor", "connector")
    count = [F.count("*").alias("total"), *[F.count_if(F.col("gap_type") == k).alias(k) for k in kinds], *[F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")]]
    one = scored.agg(*count, F.count_if("crosses_barrier").alias("barriers"), F.count_if("plan_match").alias("planned"))
    names = {"total": "Total gaps", **{k: k.capitalize() for k in kinds}, "high": "High priority", "medium": "Medium priority", "low": "Low priority", "barriers": "Barrier crossings", "planned": "Master plan matches"}
    counts = one.select(F.posexplode(F.array(*[F.format_string(f"{label}: %d", c) for c, label in names.items()])).alias("place", "line"))
    marks = F.concat(F.when(F.col("plan_match"), " [PLAN MATCH]").otherwise(""), F.when(F.col("crosses_barrier"), " [BARRIER]").otherwise(""))
    best = scored.where(F.col("rank") <= top).select((F.col("rank") + len(names) - 1).cast("int").alias("place"), F.format_string("#%d %s: %.1f/100, %s, %.0f m%s", F.col("rank").cast("int"), "gap_id", "composite", "facility_short", "len_m", marks).alias("line"))
    return counts.unionByName(best)


def final_features(scored: DataFrame) -> DataFrame:
    """The features of active gaps (points with their active rank, and lines)."""
    return gap_features(scored.where("not dismissed"))


def route_table(routes: DataFrame) -> DataFrame:
    """The summary rows of ``routing.route_gaps``; the columns of a comparison only if there is one."""
    columns = L.ROUTE_COLUMNS + tuple(c for c in L.COMPARE_COLUMNS if c in routes.columns)
    digits = {"total_length_m": 1, "straight_line_m": 1, "detour_ratio": 2, "lts_problem_length_m": 1}
    values = {c: F.round(c, d) for c, d in digits.items()} | {
        "route_found": F.col("found"), "fallback_route": F.col("fallback"), "estimated_cost_cad": F.round("estimated_cost", 0).cast("long"), "notes": F.array_join("notes", "; "),
    }
    return _pick(routes, columns, values)


def route_features(points: DataFrame, routes: DataFrame) -> DataFrame:
    """(feature): the gaps' points as they came, then a line for each route that was found.

    A route of one segment is a LineString, one of several a MultiLineString with a part for each.
    """
    coords = F.transform("parts", lambda p: F.transform(p, lambda q: F.array(q["lon"], q["lat"])))
    compared = [F.struct(*[F.col(c).alias(c.removeprefix("compare_")) for c in L.COMPARE_COLUMNS]).alias("compare")] if L.COMPARE_COLUMNS[-1] in routes.columns else []
    properties = F.struct(
        "gap_id", "gap_type", "strategy", "from_street", "to_street", "found", "fallback", F.round("total_length_m", 1).alias("total_length_m"), F.round("straight_line_m", 1).alias("straight_line_m"),
        F.round("detour_ratio", 2).alias("detour_ratio"), "worst_lts", F.round("lts_problem_length_m", 1).alias("lts_problem_length_m"), "lts_problem_pct", "upgrade_complexity", "dominant_facility",
        F.round("estimated_cost", 0).cast("long").alias("estimated_cost"), "route_quality", *compared, "notes", "segments",
    )
    feature = lambda kind, c: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry"), properties.alias("properties")))
    lines = routes.where("found").select(F.when(F.size("parts") == 1, feature("LineString", coords[0])).otherwise(feature("MultiLineString", coords)).alias("feature"))
    return points.select("feature").unionByName(lines)


#: Strategy -> what its files' names end with.
SUFFIX = {"lts": "", "shortest": "_shortest", "compare": "_compare"}


def write_routes(gaps: DataFrame, routes: DataFrame, folder: str, region: str, strategy: str = "lts") -> dict[str, str]:
    """Writes the routes of ``routing.route_gaps``: features (with the gaps' points), summary rows and the map; returns the paths by name."""
    base = f"{folder.rstrip('/')}/{region.lower().replace(' ', '_')}_routes{SUFFIX[strategy]}"
    paths = {"geojson": f"{base}.geojson", "csv": f"{base}_summary.csv", "map": f"{base}_map.html"}
    points = gap_features(gaps).where("part = 0").select("feature")
    write_geojson(route_features(points, routes), paths["geojson"])
    write_csv(route_table(routes), paths["csv"], "gap_id")
    page = routes_page(routes, f"{region} routes")
    gaps.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.text(paths["map"])
    return paths


def destination_features(places: DataFrame, *names: str) -> DataFrame:
    return places.select(F.to_json(F.struct(F.lit("Feature").alias("type"), _point(F.col("lat"), F.col("lon")).alias("geometry"), F.struct(*names).alias("properties"))).alias("feature"))


def display_ways(cycling: DataFrame, roads: DataFrame, extra: tuple[str, ...] = ("track", "lane", "opposite_lane")) -> DataFrame:
    """The ways of the display layer: all cycling ways, and roads whose cycleway tag says that there is a facility."""
    return cycling.unionByName(roads.where(F.col("cycleway").isin(*extra)), allowMissingColumns=True)


def embed(data: object) -> str:
    """JSON for a script element: markup and line separators are escaped."""
    text = json.dumps(data, default=str, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


#: Rows that a stand-alone page holds; a page of more is refused, since no browser shows it.
PAGE_ROWS = 20_000


def _page_rows(rows: DataFrame, order: str) -> list[dict]:
    found = [r.asDict(recursive=True) for r in rows.orderBy(order).limit(PAGE_ROWS + 1).collect()]
    if len(found) > PAGE_ROWS:
        raise ValueError(f"a page holds {PAGE_ROWS} rows; write GeoJSON for more, or filter first")
    return found


def map_page(rows: DataFrame, title: str, order: str = "rank", counts: dict[str, int] | None = None) -> str:
    """A stand-alone map: lines drawn to scale as SVG (no tiles, no network), a card for each row beside it.

    Rows need start_lat, start_lon, end_lat, end_lon; all their columns are on the card. ``counts`` are shown on top.
    """
    data = embed(_page_rows(rows, order))
    head = " · ".join(f"{html.escape(str(k))}: {v}" for k, v in (counts or {}).items())
    return f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title>
<style>body{{display:flex;margin:0;font:14px sans-serif}}#side{{width:22em;height:100vh;overflow:auto}}#map{{flex:1;height:100vh}}.card{{padding:.5em;border-bottom:1px solid #ccc}}.on{{background:#ffd}}</style></head>
<body><div id="side"><h1>{html.escape(title)}</h1><p>{head}</p></div><svg id="map"></svg><script>
const rows = {data}.filter(r => r.start_lat != null && r.end_lat != null), svg = document.getElementById("map"), side = document.getElementById("side");
const lat = rows.flatMap(r => [r.start_lat, r.end_lat]), lon = rows.flatMap(r => [r.start_lon, r.end_lon]);
const least = v => v.reduce((a, b) => Math.min(a, b), Infinity), most = v => v.reduce((a, b) => Math.max(a, b), -Infinity);
const k = Math.cos((least(lat) + most(lat)) / 2 * Math.PI / 180), x = v => (v - least(lon)) * k, y = v => most(lat) - v;
svg.setAttribute("viewBox", [-0.002, -0.002, x(most(lon)) + 0.004, y(least(lat)) + 0.004].join(" "));
rows.forEach((r, i) => {{
  const l = document.createElementNS("http://www.w3.org/2000/svg", "line"), c = document.createElement("div"); c.className = "card";
  for (const [n, v] of [["x1", x(r.start_lon)], ["y1", y(r.start_lat)], ["x2", x(r.end_lon)], ["y2", y(r.end_lat)], ["stroke", {{high: "#c00", medium: "#e80"}}[r.band] || "#06c"], ["stroke-width", 3], ["vector-effect", "non-scaling-stroke"]]) l.setAttribute(n, v);
  for (const [n, v] of Object.entries(r)) {{ const p = document.createElement("div"); p.textContent = n + ": " + v; c.append(p); }}
  const mark = () => {{ document.querySelectorAll(".on").forEach(e => e.classList.remove("on")); c.classList.add("on"); c.scrollIntoView(); }};
  l.onclick = mark; c.onclick = mark; svg.append(l); side.append(c);
}});
</script></body></html>"""


def routes_page(routes: DataFrame, title: str) -> str:
    """The map of found routes, with the number of each quality and the total cost."""
    got = routes.where("found").groupBy("route_quality").agg(F.count("*").alias("n"), F.sum("estimated_cost").alias("cost")).orderBy("route_quality").collect()
    counts = {r["route_quality"]: r["n"] for r in got} | {"total cost": round(sum(r["cost"] or 0 for r in got))}
    return map_page(routes.where("found").drop("parts", "segments"), title, "gap_id", counts)


def dismissed_sidecar(decisions: DataFrame) -> DataFrame:
    """One row: {gap_id: {reason, timestamp}} as JSON text."""
    entry = F.struct("gap_id", F.struct("reason", F.col("ts").cast("string").alias("timestamp")))
    return decisions.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def review_page(gaps: DataFrame, region: str, dismissed: dict[str, str] | None = None) -> str:
    """The review page: filters, statistics, dismiss and restore with a reason, live ranks and the three exports, kept in the browser.

    ``dismissed`` (gap_id: reason) is taken over where the browser has no decision of its own.
    """
    data, before, slug = embed(_page_rows(gaps, "rank")), embed(dismissed or {}), embed(region.lower().replace(" ", "_"))
    columns = embed(list(L.FINAL_COLUMNS))
    return f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(region)}</title></head>
<body><h1>{html.escape(region)}</h1><p id="n"></p><p id="f"></p><table id="t"></table><script>
const gaps = {data}, before = {before}, slug = {slug}, columns = {columns}; const off = JSON.parse(localStorage.getItem("off-" + slug) || "{{}}"); let filter = "all";
for (const [id, reason] of Object.entries(before)) if (!(id in off)) off[id] = {{reason: reason, timestamp: ""}};
const out = g => off[g.gap_id] && off[g.gap_id].reason !== undefined, score = g => g.composite_score ?? g.composite;
const live = () => gaps.filter(g => !out(g));
function save(name, text, type) {{ const a = document.createElement("a"); a.href = URL.createObjectURL(new Blob([text], {{type: type}})); a.download = name; a.click(); }}
const feature = (g, kind, c) => ({{type: "Feature", geometry: {{type: kind, coordinates: c}}, properties: g}});
const exports_ = {{
  GeoJSON: () => save(`gaps_finalised_${{slug}}.geojson`, JSON.stringify({{type: "FeatureCollection", features: live().map(g => feature(g, "Point", [(g.start_lon + g.end_lon) / 2, (g.start_lat + g.end_lat) / 2])).concat(live().map(g => feature(g, "LineString", [[g.start_lon, g.start_lat], [g.end_lon, g.end_lat]])))}}), "application/json"),
  CSV: () => save(`gaps_finalised_${{slug}}.csv`, [columns.join(",")].concat(live().map((g, i) => columns.map(c => c === "rank" ? i + 1 : JSON.stringify(g[c] ?? "")).join(","))).join("\\n"), "text/csv"),
  dismissed: () => save(`dismissed_${{slug}}.json`, JSON.stringify(Object.fromEntries(Object.entries(off).filter(e => e[1].reason !== undefined))), "application/json")
}};
function button(text, act) {{ const b = document.createElement("button"); b.textContent = text; b.onclick = act; return b; }}
function show() {{
  const active = live(), t = document.getElementById("t"); t.replaceChildren(); localStorage.setItem("off-" + slug, JSON.stringify(off));
  document.getElementById("n").textContent = `active ${{active.length}}, dismissed ${{gaps.length - active.length}}, high ${{active.filter(g => score(g) >= 66).length}}, medium ${{active.filter(g => score(g) >= 33 && score(g) < 66).length}}`;
  const fits = g => filter === "all" || (filter === "active" ? !out(g) : filter === "dismissed" ? out(g) : filter === "high" ? !out(g) && score(g) >= 66 : g.gap_type === filter);
  gaps.filter(fits).sort((a, b) => out(a) - out(b) || a.rank - b.rank).forEach(g => {{ const r = t.insertRow();
    [active.indexOf(g) + 1 || "", g.gap_id, g.gap_type, score(g), g.band].forEach(v => r.insertCell().textContent = v);
    r.insertCell().append(button(out(g) ? "restore" : "dismiss", () => {{ if (out(g)) off[g.gap_id] = {{}}; else off[g.gap_id] = {{reason: prompt("reason") || "", timestamp: new Date().toISOString()}}; show(); }})); }});
}}
const bar = document.getElementById("f"); ["all", "active", "dismissed", "high", "island", "detour", "dangling", "corridor", "connector"].forEach(f => bar.append(button(f, () => {{ filter = f; show(); }})));
Object.entries(exports_).forEach(([n, f]) => bar.append(button("export " + n, f)));
show();</script></body></html>"""
