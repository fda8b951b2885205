"""Enumerations, classification tables and thresholds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values ---------------------------------------------------------------------------------
EXCLUDED_FACILITIES = ("shared_roadway", "signed_route", "unknown")
FACILITY_RANK = {"protected_track": 3, "shared_path": 3, "cycle_lane": 2, "shared_roadway": 1, "signed_route": 1, "unknown": 0}
ENDPOINT_PRIORITY = {"protected_track": 3, "shared_path": 2, "cycle_lane": 1}
AADT_PROXY = {
    "motorway": ">40000", "trunk": "20000-40000", "primary": "10000-25000", "secondary": "5000-15000", "tertiary": "1000-5000",
    "unclassified": "500-2000", "residential": "<1000", "living_street": "<200", "service": "<500",
}
AADT_MIDPOINT = {
    ">40000": 40000, "20000-40000": 30000, "10000-25000": 17500, "5000-15000": 10000, "1000-5000": 3000, "500-2000": 1250,
    "<1000": 500, "<200": 100, "unknown": 2500,
}
AADT_DEFAULT = 2500
NAMED_SPEED = {"ca:urban": 50, "ca:rural": 80, "ca:motorway": 100, "urban": 50, "rural": 80}
DEFAULT_SPEED = {
    "motorway": 100, "trunk": 80, "primary": 60, "secondary": 50, "tertiary": 50, "unclassified": 50, "residential": 40,
    "living_street": 20, "service": 20, "cycleway": 20, "path": 20, "footway": 10,
}
#: (speed up to, lanes up to) -> level of traffic stress
LTS_MIXED = {
    (30, 1): 1, (30, 2): 2, (30, 99): 3, (40, 1): 2, (40, 2): 3, (40, 99): 4, (50, 1): 3, (50, 2): 3, (50, 99): 4, (60, 99): 4, (80, 99): 4, (99, 99): 4,
}
LTS_PAINTED = {
    (30, 1): 1, (30, 2): 1, (30, 99): 2, (40, 1): 1, (40, 2): 2, (40, 99): 3, (50, 1): 2, (50, 2): 2, (50, 99): 3, (60, 1): 3, (60, 99): 4, (80, 99): 4, (99, 99): 4,
}
ENDPOINT_LTS = {"protected_track": 1, "shared_path": 1, "cycle_lane": 2, "shared_roadway": 3, "signed_route": 3, "unknown": 3}
CYCLEWAY_FACILITY = {"track": "protected_track", "lane": "cycle_lane", "opposite_lane": "cycle_lane", "shared_lane": "shared_roadway", "share_busway": "shared_roadway"}
CONTEXT_SCORE = {"completes_low_stress": 1.0, "reduces_stress": 0.65, "high_stress_barrier": 0.30}
COMPLEXITY = {"shared_roadway": 1.0, "painted_cycle_lane": 0.85, "protected_cycle_track": 0.55, "grade_separated_path": 0.25, "barrier_crossing": 0.10}
DESTINATION_WEIGHT = {
    "school": 1.0, "university": 1.0, "college": 1.0, "station": 1.0, "stop_position": 0.7, "tram_stop": 0.8, "library": 0.6, "community_centre": 0.6,
    "hospital": 0.8, "clinic": 0.5, "supermarket": 0.5, "park": 0.4, "commercial": 0.4, "industrial": 0.3,
}
GAP_PRIORITY = {"island": 4, "corridor": 3, "detour": 2, "dangling": 1, "connector": 1}
LTS_COST = {1: 1.0, 2: 1.5, 3: 3.0, 4: 8.0}
COST_PER_METRE = {"grade_separated_path": 8000, "protected_cycle_track": 2500, "painted_cycle_lane": 300, "shared_roadway": 80, "barrier_crossing": 15000}
MOTOR_ONLY = ("motorway", "trunk", "motorway_link", "trunk_link")
FALSE_POSITIVE_REASONS = ("Already connected", "Data error", "Parallel facility", "Same corridor (fragmentation)")
WEIGHTS = {"connectivity": 0.40, "buildability": 0.20, "destination": 0.20, "lts": 0.15, "equity": 0.05}
#: Facility class -> tags of a way that is classified as it again
FACILITY_TAGS = {
    "protected_track": {"highway": "cycleway", "bicycle": "designated", "foot": "no"}, "cycle_lane": {"highway": "secondary", "cycleway": "lane"},
    "shared_path": {"highway": "path", "bicycle": "designated", "foot": "designated"}, "shared_roadway": {"highway": "residential", "bicycle": "yes"},
    "signed_route": {"route": "bicycle"}, "unknown": {"highway": "path", "bicycle": "yes"},
}
GAP_COLUMNS = (
    "rank", "gap_id", "gap_type", "connector_class", "from_street", "to_street", "composite_score", "score_connectivity", "score_buildability",
    "score_destination", "score_lts", "score_equity", "start_lat", "start_lon", "end_lat", "end_lon", "straight_line_m", "detour_factor",
    "separation_ratio", "current_network_m", "recommended_facility", "lts_achievable", "cost_tier", "otm18_basis", "start_facility", "end_facility",
    "lts_context", "corridor_lts", "crosses_barrier", "master_plan_match", "plan_bonus_applied", "aadt_note",
)
AADT_NOTE = "AADT proxy used \u2014 verify with municipal traffic model"
FINAL_COLUMNS = (
    "rank", "gap_id", "gap_type", "from_street", "to_street", "composite_score", "straight_line_m", "recommended_facility", "lts_achievable", "cost_tier", "crosses_barrier",
)
ROUTE_COLUMNS = (
    "gap_id", "gap_type", "strategy", "from_street", "to_street", "route_found", "fallback_route", "total_length_m", "straight_line_m", "detour_ratio", "worst_lts",
    "lts_problem_length_m", "lts_problem_pct", "upgrade_complexity", "dominant_facility", "estimated_cost_cad", "route_quality", "notes",
)
COMPARE_COLUMNS = ("compare_shortest_length_m", "compare_length_ratio", "compare_shortest_worst_lts", "compare_verdict")
FACILITY_SHORT = {
    "grade_separated_path": "Multi-use path (grade separated)", "protected_cycle_track": "Protected cycle track (physically separated)", "painted_cycle_lane": "Painted cycle lane",
    "shared_roadway": "Signed shared roadway / neighbourhood greenway", "barrier_crossing": "Barrier crossing \u2014 engineering review required",
}
LTS_ACHIEVABLE = {"grade_separated_path": 1, "protected_cycle_track": 1, "painted_cycle_lane": 2, "shared_roadway": 2, "barrier_crossing": 1}
COST_TIER = {"grade_separated_path": "high", "protected_cycle_track": "medium-high", "painted_cycle_lane": "low", "shared_roadway": "low", "barrier_crossing": "very high"}
#: What a recommendation rests on; protected_by_ends is a protected track that only the facilities at both ends ask for.
BASIS = {
    "barrier_crossing": "Barrier crossing \u2014 OTM Book 18 Section 3.5",
    "grade_separated_path": "OTM Book 18 Fig 3-1: Speed >60 km/h or AADT >8,000 \u2192 grade-separated path",
    "protected_cycle_track": "OTM Book 18 Fig 3-1: Speed 50-60 km/h or AADT 3,000-8,000 \u2192 protected cycle track",
    "protected_by_ends": "OTM Book 18 Fig 3-1: Speed 40-50 km/h + endpoint context (connecting to protected track) \u2192 protected cycle track recommended",
    "painted_cycle_lane": "OTM Book 18 Fig 3-1: Speed 40-50 km/h, AADT <3,000 \u2192 painted cycle lane",
    "shared_roadway": "OTM Book 18 Fig 3-1: Speed \u226430 km/h, low volume \u2192 shared roadway",
}
LTS_LABEL = {
    1: "LTS 1 \u2014 Suitable for all ages and abilities", 2: "LTS 2 \u2014 Suitable for most adults", 3: "LTS 3 \u2014 Suitable for confident cyclists only",
    4: "LTS 4 \u2014 High stress, experienced cyclists only",
}
ROUTE_NOTES = {
    "no_end": "No end coordinate \u2014 gap may be missing endpoint data",
    "not_snapped": "Could not snap endpoints to road network",
    "same_node": "Start and end snap to same road node \u2014 gap too small to route",
    "no_path": "No road network path found between endpoints. Check if endpoints are in disconnected road graph areas.",
    "fallback": "No low-stress route found \u2014 fallback to shortest physical path. Review corridor for infrastructure upgrade opportunities.",
    "detour": "Route detour ratio %.1fx exceeds threshold (%sx) \u2014 direct corridor study recommended.",
}


@dataclass(frozen=True)
class Thresholds:
    """Distances in metres unless said otherwise."""

    snap: float = 15
    edge_snap: float = 18
    gap_max: float = 600
    detour_min: float = 2.0
    detour_sample: int = 80
    candidate_buffer: float = 100
    component_min_length: float = 50
    island_min_length: float = 250
    corridor_min: float = 20
    corridor_max: float = 800
    dangling_radius: float = 400
    dangling_cap: int = 500
    same_road: float = 30
    micro_gap: float = 20
    dedup: float = 300
    endpoint_dedup: float = 150
    connected_ratio: float = 1.4
    connected_length: float = 60
    endpoint_to_cycling: float = 50
    corridor_near_cycling: float = 35
    near_miss_min: float = 30
    near_miss_max: float = 300
    near_miss_existing: float = 200
    connector_quick: float = 150
    connector_max: float = 500
    connector_tolerance: float = 25
    connector_samples: int = 6
    roundabout_margin: float = 25
    roundabout_max_gap: float = 300
    roundabout_floor: float = 12
    plan_radius: float = 200
    route_detour: float = 2.5
    spine_edge: float = 200
    spine_top: int = 50


# --------------------------------------------------------------------------------------------------
