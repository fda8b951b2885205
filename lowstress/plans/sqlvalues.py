"""Fixed values as the DuckDB texts state them, apart from ``lowstress.lookups``: a wrong entry there must not pass on both sides."""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------------------------------
CYCLEWAY_FACILITY = {"lane": "cycle_lane", "opposite_lane": "cycle_lane", "share_busway": "shared_roadway", "shared_lane": "shared_roadway", "track": "protected_track"}
TRAFFIC = {
    "living_street": "<200", "service": "<500", "residential": "<1000", "unclassified": "500-2000", "tertiary": "1000-5000", "secondary": "5000-15000", "primary": "10000-25000", "trunk": "20000-40000",
    "motorway": ">40000",
}
VEHICLES = {"<200": 100, "<1000": 500, "500-2000": 1250, "unknown": 2500, "1000-5000": 3000, "5000-15000": 10000, "10000-25000": 17500, "20000-40000": 30000, ">40000": 40000}
USUAL_SPEED = {
    "footway": 10, "path": 20, "cycleway": 20, "service": 20, "living_street": 20, "residential": 40, "unclassified": 50, "tertiary": 50, "secondary": 50, "primary": 60, "trunk": 80, "motorway": 100,
}
MOTOR_ONLY = ("motorway", "motorway_link", "trunk", "trunk_link")
ENDPOINT_STRESS = {"protected_track": 1, "shared_path": 1, "cycle_lane": 2, "shared_roadway": 3, "signed_route": 3, "unknown": 3}
EASE = {"barrier_crossing": 0.1, "grade_separated_path": 0.25, "protected_cycle_track": 0.55, "painted_cycle_lane": 0.85, "shared_roadway": 1.0}
PLACE_WEIGHT = {
    "school": 1.0, "university": 1.0, "college": 1.0, "station": 1.0, "tram_stop": 0.8, "hospital": 0.8, "stop_position": 0.7, "library": 0.6, "community_centre": 0.6, "clinic": 0.5, "supermarket": 0.5,
    "park": 0.4, "commercial": 0.4, "industrial": 0.3,
}
METRE_COST = {"shared_roadway": 80, "painted_cycle_lane": 300, "protected_cycle_track": 2500, "grade_separated_path": 8000, "barrier_crossing": 15000}
#: Stress by speed (up to) and lanes (1, 2, more): a painted lane, and mixed traffic.
PAINTED = {30: (1, 1, 2), 40: (1, 2, 3), 50: (2, 2, 3), 60: (3, 4, 4)}
MIXED = {30: (1, 2, 3), 40: (2, 3, 4), 50: (3, 3, 4)}
# --------------------------------------------------------------------------------------------------
