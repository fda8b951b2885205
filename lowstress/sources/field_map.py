"""Per-city field maps: which attributes of an infrastructure file mean what."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class FieldMap:
    source_name: str = "Municipal Cycling Network"
    source_crs: str | None = None
    status_field: str | None = None
    status_include: tuple[str, ...] = ()
    facility_field: str = "FACILITY_TYPE"
    facility_map: dict[str, str] = field(default_factory=dict)
    facility_fallback: str = "unknown"
    name_field: str = "NAME"
    name_fallback: str = "Unnamed"
    min_segment_length_m: float = 5


def load_field_map(path: str | None = None) -> FieldMap:
    """The defaults with what a YAML file says instead; unknown keys are left out."""
    if path is None:
        return FieldMap()
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    known = {x.name for x in fields(FieldMap)}
    given = {k: v for k, v in given.items() if k in known and v is not None}
    if "status_include" in given:
        given["status_include"] = tuple(given["status_include"])
    return FieldMap(**given)
