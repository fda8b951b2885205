"""Infrastructure files: GeoJSON and Shapefile features to classified ways, with load statistics."""

from __future__ import annotations

import struct
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowstress.functions import geo, tags
from lowstress.sources.field_map import FieldMap
from lowstress.sources.readers import exists

FEATURES = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>"
PARTS = "array<array<struct<lat: double, lon: double>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ord, properties, geometry_type, parts): line parts of LineString and MultiLineString; others have none."""
    f = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.posexplode("features").alias("ord", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    # the nesting depends on the type, so the text is parsed once its type is known
    line = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>")))
    multi = F.when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    parts = F.transform(F.coalesce(line, multi), lambda part: F.transform(part, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))))
    return f.select("ord", F.col("f.properties").alias("properties"), kind.alias("geometry_type"), F.coalesce(parts, F.array().cast(PARTS)).alias("parts"))


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The records of a .shp file as parts of (lat, lon): PolyLine (3), PolyLineZ (13) and PolyLineM (23); others are empty."""
    out, at = [], 100
    while at + 8 <= len(data):
        (words,) = struct.unpack(">i", data[at + 4 : at + 8])
        rec, at = data[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        parts: list[list[tuple[float, float]]] = []
        if len(rec) >= 44 and struct.unpack("<i", rec[:4])[0] in (3, 13, 23):
            n_parts, n_points = struct.unpack("<2i", rec[36:44])
            begins = [*struct.unpack(f"<{n_parts}i", rec[44 : 44 + 4 * n_parts]), n_points]
            xy = struct.unpack(f"<{2 * n_points}d", rec[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            parts = [[(xy[2 * i + 1], xy[2 * i]) for i in range(a, b)] for a, b in zip(begins, begins[1:], strict=False)]
        out.append(parts)
    return out


def parse_dbf(data: bytes) -> list[dict[str, str]]:
    """The rows of a .dbf file as text values (deleted rows too, so that rows match shapes)."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    cols, at = [], 32
    while data[at] != 0x0D:
        cols.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        pos, row = head + i * size + 1, {}
        for name, width in cols:
            value = data[pos : pos + width]
            pos += width
            try:
                row[name] = value.decode("utf-8").strip()
            except UnicodeDecodeError:
                row[name] = value.decode("latin-1").strip()
        rows.append(row)
    return rows


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson(), from x.shp with x.dbf beside it; files are read by Spark, each in one task."""
    base = path.removesuffix(".shp")
    told = projection(spark, f"{base}.prj")
    if told == "projected":
        warnings.warn(f"{base}.prj names a projected system: give source_crs in the field map", stacklevel=2)
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf"]).select(F.lit(1).alias("one"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"), "content")

    def read(table: pa.Table) -> pa.Table:
        by = dict(zip(table["kind"].to_pylist(), table["content"].to_pylist(), strict=True))
        shapes, rows = parse_shp(by["shp"]), parse_dbf(by["dbf"])
        rows += [{}] * (len(shapes) - len(rows))
        kind = pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))
        return pa.table(
            [
                pa.array(range(len(shapes)), pa.int32()), pa.array([list(r.items()) for r in rows[: len(shapes)]], pa.map_(pa.string(), pa.string())),
                pa.array(["MultiLineString" if s else None for s in shapes]), pa.array([[[{"lat": a, "lon": o} for a, o in p] for p in s] for s in shapes], kind),
            ],
            names=["ord", "properties", "geometry_type", "parts"],
        )

    return files.groupBy("one").applyInArrow(read, f"ord int, properties map<string,string>, geometry_type string, parts {PARTS}")


def projection(spark: SparkSession, path: str) -> str | None:
    """geographic or projected, as a .prj file says; None without one."""
    if not exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True).first()[0].lstrip().upper()
    return "projected" if text.startswith(("PROJCS", "PROJCRS")) else "geographic"


def to_ways(features: DataFrame, fields: FieldMap) -> tuple[DataFrame, DataFrame]:
    """(ways, statistics): kept parts as (way_id, ord, part, name, facility, coords, length_m), and one row of counts."""
    value = lambda name: F.coalesce(F.try_element_at("properties", F.lit(name)), F.lit("")) if name else F.lit("")
    status = F.try_element_at("properties", F.lit(fields.status_field)) if fields.status_field else F.lit(None).cast("string")
    f = features.select(
        "ord", "geometry_type", "parts", tags.status_passes(status, fields.status_include).alias("status_ok"),
        tags.map_facility(value(fields.facility_field), fields.facility_map, fields.facility_fallback).alias("facility"),
        F.when(F.trim(value(fields.name_field)) == "", fields.name_fallback).otherwise(value(fields.name_field)).alias("name"),
    )
    pieces = f.where(F.col("status_ok")).select("ord", "facility", "name", F.posexplode("parts").alias("part", "coords")).withColumn("length_m", geo.polyline_length(F.col("coords")))
    ok = (F.size("coords") >= 2) & (F.col("length_m") >= fields.min_segment_length_m)
    ways = pieces.where(ok).select(F.format_string("shp_%d_%d", "ord", "part").alias("way_id"), "ord", "part", "name", "facility", "coords", "length_m")
    short = pieces.agg(F.count_if(ok).alias("loaded"), F.count_if(~ok).alias("skipped_short"))
    stats = f.agg(F.count("*").alias("features"), F.count_if(~F.col("status_ok")).alias("skipped_status"), F.count_if(F.col("status_ok") & (F.size("parts") == 0)).alias("skipped_geometry"), F.count_if(F.col("facility") == fields.facility_fallback).alias("fallback_facility"))
    return ways, stats.join(F.broadcast(short))  # one row each


def read_infra(spark: SparkSession, path: str, fields: FieldMap | None = None) -> tuple[DataFrame, DataFrame]:
    """Ways and statistics of a GeoJSON (.geojson, .json) or Shapefile (.shp); coordinates must be degrees."""
    fields = fields or FieldMap()
    if path.endswith((".geojson", ".json", ".shp")) and not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith((".geojson", ".json")):
        features = read_geojson(spark, path)
    elif path.endswith(".shp"):
        features = read_shapefile(spark, path)
    else:
        raise ValueError(f"unknown kind of infrastructure file: {path}")
    if fields.source_crs not in (None, "EPSG:4326"):
        features = reproject(features, fields.source_crs)
    ways, stats = to_ways(features, fields)
    if ways.isEmpty():
        raise ValueError(f"nothing could be loaded from {path}")
    return ways, stats


def bbox_of(ways: DataFrame, pad: float = 0.005) -> tuple[float, float, float, float]:
    p = ways.select(F.explode("coords").alias("p")).agg(F.min("p.lat"), F.min("p.lon"), F.max("p.lat"), F.max("p.lon")).first()
    if p[0] is None:
        raise ValueError("no coordinates")
    return p[0] - pad, p[1] - pad, p[2] + pad, p[3] + pad


def reproject(features: DataFrame, crs: str) -> DataFrame:
    """Parts from UTM (EPSG:326xx, 327xx, 269xx) or Web Mercator (EPSG:3857) metres to degrees."""
    code = int(crs.upper().removeprefix("EPSG:"))
    if code == 3857:
        turn = lambda p: F.struct(F.degrees(2 * F.atan(F.exp(p["lat"] / 6378137.0)) - F.lit(3.141592653589793 / 2)).alias("lat"), F.degrees(p["lon"] / 6378137.0).alias("lon"))
    elif 26901 <= code <= 26923 or 32601 <= code <= 32660 or 32701 <= code <= 32760:
        turn = lambda p: utm_to_degrees(p["lon"], p["lat"], code % 100, code // 100 == 327)
    else:
        raise ValueError(f"unsupported coordinate system {crs}: convert the file to EPSG:4326 first")
    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, turn)))


def utm_to_degrees(east, north, zone: int, south: bool):
    """struct(lat, lon) by the inverse transverse Mercator series on the WGS 84 ellipsoid."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    y = north - (10_000_000.0 if south else 0.0)
    mu = y / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = ep2 * F.pow(F.cos(phi), 2), F.pow(F.tan(phi), 2)
    w = 1 - e2 * F.pow(F.sin(phi), 2)
    n, r = a / F.sqrt(w), a * (1 - e2) / F.pow(w, 1.5)
    d = (east - 500_000.0) / (n * k0)
    lat = phi - (n * F.tan(phi) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(phi)
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lon) + (zone * 6 - 183)).alias("lon"))
