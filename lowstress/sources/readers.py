"""Readers of optional and reviewed inputs: plans, finalised gaps, dismissals, gap tables, areas, saved or fetched responses."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowstress.functions import tags

_FEATURES = "features array<struct<geometry struct<type string, coordinates string>, properties map<string, string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(features): one row for each file (a FeatureCollection is read whole); null where a file is no JSON object."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", _FEATURES, {"mode": "PERMISSIVE"})["features"].alias("features"))


def _features(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path).select(F.posexplode("features").alias("ord", "f")).select("ord", "f.geometry", "f.properties")


def read_master_plan(spark: SparkSession, path: str | None) -> DataFrame:
    """(feature_ord, name, pt, lat, lon): the vertices of a plan's lines and points; a missing or malformed file gives no rows."""
    empty = spark.createDataFrame([], "feature_ord int, name string, pt int, lat double, lon double")
    if not path or not exists(spark, path):
        return empty
    f = _features(spark, path).select(F.col("ord").alias("feature_ord"), F.coalesce(F.col("properties")["name"], F.lit("")).alias("name"), F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("c"))
    one = F.array(F.from_json("c", "array<double>"))
    line = F.from_json("c", "array<array<double>>")
    many = F.flatten(F.from_json("c", "array<array<array<double>>>"))
    points = F.when(F.col("kind") == "Point", one).when(F.col("kind").isin("LineString", "MultiPoint"), line).when(F.col("kind").isin("MultiLineString", "Polygon"), many)
    v = f.select("feature_ord", "name", F.posexplode(points).alias("pt", "p")).where(F.size("p") >= 2)
    return v.select("feature_ord", "name", "pt", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))


def read_finalised_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(ord, lat, lon, properties) of the point features of an export of reviewed gaps; an export without points is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    points = _features(spark, path).where(F.col("geometry.type") == "Point")
    c = F.from_json("geometry.coordinates", "array<double>")
    out = points.select("ord", c[1].alias("lat"), c[0].alias("lon"), "properties")
    if out.isEmpty():
        raise ValueError(f"no point features in {path}")
    return out


def gaps_bbox(gaps: DataFrame) -> tuple[float, float, float, float]:
    """(south, west, north, east) of midpoints and ends, padded by a tenth and 0.01 degrees."""
    end = lambda k: tags.to_float(F.col("properties")[k])
    used = lambda v: F.when(v != 0, v)
    p = gaps.select(F.explode(F.array(F.struct("lat", "lon"), F.struct(used(end("end_lat")).alias("lat"), used(end("end_lon")).alias("lon")))).alias("p"))
    s, w, n, e = p.agg(F.min("p.lat"), F.min("p.lon"), F.max("p.lat"), F.max("p.lon")).first()
    lat, lon = (n - s) * 0.1 + 0.01, (e - w) * 0.1 + 0.01
    return s - lat, w - lon, n + lat, e + lon


def read_dismissed(spark: SparkSession, path: str) -> DataFrame:
    """(gap_id, reason, timestamp) of a sidecar, which must hold one object; a missing reason is Unspecified."""
    raw = spark.read.text(path, wholetext=True).select("value")
    if raw.where(~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False)) | F.from_json("value", "map<string, string>").isNull()).count():
        raise ValueError(f"{path} holds no JSON object")
    entries = raw.select(F.explode(F.from_json("value", "map<string, struct<reason string, timestamp string>>")).alias("gap_id", "v"))
    reason = F.coalesce(F.nullif(F.col("v.reason"), F.lit("")), F.lit("Unspecified"))
    return entries.select("gap_id", reason.alias("reason"), F.col("v.timestamp").alias("timestamp"))


def read_gaps_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a gap table, one for each gap_id (the last counts); all columns are text."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"').withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")))
    names = [c for c in rows.columns if c != "_at"]
    last = rows.where("gap_id is not null").groupBy("gap_id").agg(F.max_by(F.struct(*names), "_at").alias("r"))
    return last.select("r.*")


def read_areas(spark: SparkSession, path: str | None) -> DataFrame:
    """(da_id, quintile, lat, lon) from Parquet or CSV with columns lat, lon, quintile; no path: no areas (equity then is neutral)."""
    if not path:
        return spark.createDataFrame([], "da_id long, quintile int, lat double, lon double")
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    out = rows.select(*[F.col(c).cast(k).alias(c) for c, k in (("lat", "double"), ("lon", "double"), ("quintile", "int"))])
    return out.where("lat is not null and lon is not null and quintile between 1 and 5").select(F.xxhash64("lat", "lon", "quintile").alias("da_id"), "quintile", "lat", "lon")


def fetch(query: str, mirrors: tuple[str, ...], retries: int = 3, timeout: float = 90, post=None, sleep=time.sleep) -> dict:
    """The response of the first mirror that answers, as JSON; each is tried ``retries`` times, waiting 1, 2, 4, up to 16 seconds.

    Runs on the driver, for one region's extract; ``post(url, query, timeout)`` can be replaced. ConnectionError when all fail.
    """
    post = post or _post
    failed = None
    for url in mirrors:
        for k in range(retries):
            try:
                return json.loads(post(url, query, timeout))
            except (OSError, urllib.error.URLError, ValueError) as e:
                failed = e
                sleep(min(16, 2**k))
    raise ConnectionError(f"{len(mirrors) * retries} attempts failed") from failed


def _post(url: str, query: str, timeout: float) -> bytes:
    body = urllib.parse.urlencode({"data": query}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, body), timeout=timeout) as r:
        return r.read()
