"""Readers and writers of the files records come in and go out by."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talasik.functions.text import strip

#: Header names that mean one column (fixed values).
ALIASES = {
    "date": "incident_date", "time": "incident_time", "date_of_incident": "incident_date", "time_of_incident": "incident_time", "place_of_incident": "location_purok", "source_file": "source_file_page", "location": "location_purok", "location_purok": "location_purok", "purok": "location_purok", "complainant": "reporting_party",
    "narrative": "narrative_summary", "narration": "narrative_summary", "incident_summary": "narrative_summary", "narrative_summary": "narrative_summary", "incident_type_primary": "incident_type",
    "batch": "batch_number", "encoder": "encoded_by", "include_in_ml": "include_in_ml",
}


def header_key(name: str) -> str:
    """Lower case, anything else than letters and digits one underscore, then its alias."""
    key = re.sub(r"[^0-9a-zñ]+", "_", name.lower()).strip("_")
    return ALIASES.get(key, key)


def canonical_headers(df: DataFrame) -> DataFrame:
    """Columns renamed by `header_key`; of several with one name the first that isn't blank counts."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(header_key(c), []).append(c)
    first = lambda cs: F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in cs]) if len(cs) > 1 else F.col(f"`{cs[0]}`")
    return df.select(*[first(cs).alias(k) for k, cs in groups.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string rows of a CSV with a header; quoted line ends stay and a byte-order mark goes."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def training_rows(df: DataFrame) -> DataFrame:
    """Rows fit for training: not excluded, with a narrative and a label that aren't blank."""
    excluded = F.lower(F.col("include_in_ml").cast("string")).isin("no", "false", "0", "excluded", "exclude")
    filled: Column = (F.length(strip(F.col("narrative_summary"))) > 0) & (F.length(strip(F.col("incident_type"))) > 0)
    return df.filter(~F.coalesce(excluded, F.lit(False)) & filled)


def read_dimension(spark: SparkSession, path: str) -> dict:
    """A JSON dimension on the driver; a missing or broken file is an empty one."""
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return {}
        raise


def rings(geojson: dict) -> list[list[tuple[float, float]]]:
    """Outer rings of the polygons of a GeoJSON object as (x, y)."""
    found = []

    def walk(node: dict) -> None:
        for f in node.get("features", []):
            walk(f.get("geometry") or {})
        if node.get("type") == "Feature":
            walk(node.get("geometry") or {})
        if node.get("type") == "Polygon":
            found.append([tuple(p[:2]) for p in node["coordinates"][0]])
        if node.get("type") == "MultiPolygon":
            found.extend([tuple(p[:2]) for p in polygon[0]] for polygon in node["coordinates"])

    walk(geojson)
    return [r[:-1] if r and r[0] == r[-1] else r for r in found]


def read_pages(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """path and content of every image below a folder."""
    names = "*.{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).select("path", "content")


def read_text_by(pages: DataFrame, backend, schema: str = "path string, text string") -> DataFrame:
    """Text of pages by a pluggable `backend`, a function from and to pandas batches (no engine is bundled)."""
    return pages.mapInPandas(backend, schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; there is no way here to change or delete any."""
    df.write.mode("append").parquet(path)


def import_template(spark: SparkSession) -> DataFrame:
    """The import's columns with one example row."""
    row = {"batch_number": "BN-00001", "encoded_by": "ENC-01", "source_file_page": "page.jpg, p. 1", "incident_date": "2026-01-31", "incident_time": "14:30", "location_purok": "Purok 4",
           "reporting_party": "Given Surname", "respondent": "Given Surname", "narrative_summary": "What happened", "incident_type": "Theft", "readability": "readable", "remarks": ""}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))


def audit_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Audit rows (user_id, username, user_role, action_name, target_type, target_id, outcome, ip) stamped now in UTC; no free text."""
    schema = "user_id bigint, username string, user_role string, action_name string, target_type string, target_id bigint, outcome string, ip string"
    df = spark.createDataFrame(rows, schema)
    allowed = F.col("outcome").isin("success", "failure", "denied")
    return df.withColumn("outcome", F.when(allowed, F.col("outcome")).otherwise(F.raise_error(F.lit("outcome must be success, failure or denied")))).withColumn("audit_ts", F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")))
