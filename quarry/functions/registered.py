"""Scalar functions that SQL programs may call: temporary SQL functions, so that Catalyst inlines and optimises their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, parameters, result and body; a zone that isn't known is an error, a null argument gives null.
FUNCTIONS = {
    "tz_local_time": ("ts TIMESTAMP, zone STRING", "STRING", "date_format(from_utc_timestamp(ts, zone), 'yyyy-MM-dd HH:mm')"),
    "tz_offset": ("ts TIMESTAMP, zone STRING", "DOUBLE", "(unix_seconds(from_utc_timestamp(ts, zone)) - unix_seconds(ts)) / 3600D"),
    "tz_call_window": ("ts TIMESTAMP, zone STRING, first INT, past INT", "BOOLEAN", "hour(from_utc_timestamp(ts, zone)) >= first AND hour(from_utc_timestamp(ts, zone)) < past"),
    "path_base": ("path STRING", "STRING", "element_at(split(path, '/'), -1)"),
    "path_extension": ("path STRING", "STRING", "lower(regexp_extract(path, '\\\\.([^./]*)$', 1))"),
    "search_address": ("words STRING", "STRING", "CASE WHEN words <> '' THEN concat('search://web?q=', replace(replace(url_encode(lower(trim(regexp_replace(words, '\\\\s+', ' ')))), '+', '%20'), '*', '%2A')) ELSE words END"),
}


def register(spark: SparkSession) -> frozenset[str]:
    """Define the functions in this session; returns their names, which the read-only policy takes as allowed."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return frozenset(FUNCTIONS)
