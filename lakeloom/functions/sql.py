"""Functions that SQL texts may call by the names they have elsewhere, defined in SQL: the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and result, body.
FUNCTIONS = [
    ("json_extract", "doc STRING, path STRING", "STRING", "get_json_object(doc, path)"),
    ("instr_from", "text STRING, part STRING, start INT", "INT", "locate(part, text, start)"),
    ("flat_name", "text STRING", "STRING", r"upper(regexp_replace(coalesce(text, ''), '[ \\t\\n.]+', ''))"),
    ("share_of", "part DOUBLE, whole DOUBLE", "DOUBLE", "CASE WHEN whole > 0 THEN part / whole ELSE 0 END"),
]


def register_sql(spark: SparkSession) -> list[str]:
    """The names of the functions, after they have been defined for this session (anew, if they were)."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
