"""Rows as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): one object a row; null fields are left out, as the JSON writer does."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
