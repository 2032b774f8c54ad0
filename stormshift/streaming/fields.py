"""Cumulative fields of storms whose records still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stormshift.operators.fields import cumulative
from stormshift.sources.records import precipitation


def running_fields(records: DataFrame) -> DataFrame:
    """cumulative() of a stream of gridded records, in update or complete mode: state is a row per storm and cell."""
    return cumulative(precipitation(records, check=False))
