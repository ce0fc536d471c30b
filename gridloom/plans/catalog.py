"""All named queries of the cube engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cube, desk, model, worksheets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return cube.QUERIES | desk.QUERIES | model.QUERIES | worksheets.QUERIES


def oracle_sql() -> dict[str, str]:
    return cube.SQL | desk.SQL | model.SQL | worksheets.SQL
