"""What operators that run Python in tasks need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package where the session names no path for it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
