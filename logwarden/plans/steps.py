"""Steps whose results are kept: run once, read back afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logwarden.operators.models import path_exists


def is_materialized(spark: SparkSession, path: str) -> bool:
    """A table counts as present once its job has committed."""
    return path_exists(spark, f"{path}/_SUCCESS")


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; built and written first when missing or forced."""
    if force or not is_materialized(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_steps(steps: dict[str, Callable[[], object]], skip_errors: bool = False) -> dict[str, str]:
    """Runs steps in order and reports each as ``done`` or ``failed: ...``.

    A failure ends the run unless ``skip_errors`` is set.
    """
    report = {}
    for name, step in steps.items():
        try:
            step()
            report[name] = "done"
        except Exception as error:
            if not skip_errors:
                raise
            report[name] = f"failed: {error}"
    return report


def available(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Names whose tables are present below ``folder``."""
    return [n for n in names if is_materialized(spark, f"{folder}/{n}")]
