"""Giving the package to executors that cannot import it by themselves."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from heliotable.plans.durable import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once a session, unless PYTHONPATH already leads there."""
    package = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if any(p and Path(p).resolve() == package.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    if not folder.is_dir():
        return  # a remote store: there the package is installed with the job
    archive = folder / f"{package.name}-{sc.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
