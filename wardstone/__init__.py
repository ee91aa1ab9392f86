"""Security analytics on Spark DataFrames."""

import os
from pathlib import Path

from pyspark import SparkContext


def _reachable() -> None:
    """Python workers import this package from where the driver did, whether the JVM starts later or runs already."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]


_reachable()
