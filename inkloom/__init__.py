"""inkloom: curation and evaluation of versioned text corpora on Spark DataFrames.

Python workers import the package by name. Where it is run from a checkout that
is not on their path, the checkout is put there, for sessions that exist and
for those that start later on this machine; clusters ship it with --py-files.
"""

import os
import sys
from pathlib import Path

from pyspark import SparkContext

_ROOT = str(Path(__file__).resolve().parents[1])


def _on_path(value: str | None) -> str:
    parts = (value or "").split(os.pathsep)
    return value if value and _ROOT in parts else os.pathsep.join([_ROOT, *filter(None, parts)])


if "pyspark.worker" not in sys.modules:
    os.environ["PYTHONPATH"] = _on_path(os.environ.get("PYTHONPATH"))
    if SparkContext._active_spark_context is not None:
        _environment = SparkContext._active_spark_context.environment
        _environment["PYTHONPATH"] = _on_path(_environment.get("PYTHONPATH"))
