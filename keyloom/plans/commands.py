"""The catalogue of operators, read from the modules themselves."""

from __future__ import annotations

import importlib
import inspect
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from .. import functions, operators, sources, streaming


def catalogue(spark: SparkSession) -> DataFrame:
    """Every public function of the library: ``family``, ``name``, ``arguments`` and the first line of its description."""
    rows = []
    for package in (operators, functions, sources, streaming):
        for found in pkgutil.iter_modules(package.__path__):
            module = importlib.import_module(f"{package.__name__}.{found.name}")
            for name, f in inspect.getmembers(module, inspect.isfunction):
                if f.__module__ == module.__name__ and not name.startswith("_"):
                    rows.append((found.name, name, ", ".join(inspect.signature(f).parameters), (f.__doc__ or "").strip().split("\n")[0]))
    return spark.createDataFrame(sorted(rows), "family string, name string, arguments string, description string")
