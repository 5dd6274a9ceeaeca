"""Queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Enter a query, and its SQL if it has one, under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    import strandline.llm.queries as package

    for mod in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{mod.name}")
    import corpus_pipeline

    register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


_load()
