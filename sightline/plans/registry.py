"""Collects the registered queries of all families."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import configure

FAMILIES = ["coverage", "scanning", "catalog", "operations", "reports", "lineage", "vectors", "streams", "scans", "stored"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that two engines can be compared."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        entries = getattr(import_module(f"sightline.plans.{family}"), attribute)
        clash = out.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(entries)
    return out


def queries() -> dict:
    def configured(fn):
        return lambda spark, base: fn(configure(spark), base)

    return {name: configured(fn) for name, fn in _collect("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
