"""Query registry: each entry has a Spark function, an output schema and (mostly) a check in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"),
         "b": ("boolean", "BOOLEAN")}
MODULES = ["q_sources", "q_series", "q_stats", "q_joins", "q_fusion", "q_spatial", "q_validate",
           "q_models"]

# Sums of two-decimal inputs often end exactly half way between two roundings, where the order of
# addition decides.  Both sides add the same small amount before rounding.
NUDGE = 3.3e-9

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def query(name: str, covers: str, cols: str, sql: str | None = None, digits: int = 6):
    """Register fn(spark, sf_dir) under `name`.  `cols` ("well:l rmse:d") is the result schema; doubles
    are rounded to `digits` on both sides and -0.0 becomes 0.0."""
    spec = _spec(cols)

    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            out = []
            for c, t in spec:
                e = F.col(c).cast(TYPES[t][0])
                out.append(((F.round(e + NUDGE, digits) + F.lit(0.0)) if t == "d" else e).alias(c))
            return df.select(*out)

        run.__doc__ = fn.__doc__
        run.__mod__ = fn.__module__.split(".")[-1]
        QUERIES[name] = run
        COVERS[name] = covers
        if sql:
            items = ", ".join(
                f"round(CAST({c} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {c}" if t == "d"
                else f"CAST({c} AS {TYPES[t][1]}) AS {c}" for c, t in spec)
            SQL[name] = f"SELECT {items} FROM (\n{sql.strip()}\n) q"
        return fn

    return deco


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"boreline.plans.{m}")
