"""Name -> (Spark callable, check SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.session import configure

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Entry] = {}
HOME: dict[str, str] = {}
MODULES = ("storage", "columns", "joining", "grouping", "windowing", "ordering", "indicators",
           "market", "signals", "accumulation", "breakout", "backtest", "news", "streams",
           "quality")


def rounded(df: DataFrame, cols: dict[str, int]) -> DataFrame:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), d) + F.lit(0.0)
                           for c, d in cols.items()})


def rounded_sql(sql: str, cols: dict[str, int]) -> str:
    marks = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in cols.items())
    return f"SELECT * REPLACE ({marks}) FROM (\n{sql}\n)"


def query(name: str, sql: str | None = None, round_to: str = "", digits: int = 6):
    """Register a plan; ``round_to`` lists float columns rounded on both sides (name or name:digits)."""
    pairs = [c.partition(":") for c in round_to.split()]
    cols = {c: int(d) if d else digits for c, _, d in pairs}

    def register(fn: Plan) -> Plan:
        @wraps(fn)
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            out = fn(spark, sf_dir)
            return rounded(out, cols) if cols else out

        checked = rounded_sql(sql, cols) if sql and cols else sql
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, plan, checked)
        HOME[name] = fn.__module__
        return plan

    return register


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"barsmith.plans.{module}")
    return REGISTRY
