"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import adapt

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

G = f"WITH {adapt.GAMES_SQL}\n"
P = f"WITH {adapt.PREDICTIONS_SQL}\n"
#: Seconds since 1970 of game_date in DuckDB.
T = "CAST(floor(epoch(game_date)) AS BIGINT)"


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame; sql is its twin over the tables as views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded to 6 digits, without a negative zero, so that both engines hash alike."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with all doubles rounded."""
    return df.select(*(r6(c, c, digits) if t == "double" else F.col(c) for c, t in df.dtypes))


def s6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def s9(expr: str, name: str) -> str:
    return f"round({expr}, 9) + 0.0 AS {name}"
