"""Registered queries: a Spark plan, its output columns and, where SQL can state it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Build
    sql: str | None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        out = []
        for column, kind in self.columns:
            c = F.col(f"`{column}`")
            if kind == "i":
                c = c.cast("bigint")
            elif kind == "d":
                c = F.floor(c.cast("double") * 1e6 + 0.5001) / 1e6
            elif kind == "e":
                c = F.floor(c.cast("double") * 1e3 + 0.5001) / 1e3
            elif kind == "s":
                c = c.cast("string")
            elif kind == "t":
                c = c.cast("timestamp_ntz")
            out.append(c.alias(column))
        return self.build(spark, folder).select(*out)

    def oracle(self, tables: dict[str, tuple[tuple[str, ...], str]]) -> str | None:
        if self.sql is None:
            return None
        shape = {"i": "CAST({0} AS BIGINT)", "d": "FLOOR(CAST({0} AS DOUBLE) * 1e6 + 0.5001) / 1e6", "e": "FLOOR(CAST({0} AS DOUBLE) * 1e3 + 0.5001) / 1e3",
                 "s": "CAST({0} AS VARCHAR)", "t": "CAST({0} AS TIMESTAMP)", "b": "CAST({0} AS BOOLEAN)"}
        listed = ", ".join(f'{shape[k].format(chr(34) + c + chr(34))} AS "{c}"' for c, k in self.columns)
        needed = _needed(self.sql, tables)
        parts = [f"{n} AS ({tables[n][1]})" for n in needed] + [f"answer AS ({self.sql})"]
        return "WITH " + ",\n".join(parts) + f"\nSELECT {listed} FROM answer"


def _needed(sql: str, tables: dict[str, tuple[tuple[str, ...], str]]) -> list[str]:
    import re

    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for other in tables[name][0]:
            visit(other)
        out.append(name)

    for name in tables:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return out


def query(name: str, columns: str, build: Build, sql: str | None = None) -> Query:
    """``columns`` lists "name:kind": i integer, d double to 6 places, e double to 3, s text, t time, b boolean.

    Doubles are rounded a hair off the half, so that sums in another order cannot tip a tie.
    """
    pairs = tuple(tuple(c.split(":")) for c in columns.split())
    return Query(name, pairs, build, sql)
