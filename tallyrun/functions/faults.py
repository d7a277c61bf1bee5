"""Faults as data: a code with the line, key and value it was found at. Texts for people are made from these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULT = "struct<code:string,line:int,key:string,value:string>"


def fault(code: Column | str, line: Column | None = None, key: Column | str | None = None, value: Column | None = None) -> Column:
    """One fault; ``line`` counts from 1, and what is not known is null."""
    text = lambda c: F.lit(c).cast("string")
    at = F.lit(None) if line is None else line
    return F.struct(text(code).alias("code"), at.cast("int").alias("line"), text(key).alias("key"), text(value).alias("value"))


def told(found: Column) -> Column:
    """``code line=… key=… value=…`` with the parts that are known; null for no fault."""
    parts = [F.concat(F.lit(f"{n}="), found[n].cast("string")) for n in ("line", "key", "value")]
    return F.when(found.isNotNull(), F.concat_ws(" ", found["code"], *parts))


def first_null(columns: dict[str, Column]) -> Column:
    """The name of the first column that is null, or null."""
    return F.coalesce(*(F.when(c.isNull(), F.lit(name)) for name, c in columns.items()))
