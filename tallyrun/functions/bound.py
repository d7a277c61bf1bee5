"""An expression under a name, as a lambda's variable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often ``then`` names it.

    Lambdas are evaluated and not generated, so that long expressions do not grow a method beyond what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
