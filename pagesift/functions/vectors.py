"""Vector expressions in double precision, for projections and one-off comparisons.

Ranking many queries against many pages uses the packed-block operators in
``pagesift.operators.search``; these expressions are the readable definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Dot product; NULL when either side is NULL."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is, NULL stays NULL."""
    norm = F.aggregate(
        v,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda total: F.when(total > 0, F.sqrt(total)).otherwise(F.lit(1.0)),
    )
    scaled = F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n)
    return F.when(v.isNotNull(), scaled)
