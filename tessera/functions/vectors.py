"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.limits import NORM_TOLERANCE


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def finite(vector: Column) -> Column:
    return F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def vector_error(vector: Column, dimensions: Column) -> Column:
    """Why a vector cannot be stored, or null."""
    sized = (F.size(vector) == dimensions) & finite(vector)
    return (
        F.when(
            vector.isNull() | ~F.coalesce(sized, F.lit(False)),
            "embedding has invalid dimensions or values",
        )
        .when(
            F.abs(F.sqrt(squared_norm(vector)) - 1.0) > NORM_TOLERANCE,
            "embedding must be L2-normalized",
        )
    )


def l2_normalize(vector: Column) -> Column:
    """Unit vector, or null where the norm is zero or not finite."""
    norm = F.sqrt(squared_norm(vector))
    usable = finite(vector) & (norm > 0) & (norm < F.lit(float("inf")))
    return F.when(usable, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float")))


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision, added from left to right."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
