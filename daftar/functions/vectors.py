"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.text import col


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null where a vector is all zeros."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def triplet_loss(anchor: Column | str, positive: Column | str, negative: Column | str, margin: float = 1.0, eps: float = 1e-6) -> Column:
    """max(|a - p| - |a - n| + margin, 0), eps added to every difference."""

    def far(x: Column | str, y: Column | str) -> Column:
        return F.sqrt(_sum(F.zip_with(col(x), col(y), lambda u, v: (u.cast("double") - v.cast("double") + eps) * (u.cast("double") - v.cast("double") + eps))))

    return F.greatest(far(anchor, positive) - far(anchor, negative) + margin, F.lit(0.0))


def linear(x: Column | str, w: Column | str, b: Column | str) -> Column:
    """W x + b for W an array of rows."""
    return F.zip_with(F.transform(col(w), lambda row: dot(row, col(x))), col(b), lambda y, z: y + z)


def warmup_schedule(step: Column | str, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear up to the warm-up's end, then linear down to 0."""
    s = col(step).cast("double")
    return F.when(s < warmup, s / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (F.lit(float(total)) - s) / max(1, total - warmup)))
