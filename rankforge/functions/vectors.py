"""Row-wise vector functions over ARRAY<DOUBLE> columns (native higher-order functions).

Use these for per-row arithmetic on narrow vectors. Search over many candidates uses the
Arrow/NumPy batch path in ``operators.search`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector on either side gives 0.0."""
    den = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def l2_normalize(v) -> Column:
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.coalesce(x / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


def dot_score(a, b) -> Column:
    """Dot product of the unit vectors, times 100."""
    return dot(l2_normalize(a), l2_normalize(b)) * F.lit(100.0)

