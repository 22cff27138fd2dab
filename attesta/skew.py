"""Attaching one-row-per-key results to rows whose keys may be very uneven."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``per_key`` (one row per key) to ``rows``; null keys stay unmatched.

    A key with very many rows makes one large partition of ``rows``. Spark splits that at run time and
    hands the key's single row to every part (``session.SETTINGS`` forces the split), so there is one
    plan for all sizes, and nothing is broadcast unless its measured size allows it.
    """
    values = [c for c in per_key.columns if c not in keys]
    right = per_key.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *values)
    out = rows.join(right, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left")
    return out.select(*[F.col(c) for c in rows.columns], *values)


def ordered(order: Sequence[str]) -> Column:
    """Sort key for ``min_by``/``max_by``: the struct of the ordering columns."""
    return F.struct(*[F.col(c) for c in order])
