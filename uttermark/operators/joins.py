"""Joins that keep NULL keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys meet each other. It also adds no IS NOT NULL
    filter below the join, so branches of one source keep the same exchange."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        condition = same if i == 0 else condition & same
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys]) if how != "left_anti" else joined


def merge_by_key(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key out of tables that hold at most one row per key each."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in merged.columns if c not in keys]
    return merged.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])
