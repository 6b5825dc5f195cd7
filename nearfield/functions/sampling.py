"""Seeded samples and orders that a rerun repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order(seed: int, *keys: str | Column) -> Column:
    """A pseudo-random order of rows by their keys."""
    return F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])


def sample_rows(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows without repetition, all if there are no more; a top-k, so that no task holds over k rows."""
    return rows.orderBy(order(seed, *keys), *keys).limit(k)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(order(seed, *keys), *keys)
