"""Seeded draws that depend only on keys, so they survive any repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rank_key(seed: int, *keys: Column) -> Column:
    """A 32-digit hex string that orders rows at random, the same way each time."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(seed: int, purpose: str, *keys: Column) -> Column:
    """An integer, uniform in [0, 2**32)."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_draw(seed: int, purpose: str, *keys: Column) -> Column:
    """A double, uniform in [0, 1)."""
    return draw(seed, purpose, *keys) / F.lit(4294967296.0)
