"""Reproducible choice: an order and a fraction from md5, in place of a random generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(digest: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_fraction(digest: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits."""
    return hash_int(digest) / F.lit(4294967296.0)
