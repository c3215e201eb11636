"""Reproducible randomness: a hash of salt and key, the same in any partitioning, in retries and in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.text import let


def draw(salt: str, *key: Column) -> Column:
    """A number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long")


def uniform(salt: str, *key: Column) -> Column:
    """A number in [0, 1)."""
    return draw(salt, *key) / F.lit(4294967296.0)


def index(salt: str, n: Column, *key: Column) -> Column:
    """A place from 0 to n - 1; null if n is 0."""
    return F.when(n > 0, draw(salt, *key) % n).cast("int")


def pick(salt: str, items: Column, *key: Column) -> Column:
    return let(items, lambda xs: F.get(xs, index(salt, F.size(xs), *key)))


def sql(salt: str, key: str) -> str:
    """The same draw in SQL."""
    return f"concat('0x', substr(md5('{salt}:' || {key}), 1, 8))::bigint"
