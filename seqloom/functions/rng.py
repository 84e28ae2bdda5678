"""Reproducible uniforms: u = (first 32 bits of md5(key ':' seed) + 0.5) / 2^32, alike in any engine."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str) -> Column:
    """In (0, 1), never 0 or 1, from a string key."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def draw(key: str, seed: int | str) -> float:
    """The same for one key, in Python."""
    return (int(md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def uniform_sql(key: str, seed: int | str) -> str:
    """The same in DuckDB."""
    return f"((('0x' || substr(md5(({key})::VARCHAR || ':{seed}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
