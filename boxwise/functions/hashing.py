"""Stable pseudo-random numbers from SHA-256: same value on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256)


def hash_rank(seed, namespace, key: Column) -> Column:
    """First 128 bits of SHA-256("seed:namespace:key") as hex; its order is the rank order."""
    return F.substring(_digest(seed, namespace, key), 1, 32)


def hash_uniform(seed, namespace, key: Column) -> Column:
    """Uniform in (0, 1) from the first 52 bits of the same digest (exact in a double)."""
    bits = F.conv(F.substring(_digest(seed, namespace, key), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def little_endian_seed(text: Column) -> Column:
    """First 8 digest bytes read little-endian, as 16 hex digits of the unsigned value."""
    digest = F.sha2(text, 256)
    return F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
