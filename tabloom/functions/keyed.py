"""Random numbers that depend on a row's key, not on partitions or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, seed: int | Column, stream: str = "u") -> Column:
    """Uniform in [0, 1): the first 52 bits of an MD5 of seed, stream and key."""
    key = F.col(key) if isinstance(key, str) else key
    name = F.concat(seed.cast("string"), F.lit(f":{stream}:")) if isinstance(seed, Column) else F.lit(f"{seed}:{stream}:")
    bits = F.substring(F.md5(F.concat(name, key.cast("string")).cast("binary")), 1, 13)
    return F.conv(bits, 16, 10).cast("double") / F.lit(float(2**52))


def normal(key: Column | str, seed: int | Column, stream: str = "n") -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1, u2 = uniform(key, seed, stream + "1"), uniform(key, seed, stream + "2")
    return F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-7)))) * F.cos(2 * math.pi * u2)


def uniform_sql(key: str, seed: int, stream: str = "u") -> str:
    """The same uniform in DuckDB."""
    return f"(CAST('0x' || substr(md5('{seed}:{stream}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)"


def normal_sql(key: str, seed: int, stream: str = "n") -> str:
    return f"(sqrt(-2.0 * ln(greatest({uniform_sql(key, seed, stream + '1')}, 1e-7))) * cos(2 * pi() * {uniform_sql(key, seed, stream + '2')}))"
