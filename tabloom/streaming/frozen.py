"""Fitted transforms on a stream: they are row-wise or look up a fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import null_tokens
from ..operators.encode import Quantiles, encode_table


def clean_stream(stream: DataFrame) -> DataFrame:
    """Null tokens of text columns become null."""
    return stream.withColumns({c: null_tokens(F.col(f"`{c}`")) for c, kind in stream.dtypes if kind == "string"})


def encode_stream(stream: DataFrame, quantiles: dict[str, Quantiles], vocabulary: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """The encoded stream; null tokens are null before the lookups."""
    return encode_table(clean_stream(stream), quantiles, vocabulary, numeric, categorical)
