"""Operators that look at one row at a time, and windowed counts, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import secret_tokens, token_estimate


def annotate(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stream with sha256, token estimate and number of secret tokens of each text."""
    return stream.withColumns({"sha256": F.sha2(F.col(text).cast("binary"), 256), "n_tokens": token_estimate(F.col(text)), "n_secrets": F.size(secret_tokens(F.col(text)))})


def banded_counts(stream: DataFrame, time: str, value: str, width: float, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows by time window and band of a number; what comes later than `late` is dropped by the watermark."""
    from ..operators.groups import band

    held = stream.withWatermark(time, late).where(F.col(value).isNotNull())
    return held.groupBy(F.window(time, window), band(F.col(value), width).alias("lower")).agg(F.count(F.lit(1)).alias("n"))
