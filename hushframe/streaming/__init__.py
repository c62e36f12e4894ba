"""Streams: tokenization without state, and nullifiers seen before. Extensions of our own: the surveyed capabilities hold no streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TEST_KEY, Key, token


def tokenized(stream: DataFrame, fields: dict[str, str], key: Key = TEST_KEY) -> DataFrame:
    """fields: column to type of token. Works on streams and tables alike, without state."""
    return stream.withColumns({c: token(kind, F.col(c), key) for c, kind in fields.items()})


def first_seen(stream: DataFrame, nullifier: str = "nullifier", time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each nullifier; a replay within `late` of it is dropped, and state older than that is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([nullifier])


def counted(stream: DataFrame, by: list[Column], time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of each group and window of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
