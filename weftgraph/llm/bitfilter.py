"""Bit filters of fixed size that spare rows without a partner the shuffle of a join.

A filter has no misses and, while the keys are few for its size, few false
alarms; with more keys it only spares less.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_bits(places: DataFrame, bits: int) -> np.ndarray:
    """A bit filter of fixed size as bytes, from (place, byte) rows that are combined before they are sent."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    table = places.groupBy("place").agg(F.bit_or("byte").alias("byte")).toArrow()
    out[table.column("place").to_numpy()] = table.column("byte").to_numpy()
    return out


#: Bits of the filter of ``may_match`` (2 MB, whatever the input).
FILTER_BITS = 1 << 24


def marked_by(df: DataFrame, key: str, others: DataFrame, mark: str) -> DataFrame:
    """``df`` with a column that is false only where no row of ``others`` has the same ``key``; nulls are false.

    The keys of ``others`` are sent as a bit filter of fixed size, so most rows
    without a partner need not be shuffled to a join.
    """
    place = lambda: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    places = others.where(F.col(key).isNotNull()).select(F.shiftright(place(), 3).alias("place"), F.call_function("shiftleft", F.lit(1), F.pmod(place(), F.lit(8)).cast("int")).alias("byte"))
    bits = filter_bits(places, FILTER_BITS)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return df.withColumn(mark, F.col(key).isNotNull() & held(place()))


def may_match(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` some row of ``others`` may have."""
    return marked_by(df, key, others, "_may").where("_may").drop("_may")
