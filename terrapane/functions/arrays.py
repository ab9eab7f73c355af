"""Array payloads: compressed bytes (the one place that needs Python), statistics, clipping."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def compress_uint8(values: pd.Series) -> pd.Series:
    """Array of class codes to zlib bytes of uint8, level 3."""
    return values.map(lambda v: None if v is None else zlib.compress(np.asarray(v, np.uint8).tobytes(), 3))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decompress_uint8(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(zlib.decompress(b), np.uint8).astype(np.int32))


def scaled_codes(values: Column) -> Column:
    """Numbers of -1 to 1 as whole codes of 0 to 255."""
    return F.transform(values, lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))


def array_stats(values: Column) -> list[Column]:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return [F.array_min(values).cast("double").alias("lowest"), F.array_max(values).cast("double").alias("highest"), (total / F.size(values)).alias("mean")]


def clip(values: Column, low: Column, high: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(low, F.least(high, v)))


def percentile_stretch(values: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Values clipped at two percentiles and scaled to 0..1, within each row's array."""
    s = F.sort_array(values)
    at = lambda q: F.element_at(s, (F.floor((F.size(s) - 1) * q) + 1).cast("int")).cast("double")
    return F.transform(values, lambda v: (F.greatest(at(low), F.least(at(high), v.cast("double"))) - at(low)) / F.nullif(at(high) - at(low), F.lit(0.0)))
