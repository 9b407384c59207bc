"""Jump consistent hash (OP-42), the shard of a document id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the multiplier of the published algorithm's generator.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Of unsigned 64-bit keys, all keys at once: each round moves the keys that still jump."""
    state = keys.astype(np.uint64)
    bucket = np.zeros(len(state), dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            bucket[moving] = ahead[moving]
            state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
            step = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[moving] = ((bucket[moving] + 1) * (float(1 << 31) / step)).astype(np.int64)
            moving = moving[ahead[moving] < buckets]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Null keys have no shard."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf(T.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series([None] * len(keys), dtype="Int32", index=keys.index)
        if known.any():
            out[known] = jump_buckets(keys[known].astype("int64").to_numpy().view(np.uint64), shards).astype("int32")
        return out

    return run(key.cast("long"))
