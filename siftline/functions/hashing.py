"""DJB2 over bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes hashed at once: the work needs some twenty times as much memory, whatever the file's size.
BLOCK = 1 << 20


@lru_cache(1)
def _powers() -> np.ndarray:
    """Powers of 33 modulo 2**64, from the highest one that a block needs down to 1."""
    return np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, 33, np.uint64)], dtype=np.uint64)[::-1].copy()


def djb2_bytes(data: bytes, bits: int = 32) -> str:
    """5381 * 33**n + sum of byte_i * 33**(n-1-i), modulo 2**bits, as 16 hex digits."""
    h, values = 5381, np.frombuffer(data, np.uint8)
    for at in range(0, len(values), BLOCK):
        part = values[at : at + BLOCK]
        h = (h * pow(33, len(part), 1 << 64) + int((part * _powers()[BLOCK - len(part) :]).sum(dtype=np.uint64))) % (1 << 64)
    return f"{h & ((1 << bits) - 1):016x}"


def djb2(content: Column, bits: int = 32) -> Column:
    """djb2_bytes() of a binary column, in Arrow batches; null gives null."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else djb2_bytes(bytes(x), bits))

    return run(content)


def djb2_sql(text: Column) -> Column:
    """The 32-bit hash of a text's UTF-8 bytes as an SQL expression; for short texts, as it walks over an array."""
    h = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(h) > 0, F.sequence(F.lit(1), F.length(h) - 1, F.lit(2))).otherwise(F.expr("array()").cast("array<int>"))
    step = F.aggregate(places, F.lit(5381).cast("bigint"), lambda a, i: (a * 33 + F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("bigint")) % F.lit(4294967296))
    return F.lpad(F.lower(F.hex(step)), 16, "0")
