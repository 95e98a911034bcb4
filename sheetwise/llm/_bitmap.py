"""A set of 64-bit numbers as a bitmap of bounded size, to drop rows early.

It answers "perhaps" or "no", so a full one costs time and changes nothing. Its size follows the count of numbers up
to MOST_BITS, so what is broadcast has a fixed bound whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26


class Bitmap:
    def __init__(self, df: DataFrame, column: str, count: int):
        """df's `column` (bigint) holds `count` numbers or so."""
        spark = df.sparkSession
        bits = 1 << 20
        while bits < MOST_BITS and bits < 32 * count:
            bits *= 2
        place = F.pmod(F.col(column), F.lit(bits)) + 1  # the bucket functions count from 1
        made = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
        data = np.zeros(bits // 8, np.uint8)
        for r in made.toLocalIterator():
            data[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bitmap), np.uint8)
        self.bits, self._data = bits, spark.sparkContext.broadcast(data)

    def perhaps(self, values: np.ndarray) -> np.ndarray:
        """For int64 numbers (uint64 ones count as their two's complement)."""
        p = np.mod(values.view(np.int64), np.int64(self.bits))
        data = self._data.value
        return (data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
