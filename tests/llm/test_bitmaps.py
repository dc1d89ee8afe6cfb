"""Bitmaps that the driver holds."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import op5_ngram_join as five


def test_bitmaps_grow_with_their_rows(spark):
    few = spark.range(100).select(F.col("id").alias("doc_id"))
    size = five.bits_for(few)
    assert size == five.BUCKET
    bits = np.frombuffer(five.bitmap(few, size), np.uint8)
    assert len(bits) == size // 8
    at = [r[0] for r in few.select(five.bit_of("doc_id", size)).collect()]
    assert all(bits[i >> 3] >> (i & 7) & 1 for i in at) and np.unpackbits(bits).sum() == len(set(at))
    assert five.bits_for(spark.range(1 << 23)) == 1 << five.BITMAP_BITS
    assert 16 * 50_000 <= five.bits_for(spark.range(50_000)) < 32 * 50_000
    assert five.bits_for(few.limit(0)) == five.BUCKET
