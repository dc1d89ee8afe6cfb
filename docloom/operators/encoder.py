"""Encoders turn texts into vectors; a search takes any function with this one's parameters and columns.

encode(df, key, text) returns df with words (array<string>) and dense (array<double>; null where there is nothing to
encode). hashed() needs no model: each word's digest chooses its place in the dense vector and its sign.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.search import words

DIMENSIONS, KNOWN_WORDS = 16, 500_000


class Places(dict):
    """Of each word its place, and whether it counts down, as one number; worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        self[word] = code = int(digest[0], 16) * 2 + (int(digest[8], 16) >= 8)
        return code


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Row by row: key, which other encoders may need, isn't looked at."""
    own = df.withColumn("words", F.coalesce(words(text), F.array().cast("array<string>")))

    def run(batches):
        places = Places()
        for batch in batches:
            if len(places) > KNOWN_WORDS:
                places.clear()
            column = batch.column(batch.schema.get_field_index("words"))
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            code = np.fromiter(map(places.__getitem__, column.flatten().to_pylist()), np.int64, int(sizes.sum()))
            cell = np.repeat(np.arange(len(sizes)), sizes) * DIMENSIONS + code // 2
            sums = np.bincount(cell, 1.0 - 2 * (code % 2), minlength=len(sizes) * DIMENSIONS)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * DIMENSIONS)
            dense = pa.ListArray.from_arrays(offsets, pa.array(sums), mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, dense], names=[*batch.schema.names, "dense"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("dense", T.ArrayType(T.DoubleType()))]))
