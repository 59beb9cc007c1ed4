"""Sums of fixed-size integer arrays over tasks, by a tree of bounded fan-in.

A task's array travels in compressed pieces; pieces of zeros don't travel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN, PIECE, PER_ARRAY = 16, 1 << 17, 1 << 12
SCHEMA = "stripe int, counts binary"


def pieces(arrays: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Stripe numbers and compressed contents of the arrays (int64)."""
    stripes, contents = [], []
    for k, array in enumerate(arrays):
        for j in range(0, len(array), PIECE):
            part = np.ascontiguousarray(array[j : j + PIECE], np.int64)
            if part.any():
                stripes.append(k * PER_ARRAY + j // PIECE)
                contents.append(zlib.compress(part.tobytes(), 1))
    return stripes, contents


def piece_rows(arrays: list[np.ndarray]) -> pa.RecordBatch:
    stripes, contents = pieces(arrays)
    return pa.RecordBatch.from_arrays([pa.array(stripes, pa.int32()), pa.array(contents, pa.binary())], names=["stripe", "counts"])


def _add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for raw in frame["counts"]:
        total = total + np.frombuffer(zlib.decompress(raw), np.int64)
    return pd.DataFrame({"stripe": [key[0]], "part": [key[1]], "counts": [zlib.compress(total.tobytes(), 1)]})


def sum_arrays(stripes: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The sums of the arrays of the given sizes.  Pieces are few and of fixed size; only sums reach the driver."""
    n = max([r["n"] for r in stripes.groupBy("stripe").agg(F.count("*").alias("n")).collect()], default=0)
    level = stripes.select("stripe", F.abs(F.xxhash64("counts")).alias("part"), "counts")
    while n > 0:
        n = -(-n // FAN_IN)
        level = level.withColumn("part", F.pmod("part", F.lit(n))).groupBy("stripe", "part").applyInPandas(_add_up, "stripe int, part long, counts binary")
        if n == 1:
            break
    out = [np.zeros(size, np.int64) for size in sizes]
    for r in level.collect():
        k, j = divmod(r["stripe"], PER_ARRAY)
        part = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[k][j * PIECE : j * PIECE + len(part)] = part
    return out
