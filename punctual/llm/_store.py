"""Intermediate tables and row keys shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder the cluster names and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    Every call takes a path of its own.  Files stay until the application's
    shared folder is cleaned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap_bits(n: int, per_entry: int = 32, least: int = 1 << 16, most: int = 1 << 29) -> int:
    """Size of a membership bitmap for n entries: a power of two, at most 64 MB."""
    want = max(least, per_entry * max(n, 1))
    return min(most, 1 << (want - 1).bit_length())


def membership_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of ``column mod bits``, ORed together on the executors.

    The driver receives at most ``bits / 64`` words whatever the input holds.
    """
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (df.where(F.col(column).isNotNull())
             .select(F.shiftright(slot, 6).alias("word"),
                     F.expr(f"shiftleft(1L, cast(({column} & {bits - 1}L) & 63 as int))").alias("mask"))
             .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow())
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
