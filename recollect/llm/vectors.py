"""Vectors as exact integers, for the operators that compress and whiten them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this are held to it, so that squares of differences stay exact in 64 bits; it is far from any real embedding.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, scale: int, offset: int = 0) -> DataFrame:
    """vec_id, label, x: floor(scale * component) + offset, as longs, of every usable row.

    Left out are null vectors, those with a null or non-finite component, empty ones, and those of another length than the usable
    vector of the smallest id (of the longest one there, if the id repeats). Integers beyond ``LARGEST`` are held to it. A null id comes behind all others.
    """
    sound = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v"))
    sound = sound.where(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)) & (F.size("_v") > 0))
    first = sound.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", (-F.size("_v")).alias("size"))).alias("f")).first()["f"]
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + offset
    return sound.where(F.size("_v") == (0 if first is None else -first["size"])).select("vec_id", "label", F.transform("_v", whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimension) of a column of arrays of one length."""
    return np.asarray(column.flatten()).reshape(len(column), -1)
