"""Hash embeddings of texts, and their cache by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def hash_vector(text: str | None, dimension: int) -> list[float]:
    """Unit vector of hashed lower-case words (weight 1) and word pairs (weight 0.5); zeros for a text without words."""
    tokens = (text or "").lower().split()
    out = np.zeros(dimension)
    for feature, weight in [*((t, 1.0) for t in tokens), *((f"{a} {b}", 0.5) for a, b in zip(tokens, tokens[1:], strict=False))]:
        out[int.from_bytes(hashlib.sha256(feature.encode()).digest(), "big") % dimension] += weight
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def hash_embedder(dimension: int):
    """Arrow-batched column function text -> array<double>."""

    @pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hash_vector(t, dimension))

    return embed


def with_cached(texts: DataFrame, text: str, cache: DataFrame, missing) -> DataFrame:
    """Add key, vector and hit: vectors from `cache` (key, vector), others by the column function `missing`, once for each distinct text."""
    keyed = texts.withColumn("key", F.sha2(F.col(text), 256))
    new = keyed.join(cache.select("key"), "key", "left_anti").where(F.col("key").isNotNull()).groupBy("key").agg(F.first(text).alias("__text"))
    known = cache.select("key", "vector", F.lit(True).alias("hit")).unionByName(new.select("key", missing(F.col("__text")).alias("vector"), F.lit(False).alias("hit")))
    return keyed.join(known, "key", "left")
