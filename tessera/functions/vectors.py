"""Vector functions: cosine distance on arrays and a deterministic hash embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - dot(a, b) / norms)


def hash_embed(dims: int = 64):
    """Pandas UDF: tokens hashed to signed dimensions, unit length; no tokens give zeros. Equal texts, equal vectors."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(dims)
            for token in (text or "").lower().split():
                digest = hashlib.sha256(token.encode()).digest()
                v[int.from_bytes(digest[:4], "big") % dims] += 1.0 if digest[4] & 1 else -1.0
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).tolist()

        return texts.map(one)

    return embed
