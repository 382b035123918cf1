"""Feature-hash embeddings.

An embedding depends on its own text alone, so it is a column: tokens are taken on the JVM, and Arrow batches of
them are hashed (BLAKE2b has no built-in), counted and scaled as arrays. Nothing is shuffled.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as V
from .text import tokens


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _feature_hash(words: pd.Series) -> pd.Series:
    matrix = np.zeros((len(words), V.EMBEDDING_DIMENSIONS))
    lengths = np.array([0 if w is None else len(w) for w in words])
    if lengths.sum():
        flat = np.concatenate([w for w, n in zip(words, lengths) if n])
        codes, distinct = pd.factorize(flat)
        digests = [blake2b(t.encode(), digest_size=8).digest() for t in distinct]
        bucket = np.array([int.from_bytes(d[:4], "big") % V.EMBEDDING_DIMENSIONS for d in digests])
        sign = np.array([1.0 if d[4] & 1 else -1.0 for d in digests])
        np.add.at(matrix, (np.repeat(np.arange(len(words)), lengths), bucket[codes]), sign[codes])
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    unit = np.round(matrix / np.where(norms > 0, norms, 1.0)[:, None], 8).astype(np.float32)
    return pd.Series(list(unit))


def feature_hash(text: Column | str) -> Column:
    """Signed token counts of a text in 384 buckets, scaled to length one."""
    return _feature_hash(tokens(text))


def feature_hash_embedding(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, feature_hash(text).alias("embedding"))
