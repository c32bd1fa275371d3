"""Vector similarity and the vector codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quillgraph.functions.text import cosine

FLOOR = 0.40


def top_similar(vectors: DataFrame, query: list[float], limit: int = 10, floor: float = FLOOR, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, score of the most similar vectors at ``floor`` or above; vectors of another length are ignored."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.size(vector) == len(query)).select(key, cosine(F.col(vector), q).alias("score"))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), key).limit(limit)


@pandas_udf(T.StringType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Base64 of big-endian 32-bit floats."""
    import base64

    # all vectors of a batch become bytes at once; only the cuts between them are made one by one
    there = v.notna().to_numpy()
    sizes = np.array([4 * len(x) for x in v[there]], np.int64)
    raw = np.concatenate(v[there].to_list()).astype(">f4").tobytes() if sizes.sum() else b""
    ends = np.cumsum(sizes)
    out = np.full(len(v), None, object)
    out[there] = [base64.b64encode(raw[a:b]).decode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(s: pd.Series) -> pd.Series:
    import base64

    there = s.notna().to_numpy()
    parts = [base64.b64decode(x) for x in s[there]]
    values = np.frombuffer(b"".join(parts), ">f4").astype(np.float32)
    ends = np.cumsum([len(p) // 4 for p in parts])
    out = np.full(len(s), None, object)
    for i, x in zip(np.flatnonzero(there).tolist(), np.split(values, ends[:-1]) if parts else [], strict=True):
        out[i] = x
    return pd.Series(out)


def needs_embedding(model: Column, size: Column, source_hash: Column, now_model: str, now_size: int, now_hash: Column) -> Column:
    """Missing, of another model or length, or of other text."""
    return model.isNull() | (model != now_model) | size.isNull() | (size != now_size) | source_hash.isNull() | (source_hash != now_hash)
