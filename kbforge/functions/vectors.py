"""Vector expressions: the built-in hashing embedder and cosine distance.

Embedding is pluggable (VEC-1).  An *embedder* is any object with
``embed(df, text_col, out_col) -> DataFrame`` adding an ``array<double>`` column;
the same object must embed corpus documents and questions.  Two are provided:

* :class:`HashingEmbedder` (default, offline): lower-cased letter/digit tokens,
  bucket = first 8 hex digits of ``md5(token)`` as an integer modulo ``dim``,
  vector = token counts per bucket.  Tokenising and hashing run in the JVM; only
  the final ``bincount`` of each row's bucket list runs in an Arrow batch UDF.
* :class:`BatchModelEmbedder`: wraps a caller-supplied ``encode(list[str]) ->
  ndarray`` (for example an ONNX sentence model available on the workers) behind
  ``mapInPandas`` with one model instance per Python worker.

Vectors are left unnormalised: cosine is scale-free and integer counts keep the
dot products exact, so every engine computes bit-identical distances.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens

DEFAULT_DIM = 256
# Buckets that a task counts at once; a batch of long texts has many more.
BUCKETS_AT_ONCE = 1_000_000


def token_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<int> of hash buckets, one per token (JVM side)."""
    return F.transform(
        tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                         F.lit(dim)).cast("int"),
    )


def _bincount_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bincount(buckets: pd.Series) -> pd.Series:
        # rows are counted together, as many as have BUCKETS_AT_ONCE buckets
        n, values = len(buckets), buckets.to_numpy()
        valid = buckets.notna().to_numpy()
        lens = np.array([len(b) if ok else 0 for b, ok in zip(values, valid)], dtype=np.int64)
        ends = np.cumsum(lens)
        m = np.zeros((n, dim), dtype=np.float64)
        at = 0
        while at < n:
            most = ends[at] - lens[at] + BUCKETS_AT_ONCE
            stop = max(at + 1, int(np.searchsorted(ends, most, side="right")))
            if ends[stop - 1] > ends[at] - lens[at]:
                flat = np.concatenate([values[i] for i in range(at, stop) if lens[i]]).astype(np.int64)
                flat += np.repeat(np.arange(stop - at), lens[at:stop]) * dim
                m[at:stop] = np.bincount(flat, minlength=(stop - at) * dim).reshape(stop - at, dim)
            at = stop
        return pd.Series([m[i] if valid[i] else None for i in range(n)])
    return bincount


class HashingEmbedder:
    """Feature-hashing bag-of-words embedder (see module doc).

    ``normalize=True`` returns unit-length vectors (L2); cosine results are the
    same either way, raw counts keep distances exact across engines.
    """

    def __init__(self, dim: int = DEFAULT_DIM, normalize: bool = False):
        self.dim = dim
        self.normalize = normalize
        self._udf = _bincount_udf(dim)

    def column(self, text: Column) -> Column:
        v = self._udf(token_buckets(text, self.dim))
        if not self.normalize:
            return v
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return df.withColumn(out_col, self.column(F.col(text_col)))


# Fixed value: texts per call of an embedding model.
MODEL_BATCH = 128

# Models loaded by BatchModelEmbedder, one per Python worker process.
_MODELS: dict = {}


class BatchModelEmbedder:
    """Runs ``encode(list_of_texts) -> 2-D array`` on ``batch_size`` texts at a time.

    ``factory`` is called lazily once per Python worker, so large models load once
    per executor process rather than once per row or per task.
    """

    def __init__(self, factory: Callable[[], Callable[[list], np.ndarray]], dim: int,
                 cache_key: str | None = None, batch_size: int = MODEL_BATCH):
        self.factory = factory
        self.batch_size = batch_size
        self.dim = dim
        # workers cache one model per key: the factory's identity unless given
        name = getattr(factory, "__qualname__", "")
        stable = name and "<lambda>" not in name and "<locals>" not in name
        self._token = cache_key or (f"{getattr(factory, '__module__', '')}.{name}" if stable else uuid.uuid4().hex)

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        factory, token, size = self.factory, self._token, self.batch_size
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from kbforge.functions import vectors as _self   # per-process model registry
            if token not in _self._MODELS:
                _self._MODELS[token] = factory()
            encode = _self._MODELS[token]
            for pdf in batches:
                texts = pdf[text_col].fillna("").tolist()
                pdf[out_col] = [v for at in range(0, len(texts), size)
                                for v in np.asarray(encode(texts[at:at + size]), dtype=np.float64)]
                yield pdf

        return df.mapInPandas(run, schema)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equal-length numeric arrays (JVM expression)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """VEC-2: ``1 - cos(a, b)``; 1.0 when either vector is all zeros."""
    num = dot(a, b)
    den = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(den == 0, F.lit(1.0)).otherwise(F.lit(1.0) - num / den)


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`cosine_distance` of the rows of two matrices, bit by bit: numbers are summed up in the same order."""
    a, b = np.ascontiguousarray(a.T, np.float64), np.ascontiguousarray(b.T, np.float64)
    ab, aa, bb = np.zeros((3, a.shape[1]))
    for x, y in zip(a, b, strict=True):
        ab += x * y
        aa += x * x
        bb += y * y
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        den = np.sqrt(aa * bb)
        return np.where(den == 0, 1.0, 1.0 - ab / den)
