"""Embedders: a name, and a column of vectors for a column of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens

#: Token vectors that a task remembers from piece to piece, at most.
CACHE_TOKENS = 131_072
#: Tokens that a task takes at once.
PIECE = 131_072


class Embedder(Protocol):
    model_name: str

    def embed(self, rows: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


def token_vector(token: str, dim: int) -> np.ndarray:
    """Big-endian 32-bit integers of the SHA-256 of "0:token", "1:token" and so on, over 2**31."""
    return np.frombuffer(_digests(token, dim), ">i4") / 2.0**31


def _digests(token: str, dim: int) -> bytes:
    own = token.encode()
    return b"".join([hashlib.sha256(b"%d:%b" % (i, own)).digest() for i in range(-(-dim // 8))])[: 4 * dim]


def _token_vectors(tokens: list[str], dim: int, known: dict[str, bytes]) -> np.ndarray:
    """The vectors of `tokens`, a row each; `known` keeps the digests of up to CACHE_TOKENS of them."""
    found = []
    for t in tokens:
        own = known.get(t)
        if own is None:
            if len(known) >= CACHE_TOKENS:
                known.clear()
            own = known[t] = _digests(t, dim)
        found.append(own)
    return np.frombuffer(b"".join(found), ">i4").reshape(-1, dim) / 2.0**31


class HashEmbedder:
    """Deterministic vectors without a model: the sum of the token vectors, of length 1. A text without tokens has the zero vector."""

    model_name = "hash-fake"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, rows: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        dim = self.dim

        @F.arrow_udf("array<double>")
        def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, bytes] = {}
            for column in columns:
                flat, ends = column.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
                out = np.zeros((len(column), dim))
                # A piece may begin and end within a text: sums of 32-bit numbers over 2**31 are exact in any order.
                for start in range(0, len(flat), PIECE):
                    coded = flat.slice(start, PIECE).dictionary_encode()
                    table = _token_vectors(coded.dictionary.to_pylist(), dim, known)
                    code = coded.indices.to_numpy()
                    first, last = np.searchsorted(ends, [start, start + len(code) - 1], "right")
                    for i, own in enumerate(np.split(code, ends[first:last] - start), first):
                        used, times = np.unique(own, return_counts=True)
                        out[i] += times @ table[used]
                size = np.sqrt((out * out).sum(axis=1))
                out /= np.where(size > 0, size, 1)[:, None]
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))

        return rows.withColumn(out_col, vectors(tokens(F.col(text_col))))


class SentenceTransformerEmbedder:
    """Unit vectors of a sentence-transformers model, loaded once in each worker."""

    def __init__(self, model_name: str):
        self.model_name = model_name

    def embed(self, rows: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        name = self.model_name
        try:
            import sentence_transformers  # noqa: F401
        except ImportError as e:
            raise RuntimeError("this embedding model needs the sentence-transformers package; use hash-fake without it") from e

        @F.pandas_udf("array<double>")
        def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name)
            for column in columns:
                found = model.encode(column.fillna("").tolist(), normalize_embeddings=True)
                yield pd.Series([v.astype(float) for v in found])

        return rows.withColumn(out_col, vectors(F.col(text_col)))


def build_embedder(name: str) -> Embedder:
    return HashEmbedder() if name == HashEmbedder.model_name else SentenceTransformerEmbedder(name)
