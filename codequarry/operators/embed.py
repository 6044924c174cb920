"""Embedders. The default is a deterministic hash embedder, so that everything runs offline."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"[A-Z]?[a-zà-öø-ÿ]+|[A-Z]+(?![a-z])|\d+")


def hash_embed(texts: list[str], dim: int) -> np.ndarray:
    """Signed feature hashing of word parts and their trigrams, of length 1; empty texts give zeros."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in TOKEN.findall(t or ""):
            w = w.lower()
            for part in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                h = zlib.crc32(part.encode())
                out[i, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed_column(df: DataFrame, text_col: str, dim: int, embed: Callable[[list[str], int], np.ndarray] = hash_embed) -> DataFrame:
    """Adds ``vec``; the texts go to the embedder in Arrow batches, which is where a service would be called."""
    cols = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vec array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = embed(b.column(text_col).to_pylist(), dim)
            flat = pa.array(x.reshape(-1), pa.float32())
            offsets = pa.array(np.arange(0, (len(x) + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], [*cols, "vec"])

    return df.mapInArrow(run, schema)
