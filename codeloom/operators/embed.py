"""Embedding of symbol sources: which are due, how they are encoded, and where they go."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import callable_kind
from codeloom.operators.upserts import upsert
from codeloom.schema import KEYS, conform
from codeloom.store import Graph


class Provider(Protocol):
    name: str
    dimensions: int
    batch_size: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingProvider:
    """Signed feature hashing of identifiers' parts; needs no model and is the same everywhere."""

    dimensions: int = 384
    batch_size: int = 32
    name: str = "hashing-v1"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", text):
                h = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
                out[row, h % self.dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32).tolist()


class DimensionMismatch(ValueError):
    """Stored vectors have another length than the provider's."""


def embed_candidates(symbols: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Symbols (qualified_name, source, source_hash, due): not due where hash and model are those stored; empty sources never."""
    own = symbols.where(F.length(F.coalesce("source", F.lit(""))) > 0).select("qualified_name", "source", F.sha2("source", 256).alias("source_hash"))
    old = stored.select("qualified_name", F.col("source_hash").alias("old_hash"), F.col("model").alias("old_model"))
    same = (F.col("source_hash") == F.col("old_hash")) & (F.col("old_model") == model)
    return own.join(old, "qualified_name", "left").select("qualified_name", "source", "source_hash", (~F.coalesce(same, F.lit(False))).alias("due"))


def encode(rows: DataFrame, provider: Provider) -> DataFrame:
    """``embedding`` of ``source``, in the provider's batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for at in range(0, len(part), provider.batch_size):
                out += provider.encode(part.iloc[at : at + provider.batch_size].tolist())
            yield pd.Series(out, index=part.index)

    return rows.withColumn("embedding", run("source"))


def embed_project(graph: Graph, project: str, provider: Provider, rebuild: bool = False) -> Graph:
    """Embeds what is due; ``rebuild`` drops the project's vectors first."""
    if rebuild:
        graph = graph.with_tables(embeddings=graph["embeddings"].where(F.col("project") != project))
    stored = graph.within("embeddings", project)
    if stored.where(F.size("embedding") != provider.dimensions).head(1):
        raise DimensionMismatch(f"stored vectors are not of {provider.dimensions} dimensions; rebuild them")
    symbols = graph.symbols(project).where(callable_kind("any", tests=True))
    due = encode(embed_candidates(symbols, stored, provider.name).where("due"), provider)
    new = conform(due.select(F.lit(project).alias("project"), "qualified_name", "embedding", "source_hash", F.lit(provider.name).alias("model")), "embeddings")
    return graph.with_tables(embeddings=upsert(graph["embeddings"], new, KEYS["embeddings"]))
