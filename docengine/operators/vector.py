"""Semantic search: exact inner product of normalised vectors, and a deterministic offline embedder.

The embedder hashes features; it stands in where no trained model is at hand and isn't meant to equal one.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import scope

DIMENSIONS = 384


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed counts of hashed words and character trigrams, normalised."""

    name = "feature-hashing"

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"\w+", (text or "").lower()):
                for f in [w, *(f"#{w[i : i + 3]}" for i in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                    v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embeddings(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """component, entity_id, chunk_ord, embedding of title and content, in Arrow batches."""

    def run(batches):
        for b in batches:
            texts = [f"{t or ''}\n{c or ''}" for t, c in zip(b["title"], b["content"])]
            yield b[["component", "entity_id", "chunk_ord"]].assign(embedding=embedder.embed(texts))

    return chunks.select("component", "entity_id", "chunk_ord", "title", "content").mapInPandas(run, "component string, entity_id string, chunk_ord int, embedding array<double>")


def inner(vector: Column, query: list[float]) -> Column:
    """Cosine with a query given on the driver: both are normalised, a zero vector gives zero."""
    n = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / n) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def consistent(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors of components that have as many vectors as chunks; others aren't searched."""
    have = vectors.groupBy("component").agg(F.count("*").alias("n"))
    want = chunks.groupBy("component").agg(F.count("*").alias("m"))
    return vectors.join(F.broadcast(have.join(want, "component").where("n = m").select("component")), "component", "left_semi")


def search(vectors: DataFrame, query: list[float], component: str | None = None, limit: int = 10) -> DataFrame:
    """The top `limit` rows with positive cosine; ties by component, then chunk order."""
    rows = scope(vectors, component).withColumn("score", inner(F.col("embedding"), query)).where("score > 0")
    return rows.drop("embedding").orderBy(F.desc("score"), "component", "chunk_ord", "entity_id").limit(limit).withColumn("search_source", F.lit("semantic"))
