"""Hybrid search: keywords first, vectors only where keywords are weak, then merge and re-rank by quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bm25, vector

THRESHOLD, MIN_RATIO, QUALITY_WEIGHT = 0.25, 0.5, 0.3  # fixed values: gate and boost
DEFAULT_LIMIT, MAX_LIMIT = 10, 50


@dataclass(frozen=True)
class Settings:
    """threshold: score from which a keyword result counts as strong; min_ratio: share of the limit that must be strong for
    the second tier not to run; quality_weight: of the re-ranking; limits: of a request without one, and of any."""

    threshold: float = THRESHOLD
    min_ratio: float = MIN_RATIO
    quality_weight: float = QUALITY_WEIGHT
    default_limit: int = DEFAULT_LIMIT
    max_limit: int = MAX_LIMIT


def clamp(limit, top: int = MAX_LIMIT) -> int:
    return max(1, min(int(limit), top))


def semantic_limit(above: int, limit: int, min_ratio: float = MIN_RATIO) -> int:
    """How many rows the second tier may give; 0: it doesn't run."""
    return max(limit - above, 1) if above < max(int(limit * min_ratio), 1) else 0


def _best(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("entity_id").orderBy(F.desc("score"), "component", "chunk_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def merge(keyword: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """Both tiers' few rows as one: semantic scores mapped to 0..1 (all alike: 1), ids in both averaged, then the cut."""
    own = Window.partitionBy()
    low, high = F.min("score").over(own), F.max("score").over(own)
    spread = semantic.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    k = _best(keyword).select("entity_id", "component", "chunk_ord", F.col("score").alias("k"))
    s = _best(spread).select("entity_id", F.col("component").alias("sc"), F.col("chunk_ord").alias("so"), F.col("score").alias("s"))
    both = k.join(s, "entity_id", "full_outer")
    score = F.when(F.col("k").isNull(), F.col("s")).when(F.col("s").isNull(), F.col("k")).otherwise((F.col("k") + F.col("s")) / 2)
    source = F.when(F.col("k").isNull(), "semantic").when(F.col("s").isNull(), "bm25").otherwise("merged")
    out = both.select(
        "entity_id", F.coalesce("component", "sc").alias("component"), F.coalesce("chunk_ord", "so").alias("chunk_ord"), score.alias("score"), source.alias("search_source"), F.col("k").isNull().alias("later"),
    )
    return out.orderBy(F.desc("score"), "later", "component", "chunk_ord", "entity_id").limit(limit).drop("later")


def rerank(rows: DataFrame, weight: float = QUALITY_WEIGHT) -> DataFrame:
    """score * (1 + weight * quality); after the cut, so it can't bring in another row."""
    return rows.withColumn("score", F.col("score") * (1 + weight * F.col("quality_score")))


def search(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, component: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Top `limit` chunks with score and search_source.

    The first tier's at most 50 rows come to the driver, which decides whether the second runs and for how many rows.
    Chunks are scanned once more to fill in the columns of the few results, by id.
    """
    spark = chunks.sparkSession
    keys = ["entity_id", "component", "chunk_ord", "score", "search_source"]
    kind = "entity_id string, component string, chunk_ord int, score double, search_source string"
    first = bm25.search(chunks, query, component, limit).select(*keys).collect()
    more = semantic_limit(sum(r["score"] >= THRESHOLD for r in first), limit)
    second = vector.search(vectors, query_vector, component, more).select(*keys).collect() if more and vectors is not None and query_vector else []
    merged = merge(spark.createDataFrame(first, kind), spark.createDataFrame(second, kind), limit)
    rows = chunks.join(F.broadcast(merged), ["entity_id", "component", "chunk_ord"])  # at most `limit` rows
    return rerank(rows)


def search_with_fallback(chunks, vectors, query, query_vector, component=None, limit=DEFAULT_LIMIT) -> DataFrame:
    """A component without results is searched again as if none were given."""
    out = search(chunks, vectors, query, query_vector, component, limit)
    return search(chunks, vectors, query, query_vector, None, limit) if component and out.isEmpty() else out
