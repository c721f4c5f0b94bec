"""Quality of a chunk as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


def quality(title: Column, content: Column, warnings: Column, deprecated: Column, vocabulary=T.COMMANDS) -> Column:
    """Starts at 0.5 and adds the terms in a fixed order, so that doubles come out alike everywhere; clamped to 0..1."""
    n = F.size(T.words(content))
    code = content.contains("```")
    terms = [
        (code, 0.3),
        (T.has_command(content, vocabulary), 0.2),
        (code & (n > 30) & ~F.regexp_replace(content, r"^(?U)\s+", "").startswith("$"), 0.2),
        ((n < 50) & (title != "") & ~code, 0.1),
        (content.rlike("(?i)toctree|contents::"), -0.3),
        (n >= 50, 0.1),
        (n < 20, -0.2),
        (F.size(warnings) > 0, 0.1),
        (deprecated, -0.1),
    ]
    score = F.lit(0.5)
    for when, by in terms:
        score = score + F.when(when, F.lit(by)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def scored(chunks: DataFrame, vocabulary=T.COMMANDS) -> DataFrame:
    return chunks.withColumn("quality_score", quality(F.col("title"), F.col("content"), F.col("warnings"), F.col("deprecated"), vocabulary))
