"""Examples, pages, chunks, components, topics, health and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .bm25 import scope


def search_examples(examples: DataFrame, query: str, component: str | None = None, language: str | None = None, limit: int = 10, chunks: DataFrame | None = None) -> DataFrame:
    """Examples by the share of distinct query terms that their text contains; only of components that have chunks."""
    terms = sorted(set(T.query_tokens(query)))
    rows = examples if chunks is None else examples.join(chunks.select("component").distinct(), "component", "left_semi")
    rows = scope(rows, component)
    rows = rows.where(F.col("language") == language) if language else rows
    if not terms:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    text = F.lower(F.concat_ws(" ", "context", "code", "section_title"))
    hits = sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    scored = rows.withColumn("score", hits / F.lit(float(len(terms)))).where("score > 0")
    return scored.orderBy(F.desc("score"), "component", "ex_ord", "entity_id").limit(limit)


def doc_page(chunks: DataFrame, source_file: str) -> DataFrame:
    return chunks.where(F.col("source_file") == source_file).orderBy("section_path", "chunk_ord")


def chunks_for_source(chunks: DataFrame, source_file: str) -> DataFrame:
    """Chunks of the first component that has the file."""
    rows = chunks.where(F.col("source_file") == source_file)
    first = rows.agg(F.min("component")).first()[0]
    return rows.where(F.col("component") == first).orderBy("file_ord", "chunk_ord")


def doc_chunk(chunks: DataFrame, entity_id: str) -> DataFrame:
    return chunks.where(F.col("entity_id") == entity_id).orderBy("component", "file_ord", "chunk_ord").limit(1)


def component_index(chunks: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """component, chunk_count, code_example_count, topics (sorted)."""
    out = chunks.groupBy("component").agg(F.count("*").alias("chunk_count"), F.sort_array(F.collect_set("topic")).alias("topics"))
    if examples is None:
        return out.withColumn("code_example_count", F.lit(0).cast("long"))
    counts = examples.groupBy("component").agg(F.count("*").alias("code_example_count"))
    return out.join(counts, "component", "left").fillna(0, ["code_example_count"])


def list_components(chunks: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    rows = component_index(chunks, examples)
    return rows.select("component", "chunk_count", "code_example_count", F.size("topics").cast("long").alias("topic_count")).orderBy("component")


def components(chunks: DataFrame, vectors: DataFrame | None = None) -> list[str]:
    """Names of the components that either tier of the search has, sorted."""
    rows = chunks.select("component")
    rows = rows if vectors is None else rows.unionByName(vectors.select("component"))
    return [r[0] for r in rows.distinct().orderBy("component").collect()]


def list_topics(chunks: DataFrame, component: str) -> DataFrame:
    return chunks.where(F.col("component") == component).select("topic").distinct().orderBy("topic")


def health(chunks: DataFrame, examples: DataFrame | None, xref: DataFrame) -> DataFrame:
    """total_chunks, total_code_examples, components, command_xref_entries."""
    totals = component_index(chunks, examples).agg(
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("code_example_count"), F.lit(0)).alias("total_code_examples"), F.count("*").alias("components"),
    )
    entries = xref.agg(F.countDistinct("command").alias("command_xref_entries"))
    return totals.withColumn("k", F.lit(1)).join(entries.withColumn("k", F.lit(1)), "k").drop("k")


def version_key(name: Column) -> Column:
    """All integers in a name, for comparison as lists; [0] if it has none."""
    found = F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long")))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max_by("version", version_key(F.col("version"))).alias("version"))


def resolve_version(known: list[str], version: str | None = None) -> str:
    """The version asked for, by its own name or with the builder's prefix, else the numerically last."""
    if version:
        for name in (version, f"doc-{version}"):
            if name in known:
                return name
        raise FileNotFoundError(f"no version {version!r}; there are {sorted(known)}")
    if not known:
        raise FileNotFoundError("no versions")
    return max(known, key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0])
