"""The stored index: tables of one version, partitioned by component."""

from __future__ import annotations

import datetime
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..operators import bm25, lookups, vector, xref
from . import documents

PARTITIONED = ("chunks", "code_examples", "postings", "term_stats", "component_stats", "embeddings")


def versions(spark: SparkSession, base: str) -> list[str]:
    """Names of versions below base that have metadata, listed by the file system that base is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    made = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(p.getName() for p in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{p.getName()}/metadata")))


def finished(chunks: DataFrame, vocabulary=T.COMMANDS) -> DataFrame:
    return xref.with_commands(quality.scored(chunks, vocabulary), vocabulary)


def metadata(chunks: DataFrame, examples: DataFrame, version: str, embedder: vector.Embedder, built: str | None = None) -> DataFrame:
    """One row: version, model, totals, and a map of component rows."""
    rows = lookups.component_index(chunks, examples)
    entry = F.struct("component", F.struct("chunk_count", "code_example_count", "topics"))
    totals = rows.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("code_example_count"), F.lit(0)).alias("total_code_examples"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("components"))
    built = built or datetime.datetime.now(datetime.timezone.utc).isoformat()
    return totals.select(F.lit(version).alias("version"), F.lit(embedder.name).alias("embedding_model"), F.lit(embedder.dimensions).alias("embedding_dimensions"), "*", F.lit(built).alias("build_timestamp"))


def write_table(df: DataFrame, path: str, partitioned: bool, dynamic: bool = False) -> None:
    """Partitioned by component; adaptive execution splits a large component over several tasks and files.

    Tables of terms are sorted by term within a file, so that a search for a few terms reads few row groups and pages.
    """
    if partitioned:
        df = df.hint("rebalance", "component")
        df = df.sortWithinPartitions("component", "term") if "term" in df.columns else df
    w = df.write.mode("overwrite")
    w = w.partitionBy("component") if partitioned else w
    (w.option("partitionOverwriteMode", "dynamic") if dynamic else w).parquet(path)


def derived(chunks: DataFrame, embedder: vector.Embedder) -> dict[str, DataFrame]:
    return bm25.build_index(chunks) | {"embeddings": vector.embeddings(chunks, embedder)}


def write(root: str, chunks: DataFrame, examples: DataFrame, version: str, embedder: vector.Embedder, files: DataFrame | None = None, only: list[str] | None = None, built: str | None = None) -> None:
    """Writes all tables below root; only: the components to write again (others stay)."""
    spark = chunks.sparkSession
    mine = chunks if only is None else chunks.where(F.col("component").isin(only))
    own = examples if only is None else examples.where(F.col("component").isin(only))
    write_table(mine, f"{root}/chunks", True, only is not None)
    write_table(own, f"{root}/code_examples", True, only is not None)
    stored = load(spark, root, ("chunks", "code_examples"))
    again = stored["chunks"] if only is None else stored["chunks"].where(F.col("component").isin(only))
    for name, df in derived(again, embedder).items():
        write_table(df, f"{root}/{name}", True, only is not None)
    # Commands spread over components: the cross-reference is always made again, ordered by command for row group skipping.
    xref.build(stored["chunks"]).repartitionByRange("command").sortWithinPartitions("command", "ordinal").write.mode("overwrite").parquet(f"{root}/command_xref")
    if files is not None:
        files.select("source_file", "digest").write.mode("overwrite").parquet(f"{root}/files")
    metadata(stored["chunks"], stored["code_examples"], version, embedder, built).write.mode("overwrite").parquet(f"{root}/metadata")


def build(spark: SparkSession, docs_root: str, index_root: str, version: str, embedder: vector.Embedder | None = None, vocabulary=T.COMMANDS, base_url: str = T.DOC_BASE_URL) -> str:
    """Scan, parse, score and store; returns the root of the version's tables. No chunks at all is an error."""
    embedder = embedder or vector.HashingEmbedder()
    files = documents.scan(spark, docs_root).persist()
    done = documents.parsed(files).persist()
    try:
        rows = finished(documents.chunks(done, version, base_url), vocabulary)
        if rows.isEmpty():
            raise ValueError(f"no chunks found below {docs_root}")
        root = f"{index_root}/doc-{version}"
        write(root, rows, documents.examples(done), version, embedder, files)
        return root
    finally:
        done.unpersist()
        files.unpersist()


def load(spark: SparkSession, root: str, names=(*PARTITIONED, "command_xref", "metadata"), optional=()) -> dict[str, DataFrame]:
    """The stored tables; a component is read as text whatever it looks like. optional: those left out if absent or broken."""
    out = {}
    for name in names:
        try:
            df = spark.read.option("inferSchema", "false").parquet(f"{root}/{name}")
        except AnalysisException:
            if name in optional:
                continue
            raise
        out[name] = df.withColumn("component", F.col("component").cast("string")) if "component" in df.columns else df
    return out


# JSON forms, for exchange with other tools


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records: unknown keys are dropped and missing ones null; a missing or broken file gives no rows."""
    try:
        rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        return rows.cache().where("_corrupt_record IS NULL").drop("_corrupt_record")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("component").json(path)


def row_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), indent=2, ensure_ascii=False)
