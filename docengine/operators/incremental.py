"""Incremental update: rows of changed files are replaced, affected components are scored and written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import documents, snapshots, store
from . import vector


def upsert(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows of old whose file isn't among the changed ones, and those of new whose file is."""
    ids = changed.select(key).distinct()
    return old.join(ids, key, "left_anti").select(old.columns).unionByName(new.join(ids, key, "left_semi").select(old.columns))


def affected(changed: DataFrame) -> DataFrame:
    return changed.select(T.component(F.col("source_file")).alias("component")).distinct()


def update(spark: SparkSession, docs_root: str, index_root: str, version: str, embedder: vector.Embedder | None = None, changed: list[str] | None = None, base_url: str = T.DOC_BASE_URL, vocabulary=T.COMMANDS) -> list[str]:
    """Brings the tables of index_root (a version's root) up to the files in docs_root; returns affected components.

    changed: names of changed files; by default those whose digest differs from the stored ones. Without changes nothing
    is written. A component that loses its last chunk is emptied. The time of the build stays.
    """
    embedder = embedder or vector.HashingEmbedder()
    files = documents.scan(spark, docs_root)
    known = spark.read.parquet(f"{index_root}/files")
    diff = snapshots.changed_files(known, files) if changed is None else spark.createDataFrame([(c,) for c in changed], "source_file string")
    diff = diff.select("source_file").persist()
    components = sorted(r[0] for r in affected(diff).collect())
    if not components:
        diff.unpersist()  # else a later scan of the same folder would be answered from it
        return []
    tables = store.load(spark, index_root, ("chunks", "code_examples", "metadata"))
    done = documents.parsed(files.join(diff, "source_file", "left_semi")).persist()
    inside = F.col("component").isin(components)
    chunks = upsert(tables["chunks"].where(inside), store.finished(documents.chunks(done, version, base_url), vocabulary), diff)
    chunks = store.finished(chunks, vocabulary)
    examples = upsert(tables["code_examples"].where(inside), documents.examples(done), diff)
    # What is read is about to be overwritten: both go to a folder beside it first.
    aside = f"{index_root}/_next"
    built = tables["metadata"].first()["build_timestamp"]
    chunks.write.mode("overwrite").parquet(f"{aside}/chunks")
    examples.write.mode("overwrite").parquet(f"{aside}/code_examples")
    chunks, examples = spark.read.parquet(f"{aside}/chunks"), spark.read.parquet(f"{aside}/code_examples")
    for name, df in (("chunks", chunks), ("code_examples", examples)):
        have = {r[0] for r in df.select("component").distinct().collect()}
        for c in components:
            if c not in have:
                _drop(spark, index_root, name, c)
    store.write(index_root, chunks, examples, version, embedder, files, components, built)
    done.unpersist()
    diff.unpersist()
    _delete(spark, aside)
    return components


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop(spark: SparkSession, root: str, table: str, component: str) -> None:
    for name in (table, *(("postings", "term_stats", "component_stats", "embeddings") if table == "chunks" else ())):
        _delete(spark, f"{root}/{name}/component={component}")
