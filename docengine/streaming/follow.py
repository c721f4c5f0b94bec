"""Following a folder: new and changed files arrive as a stream and each micro-batch updates the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import incremental

_FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, docs_root: str, index_root: str, version: str, checkpoint: str, once: bool = False, **options):
    """A running query that updates index_root whenever files come in. once: what is there now, then stop.

    The stream only says that something came; the update compares digests, so a batch that is run again changes nothing.
    """
    stream = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rst").load(docs_root)

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            incremental.update(spark, docs_root, index_root, version, **options)

    writer = stream.select("path").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
