"""What the operators of this subpackage share: the shared folder, saved tables and blocks of documents.

A *block* is a hash-chosen share of the documents, about BLOCK_BYTES of stored input, that one Python task holds at a
time. The number of blocks follows the input, the size of one doesn't, so memory per task is the same at every scale.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T

BLOCK_BYTES = 12 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or, where it is unset, the context's checkpoint folder.

    With neither, a session in one process gets a temporary folder of its own; a cluster has none that all see, so there
    it is an error.
    """
    context = spark.sparkContext
    where, found = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if not where and not found.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docengine-"))
        found = context._jsc.sc().getCheckpointDir()
    return where or found.get()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docengine/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage in a way that survives lost executors.

    rebalance: rows are first dealt into files of the advisory size, so that a small result of many tasks is a file or
    two; without it a task writes a file.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size; for files, their size. Where it has none, a count decides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() * 2000


def block_count(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of block_bytes, or of the square root of 64 times the input if that is more (from about 1 TB on).

    Operators that exchange a message for each pair of a block and a range of hashes send the square of this number at
    most, so with it messages stay in proportion to the input, of some 64 bytes at least, and a block grows as its root.
    """
    size = stored_bytes(df)
    return max(2, -(-size // max(block_bytes, math.isqrt(64 * size))))


_CODEC = pa.Codec("zstd", 5)


def _packed(batches):
    for batch in batches:
        blk = batch.column("blk").to_numpy()
        data, offsets = T.flat(batch.column("text"))
        ids = batch.column("doc_id")
        null, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        flag = batch.column("flag").to_numpy(zero_copy_only=False)
        order = np.argsort(blk, kind="stable")
        size, rows = np.diff(offsets), []
        for at in np.split(order, np.flatnonzero(np.diff(blk[order])) + 1) if len(order) else []:
            text = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in at)
            rows.append((int(blk[at[0]]), number[at].tobytes(), (flag[at] + 2 * null[at]).astype(np.uint8).tobytes(), T.pack_ints(size[at]), _CODEC.compress(text, asbytes=True)))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], ["blk", "ids", "flags", "sizes", "texts"])


def in_blocks(texts: DataFrame, blocks: int) -> DataFrame:
    """Documents (doc_id, text and perhaps a boolean flag) by block, many to a row and compressed, as opened() reads them.

    The block follows from id and text together, so that rows without id, or many of one id, are spread.
    """
    rows = texts if "flag" in texts.columns else texts.withColumn("flag", F.lit(False))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    return rows.mapInArrow(_packed, "blk int, ids binary, flags binary, sizes binary, texts binary")


def opened(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: ids (0 where null), which are null, flags, and the bytes and offsets of its texts."""
    rows = docs.select(["ids", "flags", "sizes", "texts"]).to_pylist()
    sizes = [T.unpack_ints(r["sizes"]) for r in rows]
    data = np.frombuffer(b"".join(pa.decompress(r["texts"], int(s.sum()), "zstd", asbytes=True) for r, s in zip(rows, sizes)), np.uint8)
    ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
    flags = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in rows])
    return ids, flags > 1, flags % 2 > 0, data, np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def text_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and columns named): whatever else a table has can't clash with names used here."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """crc32 of the id as text leaves this remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(of) == F.lit(rest)
