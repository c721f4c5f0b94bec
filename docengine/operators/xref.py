"""Command cross-reference and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def with_commands(chunks: DataFrame, vocabulary=T.COMMANDS) -> DataFrame:
    return chunks.withColumn("commands_referenced", T.commands_of(F.col("title"), F.col("content"), vocabulary))


def build(chunks: DataFrame, vocabulary=T.COMMANDS) -> DataFrame:
    """command, ordinal, chunk_id, title, source, component: each chunk once a command, in chunk order.

    The ordinal is the chunk's own place (file_ord, chunk_ord), so no global sort is needed to number it.
    """
    ordinal = F.struct("file_ord", "chunk_ord").alias("ordinal")
    rows = with_commands(chunks, vocabulary).select(F.explode("commands_referenced").alias("command"), ordinal, F.col("entity_id").alias("chunk_id"), "title", F.col("source_file").alias("source"), "component")
    one = F.min(F.struct("ordinal", "title", "source", "component")).alias("r")
    return rows.groupBy("command", "chunk_id").agg(one).select("command", "r.ordinal", "chunk_id", "r.title", "r.source", "r.component")


def _refs(rows: DataFrame) -> DataFrame:
    """First occurrence of each chunk by command, then ordinal."""
    first = Window.partitionBy("chunk_id").orderBy("command", "ordinal")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def _prefixes(xref: DataFrame, key: str) -> DataFrame:
    return xref.where(F.col("command").startswith(key) | F.lit(key).startswith(F.col("command")))


def near(xref: DataFrame, key: str) -> DataFrame:
    """References of every command that begins with key or that key begins with, key itself among them: each chunk once."""
    return _refs(_prefixes(xref, key)).orderBy("command", "ordinal")


def lookup(xref: DataFrame, command: str) -> DataFrame:
    """Exact references, else those of every command that begins with the given one or the reverse; uncapped."""
    key = " ".join(command.split()).lower()
    exact = xref.where(F.col("command") == key)
    return exact.orderBy("command", "ordinal") if not exact.isEmpty() else near(xref, key)


def find(xref: DataFrame, command: str, keys: int = 10, references: int = 20) -> tuple[list[str] | None, DataFrame]:
    """(matched keys or None if exact, references): as lookup, but white space counts and the lists are cut."""
    key = command.strip().lower()
    exact = xref.where(F.col("command") == key)
    if not exact.isEmpty():
        return None, exact.orderBy("ordinal")
    names = [r[0] for r in _prefixes(xref, key).select("command").distinct().orderBy("command").limit(keys).collect()]
    return names, near(xref, key).limit(references)
