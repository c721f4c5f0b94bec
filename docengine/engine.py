"""The nine operations over a stored index, as a facade that returns dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bm25, hybrid, lookups, vector, xref
from .schemas import RESULT
from .sources import store

OPERATIONS = {
    "search_docs": ["query"], "search_examples": ["query"], "get_doc_page": ["source_file"], "get_doc_chunk": ["entity_id"], "find_docs_for_command": ["command"],
    "list_components": [], "list_topics": ["component"], "capabilities": [], "health": [],
}


def _rows(df: DataFrame, *drop: str) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in drop} for r in df.collect()]


class Engine:
    """base: a folder of versions, or the tables of one. Tables are read lazily and kept for the session.

    Where there are no stored vectors the second tier of the search gives nothing.
    """

    def __init__(self, spark: SparkSession, base: str, version: str | None = None, embedder: vector.Embedder | None = None, settings: hybrid.Settings | None = None):
        known = store.versions(spark, base)
        self.root = f"{base}/{lookups.resolve_version(known, version)}" if known or version else base
        self.spark, self.embedder = spark, embedder or vector.HashingEmbedder()
        self.settings = settings or hybrid.Settings()
        self.tables = store.load(spark, self.root, optional=("embeddings",))
        self.chunks, self.examples, self.xref = (self.tables[k] for k in ("chunks", "code_examples", "command_xref"))
        self.vectors = vector.consistent(self.tables["embeddings"], self.chunks) if "embeddings" in self.tables else None

    def _limit(self, limit: int | None) -> int:
        return hybrid.clamp(self.settings.default_limit if limit is None else limit, self.settings.max_limit)

    def search_docs(self, query: str, component: str | None = None, limit: int | None = None) -> list[dict]:
        limit = self._limit(limit)
        rows = self._search(query, component, limit)
        return rows if rows or not component else self._search(query, None, limit)

    def _search(self, query: str, component: str | None, limit: int) -> list[dict]:
        """As hybrid.search, with the first tier from stored postings."""
        keys = ["entity_id", "component", "chunk_ord", "score", "search_source"]
        kind = "entity_id string, component string, chunk_ord int, score double, search_source string"
        first = bm25.search_index(self.tables, query, component, limit).select(*keys).collect()
        more = hybrid.semantic_limit(sum(r["score"] >= self.settings.threshold for r in first), limit, self.settings.min_ratio)
        second = vector.search(self.vectors, self.embedder.embed([query])[0], component, more).select(*keys).collect() if more and self.vectors is not None else []
        merged = hybrid.merge(self.spark.createDataFrame(first, kind), self.spark.createDataFrame(second, kind), limit)
        out = hybrid.rerank(self.chunks.join(F.broadcast(merged), ["entity_id", "component", "chunk_ord"]), self.settings.quality_weight)
        return _rows(out.orderBy(F.desc("score"), "component", "chunk_ord").select(*RESULT))

    def search_examples(self, query: str, component: str | None = None, language: str | None = None, limit: int | None = None) -> list[dict]:
        return _rows(lookups.search_examples(self.examples, query, component, language, self._limit(limit), self.chunks), "score", "ex_ord")

    def get_doc_page(self, source_file: str) -> dict:
        rows = _rows(lookups.doc_page(lookups.chunks_for_source(self.chunks, source_file), source_file), "file_ord", "chunk_ord")
        return {"source_file": source_file, "sections": rows, "section_count": len(rows)} if rows else {"error": f"Page not found: {source_file}"}

    def get_doc_chunk(self, entity_id: str) -> dict:
        rows = _rows(lookups.doc_chunk(self.chunks, entity_id), "file_ord", "chunk_ord")
        return rows[0] if rows else {"error": f"Chunk not found: {entity_id}"}

    def find_docs_for_command(self, command: str) -> dict:
        keys, refs = xref.find(self.xref, command)
        rows = _rows(refs, "command", "ordinal")
        return {"command": command, "references": rows} if keys is None else {"command": command, "matched_keys": keys, "references": rows}

    def lookup_command(self, command: str) -> list[dict]:
        return _rows(xref.lookup(self.xref, command), "command", "ordinal")

    def list_components(self) -> list[dict]:
        return [{"name": r.pop("component"), **r} for r in _rows(lookups.list_components(self.chunks, self.examples))]

    def list_topics(self, component: str) -> dict:
        found = [r["topic"] for r in lookups.list_topics(self.chunks, component).collect()]
        if found:
            return {"component": component, "topics": found}
        return {"error": f"Unknown component: {component}", "available": [c["name"] for c in self.list_components()]}

    def capabilities(self) -> dict:
        return {"entity_types": ["doc_chunk", "code_example", "command_xref"], "operations": list(OPERATIONS), "version": self._metadata()["version"]}

    def _metadata(self) -> dict:
        return self.tables["metadata"].first().asDict(recursive=True)

    def health(self) -> dict:
        m = self._metadata()
        parts = {c: {k: v for k, v in x.items() if k != "topics"} for c, x in m.pop("components").items()}
        return {"status": "ok", **m, "components": parts, "command_xref_entries": self.xref.select("command").distinct().count()}

    def call(self, name: str, arguments: dict | None = None) -> str:
        """An operation by name, its answer as JSON; what goes wrong is an {"error"}."""
        arguments = arguments or {}
        try:
            if name not in OPERATIONS:
                raise ValueError(f"Unknown tool: {name}")
            if missing := [a for a in OPERATIONS[name] if arguments.get(a) is None]:
                raise ValueError(f"Missing required argument: {missing[0]}")
            return json.dumps(getattr(self, name)(**arguments), indent=2, ensure_ascii=False)
        except Exception as e:
            return json.dumps({"error": str(e)})
