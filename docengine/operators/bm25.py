"""Keyword search: Okapi BM25 per component.

An index is three tables: postings, term statistics and component statistics, each partitioned by component. Without one,
the statistics are one aggregation over the tokens, and scores are computed beside the text from the few query terms'
weights, so that no posting is shuffled to be scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values: the defaults of Okapi BM25 with a floor for negative idf


def tokenized(chunks: DataFrame) -> DataFrame:
    """Adds tokens (of title and content) and dl, their number."""
    out = chunks.withColumn("tokens", T.tokens(F.concat_ws(" ", "title", "content")))
    return out.withColumn("dl", F.size("tokens"))


def component_stats(tok: DataFrame) -> DataFrame:
    """component, n_docs, avgdl."""
    return tok.groupBy("component").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(tok: DataFrame) -> DataFrame:
    """component, term, df, raw (ln idf), idf: negative ones are EPSILON times the component's mean over all terms."""
    terms = tok.select("component", F.explode(F.array_distinct("tokens")).alias("term"))
    df = terms.groupBy("component", "term").agg(F.count("*").alias("df")).join(component_stats(tok), "component")
    raw = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    df = df.withColumn("raw", raw)
    mean = df.groupBy("component").agg(F.avg("raw").alias("mean_idf"))
    return df.join(mean, "component").withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")))


def postings(tok: DataFrame) -> DataFrame:
    """component, term, entity_id, chunk_ord, tf, dl."""
    rows = tok.select("component", "entity_id", "chunk_ord", "dl", F.explode("tokens").alias("term"))
    return rows.groupBy("component", "term", "entity_id", "chunk_ord", "dl").agg(F.count("*").alias("tf"))


def weights(tok: DataFrame, terms: list[str], stats: DataFrame | None = None) -> DataFrame:
    """One row a component: avgdl, and the idf of each distinct query term as a map."""
    stats = term_stats(tok) if stats is None else stats
    mine = stats.where(F.col("term").isin(sorted(set(terms))))
    return mine.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idfs"), F.first("avgdl").alias("avgdl"))


def score_expr(terms: list[str]) -> Column:
    """Sum over query tokens, repeated ones counted, in order of first occurrence."""
    total = F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    for t in dict.fromkeys(terms):
        tf = (F.col("dl") - F.size(F.array_remove("tokens", t))).cast("double")
        total = total + F.lit(float(terms.count(t))) * F.coalesce(F.col("idfs")[t], F.lit(0.0)) * tf * F.lit(K1 + 1) / (tf + norm)
    return total


def scope(chunks: DataFrame, component: str | None) -> DataFrame:
    """Only the component if it is known; an unknown or empty one means all."""
    if not component:
        return chunks
    own = chunks.where(F.col("component") == component)
    return chunks if own.isEmpty() else own


def scores(chunks: DataFrame, query: str, component: str | None = None) -> DataFrame:
    """chunks in scope with a positive score."""
    terms = T.query_tokens(query)
    rows = scope(chunks, component)
    if not terms:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
    tok = tokenized(rows)
    # A row a component: bounded by the number of components, not by the data.
    scored = tok.join(F.broadcast(weights(tok, terms)), "component").withColumn("score", score_expr(terms))
    return scored.where("score > 0").drop("tokens", "dl", "idfs", "avgdl")


def normalized(rows: DataFrame) -> DataFrame:
    """Scores divided by the highest; rows are the few of a top-k."""
    return rows.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy()))


def search(chunks: DataFrame, query: str, component: str | None = None, limit: int = 10) -> DataFrame:
    """The top `limit` chunks by score, normalised; ties by component, then chunk order."""
    top = scores(chunks, query, component).orderBy(F.desc("score"), "component", "chunk_ord", "entity_id").limit(limit)
    return normalized(top).withColumn("search_source", F.lit("bm25"))


def build_index(chunks: DataFrame) -> dict[str, DataFrame]:
    tok = tokenized(chunks)
    return {"postings": postings(tok), "term_stats": term_stats(tok), "component_stats": component_stats(tok)}


def search_index(index: dict[str, DataFrame], query: str, component: str | None = None, limit: int = 10) -> DataFrame:
    """component, entity_id, chunk_ord, score from stored tables: only the query terms' postings are read."""
    terms = T.query_tokens(query)
    counts = {t: terms.count(t) for t in terms}
    post = scope(index["postings"], component)
    if not terms:
        return post.select("component", "entity_id", "chunk_ord", F.lit(0.0).alias("score"), F.lit("bm25").alias("search_source")).where(F.lit(False))
    mine = post.where(F.col("term").isin(list(counts)))
    idf = index["term_stats"].where(F.col("term").isin(list(counts))).select("component", "term", "idf", "avgdl")
    times = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in (kv[0], float(kv[1]))]), F.col("term"))
    part = times * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    total = mine.join(F.broadcast(idf), ["component", "term"]).groupBy("component", "entity_id", "chunk_ord").agg(F.sum(part).alias("score"))
    top = total.where("score > 0").orderBy(F.desc("score"), "component", "chunk_ord", "entity_id").limit(limit)
    return normalized(top).withColumn("search_source", F.lit("bm25"))
