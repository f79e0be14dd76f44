"""The search driver: filters, modes, widening for a reranker, hidden documents, cut; and search over all collections."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbasin.operators import retrieval
from docbasin.operators.maintenance import cosine
from docbasin.sources import index as stored_index
from docbasin.sources.segments import Snapshot

log = logging.getLogger(__name__)
#: Pool of a reranker: so many times k, and at most.
WIDER, POOL = 5, 50


def normalised(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The best k keyword scores over their largest (over 1 if that is 0)."""
    best = retrieval.top(scores, k, key)
    most = best.agg(F.max("score").alias("most"))
    return best.crossJoin(F.broadcast(most)).select(key, (F.col("score") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)).alias("score"))  # most: one row


def search(keyword: DataFrame, vectors: DataFrame, asked: pd.DataFrame | None, *, mode: str = "hybrid", k: int = 10, weight: float = 0.7, allowed: DataFrame | None = None, hidden: DataFrame | None = None, shared: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """keyword (key, score) of the query, vectors (key, embedding), asked (query_id, vector) of one query -> key, score, best first.

    mode: keyword, semantic or hybrid. `allowed` (key) is applied before any cut, so filtered results are exact; None
    restricts nothing. `shared` (key, n, lift; retrieval.entity_hits) raises what holds several of the query's entities and
    brings in what only they find. `hidden` (key) is taken out of what was found, which may leave fewer than k. `rerank`
    takes the pool (key, score; min(5 k, 50) rows) and gives it new scores; rows that it leaves out come last, and if it
    raises, the order of retrieval stays. The pool is evaluated before, so errors of the query itself aren't hidden.
    """
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    fetch = min(WIDER * k, POOL) if rerank else k
    if allowed is not None:
        ids = allowed.select(key).distinct()
        keyword, vectors = keyword.join(ids, key, "left_semi"), vectors.join(ids, key, "left_semi")
        shared = shared.join(ids, key, "left_semi") if shared is not None else None
    if mode == "keyword":
        found = normalised(keyword, fetch, key)
    else:
        most = fetch if mode == "semantic" else 3 * fetch
        near = retrieval.knn(vectors, asked, most, key).select(key, "score")
        found = near if mode == "semantic" else retrieval.hybrid(near, keyword, fetch, weight, key)
    if shared is not None:
        found = with_entities(found, shared, vectors, asked if mode != "keyword" else None, fetch, key)
    if hidden is not None:
        found = found.join(hidden.select(key).distinct(), key, "left_anti")
    if rerank:
        return reordered(found, rerank, fetch, k, key)
    return retrieval.top(found, k, key)


def with_entities(found: DataFrame, shared: DataFrame, vectors: DataFrame, asked: pd.DataFrame | None, fetch: int, key: str = "doc_id", most: int = 25) -> DataFrame:
    """Scores raised by what their keys share with the query; and `most` keys that only share: from the cosine of their vector, 0 without one."""
    hits = shared.select(key, "n", "lift")
    raised = found.join(hits, key, "left").select(key, (F.col("score") + F.coalesce("lift", F.lit(0.0))).alias("score"))
    only = hits.join(found.select(key), key, "left_anti").orderBy(F.desc("n"), key).limit(most)
    base = F.lit(0.0)
    if asked is not None and len(asked):
        near = vectors.join(F.broadcast(only.select(key)), key).select(key, cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in asked["vector"].iloc[0]))).alias("near"))  # `most` rows
        only, base = only.join(near, key, "left"), F.coalesce("near", F.lit(0.0))
    return retrieval.top(raised.unionByName(only.select(key, (base + F.col("lift")).alias("score"))), fetch, key)


def reordered(found: DataFrame, rerank: Callable[[DataFrame], DataFrame], fetch: int, k: int, key: str = "doc_id") -> DataFrame:
    """The k best of a pool by a reranker's scores; by the pool's own if the reranker fails."""
    schema = found.select(key, "score").schema
    spark, rows = found.sparkSession, retrieval.top(found.select(key, "score"), fetch, key).collect()  # POOL rows at most
    pool = spark.createDataFrame(rows, schema)
    try:
        given = {r[key]: r["score"] for r in rerank(pool).select(key, "score").collect()}  # as many at most
    except Exception as e:  # a scorer of the caller's: whatever it raises, the results stay
        log.warning("reranking failed, the order of retrieval stays: %s", type(e).__name__)
        return retrieval.top(pool, k, key)
    place = {r[key]: i for i, r in enumerate(rows)}
    best = sorted(rows, key=lambda r: (given.get(r[key]) is None, -(given.get(r[key]) or 0.0), place[r[key]]))[:k]
    placed = spark.createDataFrame([(i, r[key], given.get(r[key])) for i, r in enumerate(best)], f"place int, `{key}` {schema[key].dataType.simpleString()}, score double")
    return placed.orderBy("place").select(key, "score")


def reranked(score: Callable[[str, pd.Series], pd.Series], query: str, texts: DataFrame, key: str = "doc_id") -> Callable[[DataFrame], DataFrame]:
    """A reranker from a function of the query and a series of texts; it sees the pool only."""

    def run(pool: DataFrame) -> DataFrame:
        scorer = F.pandas_udf(lambda t: score(query, t).astype("float64"), "double")
        return texts.select(key, "text").join(F.broadcast(pool.select(key)), key).select(key, scorer("text").alias("score"))  # pool: at most POOL rows

    return run


def search_all(index: Snapshot, query: str, k: int = 3) -> DataFrame:
    """An index with collections -> collection, top_score, place, key, score, position: the k best (1 to 10) of each collection.

    Every collection is an index of its own: its size, mean length and document frequencies count; sizes are stored with
    the index, and only the folders of the query's terms are read. Collections are placed by their best score, then name.
    """
    k, key = min(max(k, 1), 10), index.key
    wanted = retrieval.query_tokens(query)
    terms = sorted(set(wanted))
    mine = stored_index.postings(index, terms).where("collection is not null")
    asked = F.create_map(*(x for t in terms for x in (F.lit(t), F.lit(float(wanted.count(t)))))) if terms else F.create_map(F.lit(""), F.lit(0.0))
    frequency = mine.groupBy("collection", "term").agg(F.count("*").alias("df"))
    part = asked[F.col("term")] * retrieval.idf(F.col("n"), F.col("df")) * retrieval.term_score(F.col("tf"), F.col("length"), F.col("mean"))
    scored = mine.join(frequency.join(stored_index.sizes(index), "collection"), ["collection", "term"]).groupBy("collection", key).agg(F.sum(part).alias("score"))
    best = scored.withColumn("position", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("score"), key))).where(F.col("position") <= k)
    tops = best.groupBy("collection").agg(F.max("score").alias("top_score"))
    placed = tops.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("top_score"), "collection")))  # a row for each collection
    return best.join(placed, "collection").select("collection", "top_score", "place", key, "score", "position")
