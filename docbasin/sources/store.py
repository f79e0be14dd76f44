"""A document store: documents, chunks, vectors, keyword postings and entities of chunks, written together as one version.

Every table is in segments (docbasin.sources.segments), so a batch of documents becomes visible with all its tables at once, or
not at all. A document is told by its id; one whose content hash is stored already is left out, so running a batch again
changes nothing, and one with another hash takes the place of the old one in every table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.operators import content
from docbasin.sources import index
from docbasin.sources.segments import Snapshot, Write, compact, latest

KEY = "document_id"
TABLES = ["documents", "chunks", "vectors", "postings", "entities"]


def opened(spark: SparkSession, root: str) -> Snapshot:
    return latest(spark, root, KEY)


def ingest(base: Snapshot, docs: DataFrame, embed: Callable[[pd.Series], pd.Series], *, size: int = 600, overlap: int = 100, cap: int = 20) -> Snapshot:
    """docs (document_id string, filename, text) -> the version with them; the same version if all are there as they are.

    document_id is unique and not null; a null text is empty. A document has one page; its chunks' ids are document_id:index. `embed` takes a series of
    texts and gives a series of float lists; it runs in Arrow batches over the new chunks only. Each table is derived from the
    one before as it was written, so nothing is chunked or read twice.
    """
    hashed = docs.select(KEY, "filename", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", F.sha2("text", 256))
    if "documents" in base.tables:
        held = base.table("documents").select(KEY, "content_hash").hint("merge")  # else files that compress well are broadcast, however many rows they have
        hashed = hashed.join(held, [KEY, "content_hash"], "left_anti").select(KEY, "filename", "text", "content_hash")
    job = Write(base)
    texts = job.add("documents", hashed)
    n = texts.count()
    if not n:
        return base
    found = content.chunk(texts, size, overlap, key=KEY).withColumn("chunk_id", F.concat_ws(":", KEY, F.col("chunk_index").cast("string")))
    chunks = job.add("chunks", found.select(KEY, "chunk_id", F.lit(1).alias("page_number"), "chunk_index", "text").where(F.trim("text") != ""))
    vector = F.pandas_udf(lambda t: embed(t), "array<float>")
    job.add("vectors", chunks.select(KEY, "chunk_id", vector("text").alias("embedding")))
    owner = F.regexp_replace("chunk_id", ":[0-9]+$", "").alias(KEY)
    written = job.add("postings", index._ordered(index.rows_of(chunks, "chunk_id").select(owner, "chunk_id", "collection", "file", "length", "term", "tf", "bucket"), "chunk_id"), "bucket")
    job.add("entities", content.entities(chunks, cap, key="chunk_id").select(owner, "chunk_id", "entity"))
    return _finished(job, written.where(F.col("bucket") == index.DOCUMENTS), texts.select(KEY))


def remove(base: Snapshot, ids: DataFrame) -> Snapshot:
    """The version without these documents, in every table."""
    return _finished(Write(base), None, ids.select(KEY))


def _finished(job: Write, added: DataFrame | None, keys: DataFrame) -> Snapshot:
    """Tombstones for what the keys had, figures of chunks by what came and what went, and the new version."""
    base = job.base
    dead = job.kill("documents", keys)
    parts = [index._sizes(added)] if added is not None else []
    if job.n_dead:
        old = base.rows("postings", [index.DOCUMENTS]).withColumnRenamed("segment", "of")
        parts.append(index._sizes(old.join(dead, [KEY, "of"], "left_semi"), -1))
    if not parts:
        return base
    sizes = job.add("sizes", (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).coalesce(1))
    more = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    held = base.notes.get("figures", [0, 0])
    return job.commit({"figures": [held[0] + more.n, held[1] + more.total]})


def compacted(base: Snapshot, keep: int = 0) -> Snapshot:
    """The same rows in fewer segments."""
    return compact(base, {"postings": lambda r: index._ordered(r, "chunk_id"), "sizes": lambda r: r.groupBy("collection").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).coalesce(1)}, keep)


def counts(store: Snapshot) -> DataFrame:
    """table, n: live rows of each table (postings: of terms)."""
    out = None
    for name in TABLES:
        rows = store.table(name) if name in store.tables else None
        one = rows.where("term is not null") if name == "postings" and rows is not None else rows
        one = one.agg(F.count("*").alias("n")) if one is not None else store.spark.createDataFrame([(0,)], "n long")
        one = one.select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def keyword_scores(store: Snapshot, query: str) -> DataFrame:
    """chunk_id, score: BM25 of one query over the store's chunks."""
    return index.scores(store, query, "chunk_id")


def vectors(store: Snapshot) -> DataFrame:
    return store.table("vectors").select("chunk_id", "embedding")


def entity_hits(store: Snapshot, query: str, weight: float = 0.2, share: float = 0.3) -> DataFrame:
    """chunk_id, n, lift of chunks that share entities with the query, for search.search(shared=...)."""
    from docbasin.operators.retrieval import entity_hits as hits

    held = store.table("entities").select("chunk_id", "entity")
    usable = content.usable_entities(held, store.table("chunks").count(), share, "chunk_id")
    asked = content.asked_entities(usable, query)
    return hits(held, asked, weight, key="chunk_id")
