"""Collections, documents and jobs as tables: listings, point lookups, histories, clones, and what a token may see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbasin.operators.content import form_fields
from docbasin.operators.governance import visible


def list_collections(collections: DataFrame, default: str, scope: list[str] | None = None) -> DataFrame:
    """collections (collection_id, name, restricted) -> collection_id, name, is_default of those a token sees, by name; a blank name is its id."""
    shown = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("collection_id"))
    return scoped(collections, scope).select("collection_id", shown.alias("name"), (F.col("collection_id") == default).alias("is_default")).orderBy("name", "collection_id")


def scoped(collections: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """What a token sees: without a scope all but restricted collections, with one only those it names."""
    if scope is None:
        return collections.where(~F.coalesce("restricted", F.lit(False)))
    return collections.where(F.col("collection_id").isin(scope) if scope else F.lit(False))


def selected(rows: DataFrame, selection: list[str] | None, filters: list[str] | None = None, key: str = "document_id") -> DataFrame:
    """Rows of documents that both the selection and the filter name; None restricts nothing, an empty list leaves nothing."""
    for ids in (selection, filters):
        if ids is not None:
            rows = rows.where(F.col(key).isin(ids) if ids else F.lit(False))
    return rows


def without_inlined(hits: DataFrame, inlined: DataFrame, name: str = "filename") -> DataFrame:
    """Hits of files that aren't shown as a whole anyway."""
    return hits.join(inlined.select(name).distinct(), name, "left_anti")


def document(documents: DataFrame, document_id: str) -> DataFrame:
    """One document's record; a hidden one is not found."""
    return visible(documents).where(F.col("document_id") == document_id)


def existing(ids: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Those ids that have chunks: a document that became a table only has none."""
    return ids.join(chunks.select(key), key, "left_semi")


def described(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (chunk_id, score) with their chunk and their document's name; hits without a chunk go, without a document they keep a null name."""
    return hits.join(chunks, "chunk_id").join(documents.select("document_id", "filename"), "document_id", "left")


def add_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Searches appended, with ids that go on from the largest."""
    last = history.agg(F.coalesce(F.max("search_id"), F.lit(0)).alias("last"))  # one row
    numbered = rows.withColumn("search_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("timestamp")))  # the searches of one request
    placed = numbered.crossJoin(F.broadcast(last)).withColumn("search_id", (F.col("search_id") + F.col("last")).cast("long")).drop("last")
    return history.unionByName(placed)


def recent_history(history: DataFrame, schema: str, limit: int = 50) -> DataFrame:
    """The newest searches, their payload decoded by `schema`; a payload that is no JSON is null."""
    return history.withColumn("payload", F.from_json("payload", schema)).orderBy(F.desc("timestamp"), F.desc("search_id")).limit(limit)


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "running")).orderBy(F.desc("job_id"))


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("job_id")).limit(min(max(limit, 1), 200))


def reindex_sources(documents: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources to read again, each path once, and those that are no longer there. paths (path): the files that exist."""
    sources = documents.where(F.col("source_path").isNotNull()).groupBy(F.col("source_path").alias("path")).agg(F.min("document_id").alias("document_id"))
    return sources.join(paths, "path", "left_semi"), sources.join(paths, "path", "left_anti")


def cloned(rows: DataFrame, source: str, target: str, used: int, size: int, limit: int) -> DataFrame:
    """`rows` and a copy of the source collection's under the target; refused if the copy's size doesn't fit the quota."""
    if used + size > limit:
        raise ValueError("the copy doesn't fit the quota")
    return rows.unionByName(rows.where(F.col("collection_id") == source).withColumn("collection_id", F.lit(target)))


def cleared(tables: dict[str, DataFrame], collection_id: str) -> dict[str, DataFrame]:
    """Every table without the collection's rows; tables of no collection stay."""
    return {n: t.where(F.col("collection_id") != collection_id) if "collection_id" in t.columns else t for n, t in tables.items()}


def chunks_of(chunks: DataFrame, document_id: str, limit: int = 1000) -> DataFrame:
    """A document's chunks in reading order."""
    return chunks.where(F.col("document_id") == document_id).orderBy("page_number", "chunk_index").limit(limit)


def inspected(chunks: DataFrame, documents: DataFrame, document_id: str, limit: int = 1000) -> DataFrame:
    """chunks_of() with the form fields of each chunk's text (a map), for documents whose text was recognised (method ocr or hybrid); else none."""
    mine = chunks_of(chunks, document_id, limit).join(documents.select("document_id", "method"), "document_id")
    found = form_fields(mine.where(F.col("method").isin("ocr", "hybrid")), key="chunk_id")
    fields = found.groupBy("chunk_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))  # as many as the chunk's text has
    none = F.create_map().cast("map<string,string>")
    return mine.join(fields, "chunk_id", "left").withColumn("fields", F.coalesce("fields", none)).drop("method").orderBy("page_number", "chunk_index")


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def cache_cleared(entries: DataFrame, scope: str) -> DataFrame:
    """Without the scope's entries, whatever their settings."""
    return entries.where((F.col("scope_key") != scope) & ~F.startswith("scope_key", F.lit(f"{scope}#")))


def expertise(people: DataFrame, topics: DataFrame) -> DataFrame:
    """people (person_id, name), topics (person_id, topic) -> topic, name."""
    return people.join(topics, "person_id").select("topic", "name").orderBy("topic", "name")
