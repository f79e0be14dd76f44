"""Changes to stored tables as new tables: upserts, deletes, review, collections, and the answer cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERMISSIONS = ["read", "write", "owner"]


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """`table` with `rows` in the place of those with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def add_documents(documents: DataFrame, rows: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """rows (filename, text) -> content_hash, document_id, status: duplicate where the content is there already, blocked, or new."""
    hashed = rows.withColumn("content_hash", F.sha2("text", 256)).withColumn("document_id", F.substr("content_hash", F.lit(1), F.lit(16)))
    there = documents.select("content_hash").distinct().withColumn("there", F.lit(True))
    out = hashed.join(there, "content_hash", "left")
    status = F.when(F.col("there"), "duplicate").otherwise("new")
    if blocked is not None:
        out = out.join(blocked.select("content_hash").distinct().withColumn("bad", F.lit(True)), "content_hash", "left")
        status = F.when(F.col("bad"), "blocked").otherwise(status)
    return out.withColumn("status", status).drop("there", "bad")


#: Characters that a document written by a caller may have.
MAX_CHARS = 2_000_000


def write_documents(documents: DataFrame, rows: DataFrame, mode: str = "create") -> tuple[DataFrame, DataFrame]:
    """documents and rows (filename, text) -> the table with the rows written, and filename, document_id, status of each.

    create: a name that is there already is an error (`exists`, nothing is written); replace: the new text takes its place;
    append: it goes behind the old text after an empty line. A content that another name holds is a `duplicate` and isn't
    written; a text over MAX_CHARS is `too_long`. Names are unique in either table.
    """
    if mode not in ("create", "replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    old = documents.select("filename", F.col("text").alias("before"), F.lit(True).alias("there"))
    both = rows.select("filename", F.coalesce("text", F.lit("")).alias("text")).join(old, "filename", "left")
    gap = F.when(F.endswith("before", F.lit("\n\n")), "").when(F.endswith("before", F.lit("\n")), "\n").otherwise("\n\n")
    text = F.when(F.col("there") & F.lit(mode == "append"), F.concat(F.coalesce("before", F.lit("")), gap, "text")).otherwise(F.col("text"))
    made = both.select("filename", "there", F.length("text").alias("given"), text.alias("text"))
    made = made.withColumn("content_hash", F.sha2("text", 256)).withColumn("document_id", F.substr("content_hash", F.lit(1), F.lit(16)))
    holders = documents.select(F.sha2("text", 256).alias("content_hash"), F.col("filename").alias("holder")).groupBy("content_hash").agg(F.min("holder").alias("first"), F.max("holder").alias("last"))
    made = made.join(holders, "content_hash", "left")
    other = F.col("first").isNotNull() & ((F.col("first") != F.col("filename")) | (F.col("last") != F.col("filename")))
    there = F.coalesce("there", F.lit(False))
    done = {"create": "created", "replace": "replaced", "append": "appended"}[mode]
    status = F.when(F.col("given") > MAX_CHARS, "too_long").when(there & F.lit(mode == "create"), "exists").when(other, "duplicate").when(there, done).otherwise("created")
    said = made.withColumn("status", status)
    written = said.where(F.col("status").isin("created", "replaced", "appended")).select("filename", "text", "content_hash", "document_id")
    return upsert(documents, written, "filename"), said.select("filename", "document_id", "status")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the documents' rows."""
    return {name: frame.join(ids.select(key), key, "left_anti") if key in frame.columns else frame for name, frame in tables.items()}


def review_queue(documents: DataFrame) -> DataFrame:
    """Flagged and quarantined documents: quarantined first, then the oldest."""
    return documents.where(F.col("policy_status").isin("flagged", "quarantined")).orderBy(F.col("policy_status") != "quarantined", "upload_timestamp", "document_id")


def set_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    """Named columns set where the condition holds; a value may be None."""
    return table.withColumns({c: F.when(condition, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def visible_collections(grants: list[DataFrame]) -> DataFrame:
    """(collection_id, permission) from teams, owners, shares and publication -> the strongest permission of each."""
    rank = F.array_position(F.array(*map(F.lit, PERMISSIONS)), F.col("permission"))
    return reduce(DataFrame.unionByName, grants).groupBy("collection_id").agg(F.max_by("permission", rank).alias("permission"))


def starters(chunks: DataFrame, documents: int = 6, key: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """The first chunk of each of the first documents."""
    first = chunks.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("k = 1").drop("k")
    return first.orderBy(key).limit(documents)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cache_find(entries: DataFrame, scope: str, model: str, vector: list[float], threshold: float) -> DataFrame:
    """The best entry of the scope and model at or above the threshold (less 1e-6); of equal ones the last."""
    asked = F.array(*(F.lit(float(v)) for v in vector))
    mine = entries.where((F.col("scope_key") == scope) & (F.col("embedding_model") == model) & (F.size("vec") == len(vector)))
    return mine.withColumn("similarity", cosine(F.col("vec"), asked)).where(F.col("similarity") >= threshold - 1e-6).orderBy(F.desc("similarity"), F.desc("entry_id")).limit(1)


def cache_store(entries: DataFrame, new: DataFrame, cap: int = 200, same: float = 0.99) -> DataFrame:
    """Entries with `new` (one row) in the place of a near twin, and of each scope the `cap` used last."""
    twin = entries.alias("e").join(F.broadcast(new.alias("n")), (F.col("e.scope_key") == F.col("n.scope_key")) & (F.col("e.embedding_model") == F.col("n.embedding_model")) & (cosine(F.col("e.vec"), F.col("n.vec")) >= same)).orderBy(F.desc("e.entry_id")).limit(1).select(F.col("e.entry_id").alias("entry_id"))
    kept = entries.join(twin, "entry_id", "left_anti").unionByName(new)
    used = Window.partitionBy("scope_key").orderBy(F.desc("last_used"), F.desc("entry_id"))
    return kept.withColumn("k", F.row_number().over(used)).where(F.col("k") <= cap).drop("k")


def cache_valid(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries all of whose fingerprints are those of visible documents now."""
    fields = ["collection_id", "document_id", "filename", "upload_timestamp", "num_chunks"]
    used = entries.select("entry_id", F.explode("fingerprints").alias("f")).select("entry_id", *(F.col(f"f.{c}").alias(c) for c in fields))
    now = documents.where(F.coalesce("policy_status", F.lit("clear")) != "quarantined").select(*fields)
    condition = reduce(lambda a, b: a & b, (used[c].eqNullSafe(now[c]) for c in fields))
    changed = used.join(now, condition, "left_anti").select("entry_id").distinct()
    return entries.join(changed, "entry_id", "left_anti")
