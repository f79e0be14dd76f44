"""Visibility, usage, audit, quotas, retention and the answer cache, as plain relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["public", "internal", "confidential", "restricted"]


def visible(documents: DataFrame, status: str = "policy_status") -> DataFrame:
    """Without quarantined documents; a null status is clear."""
    return documents.where(F.coalesce(F.col(status), F.lit("clear")) != "quarantined")


def sensitivity(own: Column, collection: Column) -> Column:
    return F.coalesce(F.when(own.isin(LEVELS), own), F.when(collection.isin(LEVELS), collection), F.lit("internal"))


def filtered(documents: DataFrame, *, ids: list | None = None, formats: list[str] | None = None, names: list[str] | None = None, since: str | None = None, until: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """All given filters together; None restricts nothing, an empty list leaves nothing. Formats and names ignore case."""
    c = {"id": "document_id", "format": "source_format", "name": "filename", "time": "upload_timestamp"} | (columns or {})
    out = documents
    if ids is not None:
        out = out.where(F.col(c["id"]).isin(ids) if ids else F.lit(False))
    if formats is not None:
        wanted = [f.lower().lstrip(".") for f in formats]
        out = out.where(F.lower(c["format"]).isin(wanted) if wanted else F.lit(False))
    if names is not None:
        out = out.where(F.lower(c["name"]).isin([n.lower() for n in names]) if names else F.lit(False))
    if since is not None:
        out = out.where(F.coalesce(F.col(c["time"]), F.lit("")) >= since)
    if until is not None:
        out = out.where(F.coalesce(F.col(c["time"]), F.lit("")) <= until)
    return out


def named_like(documents: DataFrame, part: str, name: str = "filename") -> DataFrame:
    """Documents whose name holds a text, ignoring case; % and _ in it stand for themselves."""
    plain = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return documents.where(F.col(name).ilike(f"%{plain}%"))


def usage(events: DataFrame, by: str, *, user: str = "user_id", time: str = "ts", value: str = "value", since: str | None = None) -> DataFrame:
    """Turns, sum and last time by user (null: anonymous) or by day."""
    key = F.coalesce(F.col(user).cast("string"), F.lit("anonymous")) if by == "user" else F.date_format(time, "yyyy-MM-dd")
    rows = events.where(F.col(time) >= F.lit(since).cast("timestamp")) if since else events
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("turns"), F.round(F.sum(value), 4).alias("total"), F.max(time).alias("last_used"))


def over_budget(events: DataFrame, limit: float, day: str, *, user: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """user, used, refused: sums of one day against a limit."""
    rows = events.where(F.to_date(time) == F.lit(day).cast("date"))
    return rows.groupBy(user).agg(F.round(F.sum(value), 4).alias("used")).withColumn("refused", F.col("used") >= limit)


def audit(events: DataFrame, *, equal: dict | None = None, since: str | None = None, limit: int = 100, time: str = "ts", key: str = "event_id") -> DataFrame:
    out = events
    for column, value in (equal or {}).items():
        out = out.where(F.col(column).eqNullSafe(value))
    if since:
        out = out.where(F.col(time) >= F.lit(since).cast("timestamp"))
    return out.orderBy(F.desc(time), F.desc(key)).limit(limit)


def retained(events: DataFrame, now: str, days: int, time: str = "ts") -> DataFrame:
    """Rows not older than `days`; 0 keeps all."""
    return events if not days else events.where(F.col(time) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))


def most_recent(rows: DataFrame, scope: str, used: str, key: str, cap: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(used), F.desc(key)))).where(F.col("place") <= cap)


def quota(used: DataFrame, limit: int) -> DataFrame:
    """used -> used, remaining, percent (one decimal, 100 at most)."""
    return used.select("used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("remaining"), F.round(F.least(F.lit(100.0), F.col("used") / limit * 100), 1).alias("percent"))


def share_contacts(invited: DataFrame, accepted: DataFrame) -> DataFrame:
    """(email, share_id) each -> email, shares: distinct shares of invited and accepted addresses together."""
    return invited.select("email", "share_id").union(accepted.select("email", "share_id")).groupBy("email").agg(F.count_distinct("share_id").alias("shares"))


def shared_collections(collections: DataFrame, shares: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """collections (collection_id, ..., created_at), shares (share_id, collection_id, permission, is_active), members (share_id, user_id)
    -> the collections that active shares give to the user, with permission and share_id, the oldest first."""
    mine = members.where(F.col("user_id") == user).select("share_id")
    given = shares.where("is_active").join(mine, "share_id").select("share_id", "collection_id", "permission")
    return collections.join(given, "collection_id").orderBy("created_at", "collection_id", "share_id")


def share_access(shares: DataFrame, members: DataFrame, now: str, permissions: list[str]) -> DataFrame:
    """collection_id, user_id, permission: the strongest (first in `permissions`) of active shares that haven't expired; expires_at may be null."""
    rank = F.array_position(F.array(*map(F.lit, permissions)), F.col("permission"))
    open_ = shares.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    return open_.join(members, "share_id").groupBy("collection_id", "user_id").agg(F.min_by("permission", F.when(rank > 0, rank)).alias("permission"))


def active_shares(emails: DataFrame, shares: DataFrame, members: DataFrame, exclude: str | None = None) -> DataFrame:
    """emails (email), shares (share_id, invited_email, is_active), members (share_id, user_id) -> email, shares: how many active ones still connect it.

    A share counts if it invited the address or if a member has it; case and outer blanks don't matter. The OR of the two is
    the distinct union of two equi-joins, so no pairs of addresses and shares are compared.
    """
    wanted = emails.select(F.lower(F.trim("email")).alias("email")).distinct()
    live = shares.where("is_active").where(F.col("share_id") != F.lit(exclude)) if exclude is not None else shares.where("is_active")
    invited = live.select(F.lower("invited_email").alias("email"), "share_id").join(wanted, "email")
    joined = members.select(F.lower("user_id").alias("email"), "share_id").join(wanted, "email").join(live.select("share_id"), "share_id").select("email", "share_id")
    counted = invited.unionByName(joined).groupBy("email").agg(F.count_distinct("share_id").alias("shares"))
    return wanted.join(counted, "email", "left").select("email", F.coalesce("shares", F.lit(0)).cast("long").alias("shares"))


def usage_totals(events: DataFrame, by: str, sums: list[str], *, user: str = "user_id", time: str = "ts", cached: str | None = None, since: str | None = None) -> DataFrame:
    """key (user, null as anonymous, or day), turns, a sum for each of `sums` (null: 0), cache_hits, last_used; ordered by key."""
    key = F.coalesce(F.col(user).cast("string"), F.lit("anonymous")) if by == "user" else F.date_format(time, "yyyy-MM-dd")
    rows = events.where(F.col(time) >= F.lit(since).cast("timestamp")) if since else events
    hits = [F.count_if(cached).alias("cache_hits")] if cached else []
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("turns"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), *hits, F.max(time).alias("last_used")).orderBy("key")


def corpus_state(documents: DataFrame) -> DataFrame:
    """documents (num_pages, num_chunks, num_bytes, upload_timestamp, policy_status) -> counts and the version that changes with them."""
    held = F.count_if(F.coalesce(F.col("policy_status") == "quarantined", F.lit(False)))
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("num_pages", "num_chunks", "num_bytes")}
    version = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.max("upload_timestamp").cast("string"), F.lit("")), sums["num_chunks"].cast("string"), held.cast("string"))
    return documents.agg(F.count("*").alias("documents"), *(c.alias(n) for n, c in sums.items()), held.alias("quarantined"), version.alias("version"))


def overview(documents: DataFrame, by: str, names: int = 50) -> DataFrame:
    """documents (filename, num_pages, num_chunks, upload_timestamp) -> by, documents, num_pages, num_chunks, first, last, listed.

    `listed` are the first names, and how many more there are. Only the first names of each part of the table are shuffled.
    """
    totals = documents.groupBy(by).agg(F.count("*").alias("documents"), F.coalesce(F.sum("num_pages"), F.lit(0)).alias("num_pages"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("num_chunks"), F.min("upload_timestamp").alias("first"), F.max("upload_timestamp").alias("last"))
    ranked = documents.select(by, "filename", F.row_number().over(Window.partitionBy(by).orderBy("filename")).alias("k")).where(F.col("k") <= names)
    listed = ranked.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "filename"))), lambda x: x.filename), ", ").alias("listed"))
    more = F.when(F.col("documents") > names, F.concat(F.lit(" (+"), (F.col("documents") - names).cast("string"), F.lit(" more)"))).otherwise("")
    return totals.join(listed.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by").withColumn("listed", F.concat(F.coalesce("listed", F.lit("")), more))
