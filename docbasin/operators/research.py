"""Research over several questions: the plan of branches, evidence keys, coverage and the budget report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.functions.requests import clean_queries, literals


def plan(question: str, more: list[str] | None = None) -> list[dict]:
    """Branches: hybrid for each query, keyword for the first, a literal search for each of two literals; at most seven."""
    queries = clean_queries(question, more)
    out = [{"branch": f"hybrid-{i}", "query_index": i, "mode": "hybrid", "query": q} for i, q in enumerate(queries)]
    out.append({"branch": "keyword-0", "query_index": 0, "mode": "keyword", "query": queries[0]})
    return out + [{"branch": f"literal-{i}", "query_index": 0, "mode": "literal", "query": x} for i, x in enumerate(literals(queries))]


def evidence_key(collection: Column, document: Column, chunk: Column, page: Column, excerpt: Column) -> Column:
    """24 hex digits of the passage's identity: its chunk, else its page and excerpt. Parts are told apart by their length."""
    own = F.coalesce(chunk.cast("string"), F.concat(page.cast("string"), F.lit(":"), F.coalesce(excerpt, F.lit(""))))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (collection, document, own)]
    return F.substr(F.sha2(F.concat_ws("\0", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256), F.lit(1), F.lit(24))


def coverage(searches: DataFrame, selected: DataFrame) -> DataFrame:
    """searches (query_index, failed), a row for each branch; selected (query_index, key, weak), a row for each passage that a query matched
    -> query_index, status, n_evidence, n_strong.

    retrieved: a strong passage; weak_evidence: only weak ones; search_failed: none and all branches failed; else no_selected_evidence.
    """
    tried = searches.groupBy("query_index").agg(F.bool_and("failed").alias("all_failed"))
    found = selected.groupBy("query_index").agg(F.count_distinct("key").alias("n_evidence"), F.count_distinct(F.when(~F.col("weak"), F.col("key"))).alias("n_strong"))
    n, strong = F.coalesce("n_evidence", F.lit(0)), F.coalesce("n_strong", F.lit(0))
    status = F.when(strong > 0, "retrieved").when(n > 0, "weak_evidence").when(F.col("all_failed"), "search_failed").otherwise("no_selected_evidence")
    return tried.join(found, "query_index", "left").select("query_index", status.alias("status"), n.alias("n_evidence"), strong.alias("n_strong"))


def next_steps(states: list[str], selected: int) -> list[str]:
    """What to do after a search, in order: look around the first passage, rephrase what has none, or read what is only weak."""
    out = ["context"] if selected else []
    if any(s in ("search_failed", "no_selected_evidence") for s in states):
        return [*out, "rephrase"]
    return [*out, "read_weak"] if "weak_evidence" in states else out


def budget(candidates: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """limit, used, omitted: characters shown and candidates left out."""
    used = shown.agg(F.coalesce(F.sum("shown"), F.lit(0)).alias("used"), F.count("*").alias("n_shown"))
    return candidates.agg(F.count("*").alias("n")).crossJoin(F.broadcast(used)).select(F.lit(limit).alias("limit"), "used", (F.col("n") - F.col("n_shown")).alias("omitted"))  # one row each


def across(hits: dict[str, DataFrame | Exception], most: int = 8) -> tuple[DataFrame | None, dict[str, str]]:
    """Hits of up to `most` collections as one table with collection_id, and the kind of failure of those that failed."""
    if not 1 <= len(hits) <= most:
        raise ValueError(f"1 to {most} collections")
    failed = {c: type(h).__name__ for c, h in hits.items() if isinstance(h, Exception)}
    out = None
    for c, h in hits.items():
        if c not in failed:
            own = h.withColumn("collection_id", F.lit(c))
            out = own if out is None else out.unionByName(own)
    return out, failed


def chosen_collections(wanted: list[str], available: list[str], most: int = 8) -> list[str]:
    """The collections to search: those named, each once, or, for ["*"], the first `most` of those available."""
    names = list(dict.fromkeys(wanted))
    if names == ["*"]:
        return list(available)[:most]
    if not 1 <= len(names) <= most or "*" in names:
        raise ValueError(f"1 to {most} collections, or * alone")
    if odd := [n for n in names if n not in available]:
        raise ValueError(f"unknown: {', '.join(odd)}")
    return names


def across_collections(spark: SparkSession, searches: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """As across(), from functions that search a collection each: a search is evaluated here (its hits are a top-k), so one that
    fails when it runs is recorded by the kind of its failure and the others go on."""
    found: dict[str, DataFrame | Exception] = {}
    for name, search in searches.items():
        try:
            hits = search()
            found[name] = spark.createDataFrame(hits.collect(), hits.schema)
        except Exception as e:  # whatever one collection's search raises
            found[name] = e
    return across(found)
