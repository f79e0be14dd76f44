"""Keyword, vector, hybrid and literal search, rank fusion and context."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbasin.functions.text import excerpt, query_tokens, tokens

K1, B = 1.2, 0.75
#: Query vectors that one kNN call takes: they are sent to every task.
MAX_QUERIES = 10_000


def worded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, words of documents with tokens. The generator keeps the optimiser from tokenising once for each use of `words`."""
    return docs.select(key, F.explode(F.array(tokens(F.col(text)))).alias("words")).where(F.size("words") > 0)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, length. A document without tokens is not indexed. Write it partitioned or bucketed by term to keep it."""
    return worded(docs, key, text).select(key, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def term_score(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _equal(term: str):
    return lambda word: word == term


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of documents with at least one query token; a token repeated in the query counts as often.

    One query over a corpus needs no index: each document is reduced to its length and the counts of the query's terms
    in the scan, and the corpus figures are one row, which is joined as a scalar.
    """
    wanted = query_tokens(query)
    terms = sorted(set(wanted))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = worded(docs, key, text).select(key, F.size("words").alias("length"), *(F.size(F.filter("words", _equal(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    figures = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    parts = [F.lit(float(wanted.count(t))) * idf(F.col("n"), F.col(f"df{i}")) * term_score(F.col(f"tf{i}"), F.col("length"), F.col("mean")) for i, t in enumerate(terms)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    return counted.where(hit).crossJoin(F.broadcast(figures)).select(key, total.alias("score"))  # figures: one row


def bm25_search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", figures: DataFrame | None = None) -> DataFrame:
    """postings, queries (query_id, query) -> query_id, key, score, position: the k best of each query.

    Terms are joined to postings by a shuffle or broadcast as Spark sees fit; frequent terms are split by adaptive
    execution. figures (n, mean), one row, are counted from the postings if they aren't given.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    lengths = figures if figures is not None else index.select(key, "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    frequency = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    scored = index.join(asked.join(frequency, "term"), "term").crossJoin(F.broadcast(lengths))
    part = F.col("times") * idf(F.col("n"), F.col("df")) * term_score(F.col("tf"), F.col("length"), F.col("mean"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.groupBy("query_id", key).agg(F.sum(part).alias("score")).withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def top(scores: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(score), key).limit(k)


def knn(vectors: DataFrame, queries: pd.DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """queries (query_id, vector) -> query_id, key, score, position: the k largest cosines, exact.

    Each batch of vectors is one matrix product and gives at most k rows for each query; only those are shuffled.
    A zero vector has cosine 0 with everything.
    """
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} query vectors")
    ids = queries["query_id"].to_numpy()
    asked = np.array(queries["vector"].tolist(), np.float64).reshape(len(ids), -1)
    asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for b in batches:
            if not len(b) or not len(ids):
                continue
            m = np.array(b[vector].tolist(), np.float64)
            s = asked @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
            keys, n = b[key].to_numpy(), min(k, len(b))
            places = np.unique(keys, return_inverse=True)[1]
            best = np.stack([np.lexsort((places, -own))[:n] for own in s])
            yield pd.DataFrame({"query_id": np.repeat(ids, n), key: keys[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"query_id long, `{key}` {vectors.schema[key].dataType.simpleString()}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int, weight: float = 0.7, key: str = "doc_id") -> DataFrame:
    """(key, score) each -> key, score: the best 3k of either side, keyword scores over their largest, a missing side 0."""
    sem = top(semantic.select(key, "score"), 3 * k, key).select(key, F.col("score").alias("sem"))
    best = top(keyword.select(key, "score"), 3 * k, key)
    largest = best.agg(F.max("score").alias("most"))
    key_side = best.crossJoin(F.broadcast(largest)).where("most > 0").select(key, (F.col("score") / F.col("most")).alias("bm"))
    both = sem.join(key_side, key, "full_outer")
    return top(both.select(key, (F.lit(weight) * F.coalesce("sem", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("bm", F.lit(0.0))).alias("score")), k, key)


def find_literal(docs: DataFrame, needle: str, cap: int = 20, key: str = "doc_id", text: str = "text", ignore_case: bool = True) -> DataFrame:
    """key, excerpt of the first `cap` documents in key order that hold the needle."""
    cap = min(max(cap, 1), 100)
    hit = F.instr(F.lower(text), needle.lower()) > 0 if ignore_case else F.instr(F.col(text), needle) > 0
    return docs.where(hit).select(key, excerpt(F.col(text), needle, ignore_case=ignore_case).alias("excerpt")).orderBy(key).limit(cap)


def same_in_java(pattern: str, ignore_case: bool) -> bool:
    """Whether a pattern of Python's means the same to Java under the flags (?d) and, for ignoring case, (?iu).

    Literals, sets of them, dots, groups without names, alternatives, repeats, and ^ and $ do. Classes like \\w and word
    boundaries don't (Java's are ASCII's); nor do looks around, references, flags inside, \\A and \\Z, and, with case ignored,
    ranges and letters beyond ASCII.
    """
    plain = {"LITERAL", "NOT_LITERAL", "ANY", "IN", "BRANCH", "SUBPATTERN", "MAX_REPEAT", "MIN_REPEAT", "AT", "RANGE", "NEGATE"}

    def fits(tree) -> bool:
        for op, arg in tree:
            name = str(op)
            if name not in plain:
                return False
            if name in ("LITERAL", "NOT_LITERAL") and ignore_case and arg > 127:
                return False
            if name == "RANGE" and ignore_case or name == "AT" and str(arg) not in ("AT_BEGINNING", "AT_END"):
                return False
            inner = {"IN": lambda: [arg], "BRANCH": lambda: arg[1], "MAX_REPEAT": lambda: [arg[2]], "MIN_REPEAT": lambda: [arg[2]], "SUBPATTERN": lambda: [arg[3]]}.get(name, list)()
            if name == "SUBPATTERN" and (arg[1] or arg[2]) or not all(map(fits, inner)):
                return False
        return True

    tree = re._parser.parse(pattern)
    unnamed = not tree.state.groupdict and tree.state.flags == re.U
    # A bracket or && inside a set is an operator to Java.
    return unnamed and not re.search(r"\[[^\]]*(\[|&&)", pattern) and fits(tree)


def find_regex(docs: DataFrame, pattern: str, cap: int = 20, key: str = "doc_id", text: str = "text", ignore_case: bool = True, seconds: float = 5.0) -> DataFrame:
    """key, match, position (from 1) of the first `cap` documents in key order, as Python's `re.search` finds them.

    A pattern that means the same to Java is matched there; any other in Arrow batches by Python, where a text that takes
    more than `seconds` ends the query with an error.
    """
    try:
        re.compile(pattern)
    except (re.error, OverflowError) as e:
        raise ValueError(f"bad pattern: {e}") from e
    cap = min(max(cap, 1), 100)
    if same_in_java(pattern, ignore_case):
        p = F.lit(("(?iud)" if ignore_case else "(?d)") + pattern)
        hits = docs.where(F.regexp_like(text, p)).select(key, F.regexp_substr(text, p).alias("match"), F.regexp_instr(text, p).alias("position"))
        return hits.orderBy(key).limit(cap)

    def search(texts: pd.Series) -> pd.DataFrame:
        import regex

        compiled = regex.compile(pattern, regex.IGNORECASE if ignore_case else 0)
        found = [compiled.search(t, timeout=seconds) if t is not None else None for t in texts]
        return pd.DataFrame({"match": [m[0] if m else None for m in found], "position": pd.array([m.start() + 1 if m else None for m in found], "Int32")})

    hit = F.pandas_udf(search, "match string, position int")(F.col(text)).alias("hit")
    return docs.select(key, hit).where("hit.match is not null").select(key, "hit.match", "hit.position").orderBy(key).limit(cap)


def rank_fusion(hits: DataFrame, constant: int = 60) -> DataFrame:
    """hits (branch, rank, key, excerpt) -> key, score, best_rank, branch_hits, weak: reciprocal ranks of each branch's first occurrence.

    Ranks are those of the branch's own list; empty excerpts hold their rank but count for nothing.
    """
    first = hits.where(F.trim("excerpt") != "").groupBy("branch", "key").agg(F.min("rank").alias("rank"))
    fused = first.groupBy("key").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("branch_hits"))
    return fused.withColumn("weak", (F.col("branch_hits") == 1) & (F.col("best_rank") > 3))


def diverse(ranked: DataFrame, group: str, most: int, order: list[Column], budget: int | None = None, size: Column | None = None, least: int = 100, k: int = 8) -> DataFrame:
    """At most `most` rows a group in rank order, then the first k, then those that begin while `least` of the budget is left.

    Rows that the group's cap skips use no budget, so a running sum over the rest is the sequential rule. The result is
    at most k rows, which one task orders.
    """
    kept = ranked.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("in_group") <= most).orderBy(*order).limit(k)
    if budget is None:
        return kept
    before = F.coalesce(F.sum(F.least(size, F.lit(2000))).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    return kept.withColumn("left", left).where(F.col("left") >= least).withColumn("shown", F.least(size, F.lit(2000), F.col("left"))).drop("left")


def interleave(hits: DataFrame, collection: str, order: list[Column]) -> DataFrame:
    """The first of each collection, then the second of each, and so on."""
    return hits.withColumn("turn", F.row_number().over(Window.partitionBy(collection).orderBy(*order)))


def around(rows: DataFrame, anchors: DataFrame, document: str, position: str, window: int) -> DataFrame:
    """Rows within `window` places of an anchor (document, position) in position order, each once."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(position)))
    at = placed.join(anchors.select(document, position), [document, position], "left_semi").select(document, F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("place")).distinct()
    return placed.join(at, [document, "place"], "left_semi")


def context(chunks: DataFrame, document_id, *, chunk_id=None, page: int | None = None, window: int = 1, max_chars: int = 12_000) -> DataFrame:
    """chunks (document_id, chunk_id, page_number, chunk_index, text) of one document, in reading order: those around a chunk, of a page, or all.

    Of them the first that fit into max_chars (500 to 40,000; a separator counts one), the first always; `truncated` says
    whether some did not. One document's chunks are ordered by one task.
    """
    mine = chunks.where(F.col("document_id") == document_id)
    reading = Window.partitionBy("document_id").orderBy("page_number", "chunk_index")
    placed = mine.withColumn("place", F.row_number().over(reading))
    if chunk_id is not None:
        anchor = F.max(F.when(F.col("chunk_id") == chunk_id, F.col("place"))).over(Window.partitionBy("document_id"))
        placed = placed.withColumn("anchor", anchor).where(F.abs(F.col("place") - F.col("anchor")) <= max(window, 0)).drop("anchor")
    elif page is not None:
        placed = placed.where(F.col("page_number") == page)
    limit = min(max(max_chars, 500), 40_000)
    running = F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("place").over(Window.partitionBy("document_id"))
    fits = placed.select("*", running.alias("used"), first.alias("first")).withColumn("fits", (F.col("used") <= limit) | (F.col("place") == F.col("first")))
    cut = fits.withColumn("truncated", ~F.bool_and("fits").over(Window.partitionBy("document_id")))
    return cut.where("fits").select("document_id", "chunk_id", "page_number", "chunk_index", "text", "used", "truncated").orderBy("page_number", "chunk_index")


def within_budget(rows: DataFrame, document: str, position: str, text: str, max_chars: int) -> DataFrame:
    """Of each document the first rows that fit into `max_chars` (a separator counts one); the first always."""
    w = Window.partitionBy(document).orderBy(position)
    total = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).withColumn("place", F.row_number().over(w)).where((F.col("used") <= max_chars) | (F.col("place") == 1))


def entity_hits(held: DataFrame, asked: DataFrame, weight: float = 0.2, cap: int = 100, key: str = "doc_id") -> DataFrame:
    """held (key, entity), asked (entity, rarity), the query's few entities -> key, n, lift of the `cap` keys that share most.

    n entities are shared; two or more lift a score by weight * S / (1 + S), S the sum of their rarities.
    """
    s = F.coalesce(F.sum("rarity"), F.lit(0.0))
    met = held.select(key, "entity").distinct().join(F.broadcast(asked.select("entity", "rarity")), "entity")  # the query's entities: ten at most
    hits = met.groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.lit(weight) * s / (1 + s)).otherwise(0.0).alias("lift"))
    return hits.orderBy(F.desc("n"), key).limit(cap)


def entity_boost(scores: DataFrame, shared: DataFrame, weight: float = 0.2, key: str = "doc_id", most: int = 25) -> DataFrame:
    """shared (key, entity, rarity) holds the query's entities in documents -> scores raised by weight * S / (1 + S), S the
    rarities of two or more of them; and at most `most` documents without a score, those of most entities first, from 0.
    """
    s = F.coalesce(F.sum("rarity"), F.lit(0.0))
    hits = shared.distinct().groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.lit(weight) * s / (1 + s)).otherwise(0.0).alias("lift"))
    raised = scores.join(hits, key, "left").select(key, (F.col("score") + F.coalesce("lift", F.lit(0.0))).alias("score"))
    added = hits.join(scores, key, "left_anti").orderBy(F.desc("n"), key).limit(most).select(key, F.col("lift").alias("score"))
    return raised.unionByName(added)


def entity_boost(scores: DataFrame, shared: DataFrame, weight: float = 0.2, key: str = "doc_id", most: int = 25) -> DataFrame:
    """shared (key, entity, rarity) holds the query's entities in documents -> scores raised by weight * S / (1 + S), S the
    rarities of two or more of them; and at most `most` documents without a score, those of most entities first, from 0.
    """
    s = F.coalesce(F.sum("rarity"), F.lit(0.0))
    hits = shared.distinct().groupBy(key).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.lit(weight) * s / (1 + s)).otherwise(0.0).alias("lift"))
    raised = scores.join(hits, key, "left").select(key, (F.col("score") + F.coalesce("lift", F.lit(0.0))).alias("score"))
    added = hits.join(scores, key, "left_anti").orderBy(F.desc("n"), key).limit(most).select(key, F.col("lift").alias("score"))
    return raised.unionByName(added)
