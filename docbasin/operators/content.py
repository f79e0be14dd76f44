"""Scanners over DataFrames: each text is read once, in Arrow batches; what comes out is rows, not Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbasin.functions import scan
from docbasin.session import arrow

#: Characters of text that are scanned before their rows leave Python; a longer text is a piece of its own.
PIECE_CHARS = 1 << 20


def typed(docs: DataFrame, key: str) -> str:
    """The key with its own type, as a schema's field."""
    return f"`{key}` {docs.schema[key].dataType.simpleString()}"


def pieces(batches: Iterator[pd.DataFrame], text: str, limit: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of `batches` again, in their order, in frames of at most `limit` characters of `text`."""
    for b in batches:
        begin, total = 0, 0
        for i, t in enumerate(b[text]):
            n = len(t) if t is not None else 0
            if total and total + n > limit:
                yield b.iloc[begin:i]
                begin, total = i, 0
            total += n
        yield b.iloc[begin:]


def _split(docs: DataFrame, key: str, text: str, split: Callable[[str], list[str]], name: str) -> DataFrame:
    def run(batches):
        for b in pieces(batches, text):
            rows = [(k, i, p) for k, t in zip(b[key], b[text], strict=True) if t is not None for i, p in enumerate(split(t))]
            yield pd.DataFrame(rows, columns=[key, name, "text"])

    return arrow(docs.select(key, text)).mapInPandas(run, f"{typed(docs, key)}, {name} int, text string")


def chunk(docs: DataFrame, size: int = 600, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _split(docs, key, text, lambda t: scan.chunks(t, size, overlap), "chunk_index")


def sections(pages: DataFrame, kind: str, key: str = "page_id", text: str = "html") -> DataFrame:
    """kind: html, markdown, json, jsonl or code. A text that is no JSON is one page, as it stands."""

    def json_or_text(value: str) -> list[str]:
        try:
            return scan.json_pages(value)
        except ValueError:
            return [value]

    split = {"html": scan.html_sections, "markdown": scan.markdown_sections, "json": json_or_text, "jsonl": scan.jsonl_pages, "code": scan.code_pages}[kind]
    return _split(pages, key, text, split, "section")


def entities(docs: DataFrame, cap: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, entity, each once a document."""
    return _split(docs, key, text, lambda t: scan.entities(t, cap), "place").select(key, F.col("text").alias("entity"))


def usable_entities(found: DataFrame, documents: int, share: float = 0.3, key: str = "doc_id") -> DataFrame:
    """entity, df, rarity of entities in at least two documents and at most max(2, share of all)."""
    counts = found.groupBy("entity").agg(F.count_distinct(key).alias("df"))
    most = counts.agg(F.max("df").alias("most"))
    return counts.crossJoin(F.broadcast(most)).where((F.col("df") >= 2) & (F.col("df") <= max(2, int(share * documents)))).select("entity", "df", (1 - F.col("df") / F.col("most")).alias("rarity"))


def plain_words(docs: DataFrame, share: float = 0.2, text: str = "text") -> frozenset[str]:
    """Words in more than a share of the documents, and the common ones: they tell no entity from another.

    At most (mean distinct words of a document) / share of them come to the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9'-]+"), F.lit(0)))
    limit = docs.count() * share
    often = docs.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") > limit)
    return scan.COMMON | {r.word for r in often.select("word").collect()}


def asked_entities(usable: DataFrame, query: str, cap: int = 10, plain: frozenset[str] = scan.COMMON) -> DataFrame:
    """The usable entities that the query's own (at most `cap`) stand for, each once.

    An entity stands for itself, else for the one that shares a content word with it and is rarest (by df, then name).
    `plain` are words that are no content; plain_words() takes them from a corpus.
    """
    asked = scan.entities(query, cap)
    words = [(a, w) for a in asked for w in sorted(scan.entity_words(a, plain))]
    spark = usable.sparkSession
    names = spark.createDataFrame([(a,) for a in asked], "asked string")
    exact = usable.join(F.broadcast(names), F.col("entity") == F.col("asked"))  # at most `cap` rows
    parts = usable.select("entity", "df", "rarity", F.explode(F.array_distinct(F.regexp_extract_all("entity", F.lit("[a-z0-9'-]+"), F.lit(0)))).alias("word"))
    alike = parts.join(F.broadcast(spark.createDataFrame(words, "asked string, word string")), "word").groupBy("asked").agg(F.min_by(F.struct("entity", "df", "rarity"), F.struct("df", "entity")).alias("best"))
    others = alike.join(exact.select("asked"), "asked", "left_anti").select("best.*")
    return exact.select("entity", "df", "rarity").unionByName(others).distinct()


def policy(docs: DataFrame, action: str = "flag", rules: list[tuple] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, flagged, status, suggested. action: off, flag, quarantine or reject; critical findings quarantine even under flag."""
    chosen = rules or scan.POLICY

    def run(batches):
        for b in pieces(batches, text):
            found = [scan.policy(t or "", chosen) for t in b[text]]
            yield pd.DataFrame({key: b[key], "score": [f["score"] for f in found], "flagged": [f["flagged"] for f in found], "critical": [f["critical"] for f in found], "categories": [",".join(f["categories"]) for f in found], "suggested": [f["suggested"] for f in found]})

    found = arrow(docs.select(key, text)).mapInPandas(run, f"{typed(docs, key)}, score double, flagged boolean, critical boolean, categories string, suggested string")
    after = {"off": "clear", "flag": "flagged", "quarantine": "quarantined", "reject": "rejected"}[action]
    status = F.when(~F.col("flagged") | F.lit(action == "off"), "clear").when(F.col("critical") & F.lit(action == "flag"), "quarantined").otherwise(after)
    return found.withColumn("status", status)


def injection(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for b in pieces(batches, text):
            found = [scan.injection(t or "") for t in b[text]]
            yield pd.DataFrame({key: b[key], "score": [f["score"] for f in found], "flagged": [f["flagged"] for f in found], "categories": [",".join(f["categories"]) for f in found]})

    return arrow(docs.select(key, text)).mapInPandas(run, f"{typed(docs, key)}, score double, flagged boolean, categories string")


def form_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, likelihood, form_like."""

    def run(batches):
        for b in pieces(batches, text):
            yield pd.DataFrame({key: b[key], "likelihood": [scan.form_likelihood(t or "") for t in b[text]]})

    found = arrow(docs.select(key, text)).mapInPandas(run, f"{typed(docs, key)}, likelihood double")
    return found.withColumn("form_like", F.col("likelihood") >= scan.FORM_LIKE)


def code_chunks(files: DataFrame, language: str, key: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """key, kind, name, first_line, last_line, text."""

    def run(batches):
        for b in pieces(batches, text):
            rows = [(k, c["kind"], c["name"], c["begin"], c["end"], c["text"]) for k, t in zip(b[key], b[text], strict=True) for c in scan.code_chunks(t or "", language, size, overlap)]
            yield pd.DataFrame(rows, columns=[key, "kind", "name", "first_line", "last_line", "text"])

    return arrow(files.select(key, text)).mapInPandas(run, f"{typed(files, key)}, kind string, name string, first_line int, last_line int, text string")


def chunk_pages(pages: DataFrame, size: int = 600, overlap: int = 100, key: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """key, page, chunk_index (from 0 on each page), text; blank pages have no chunks."""

    def run(batches):
        for b in pieces(batches, text):
            rows = [(k, p, i, c) for k, p, t in zip(b[key], b[page], b[text], strict=True) if t is not None and t.strip() for i, c in enumerate(scan.chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, page, "chunk_index", "text"])

    return arrow(pages.select(key, page, text)).mapInPandas(run, f"{typed(pages, key)}, {typed(pages, page)}, chunk_index int, text string")


def policy_pages(pages: DataFrame, rules: list[tuple] | None = None, key: str = "document_id", page: str = "page_number", text: str = "text", code: str | None = None) -> DataFrame:
    """key, page, score, flagged, critical, hits (category -> matches), findings; `code` names a boolean column: of code only secrets and credentials count."""
    chosen = rules or scan.POLICY
    names = ["category", "rule", "severity", "place", "excerpt"]

    def run(batches):
        for b in pieces(batches, text):
            of = b[code] if code else [False] * len(b)
            found = [scan.policy_report(t or "", chosen, bool(c)) for t, c in zip(b[text], of, strict=True)]
            yield pd.DataFrame({key: b[key], page: b[page], **{n: [f[n] for f in found] for n in ("score", "flagged", "critical", "hits")}, "findings": [[dict(zip(names, x, strict=True)) for x in f["findings"]] for f in found]})

    finding = "findings array<struct<category:string,rule:string,severity:string,place:int,excerpt:string>>"
    columns = [key, page, text, *([code] if code else [])]
    return arrow(pages.select(*columns)).mapInPandas(run, f"{typed(pages, key)}, {typed(pages, page)}, score double, flagged boolean, critical boolean, hits map<string,long>, {finding}")


def document_policy(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Page results of `policy` or `policy_pages` folded by document: the largest score, whether any page is flagged or critical, the
    pages flagged, and, of policy_pages, the matches of each category on all pages."""
    totals = [F.max("score").alias("score"), F.bool_or("flagged").alias("flagged"), F.bool_or("critical").alias("critical"), F.count_if("flagged").alias("flagged_pages")]
    out = pages.groupBy(key).agg(*totals)
    if "hits" not in pages.columns:
        return out
    each = pages.select(key, F.explode("hits").alias("category", "n")).groupBy(key, "category").agg(F.sum("n").alias("n"))
    hits = each.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("hits"))  # a few categories
    return out.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.create_map().cast("map<string,bigint>")))


#: Categories that quarantine a document on a second opinion alone.
CRITICAL = {c for c, _, _, severity, _ in scan.POLICY if severity == "critical"}


def decided(documents: DataFrame, action: str = "flag", opinions: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """document_policy() -> with status and suggested. opinions (key, categories array, confidence): a second reader's view.

    An opinion with categories flags a document from a confidence of 0.5 on, and counts as critical from 0.7 on if one of
    them is. Critical documents are quarantined even under `flag`; under `off` all are clear.
    """
    if action not in ("off", "flag", "quarantine", "reject"):
        raise ValueError(f"unknown action {action!r}")
    rows = documents
    flags, critical = F.lit(False), F.lit(False)
    if opinions is not None:
        rows = rows.join(opinions.select(key, F.col("categories").alias("__said"), F.col("confidence").alias("__sure")), key, "left")
        said, sure = F.coalesce(F.size("__said") > 0, F.lit(False)), F.coalesce("__sure", F.lit(0.0))
        flags = said & (sure >= 0.5)
        critical = F.coalesce(F.arrays_overlap("__said", F.array(*map(F.lit, sorted(CRITICAL)))), F.lit(False)) & (sure >= 0.7)
    after = {"off": "clear", "flag": "flagged", "quarantine": "quarantined", "reject": "rejected"}[action]
    clear = F.lit(action == "off") | ~(F.col("flagged") | flags)
    status = F.when(clear, "clear").when(F.col("critical") | critical, "rejected" if action == "reject" else "quarantined").otherwise(after)
    hint = F.exists(F.map_keys("hits"), lambda c: c.isin(sorted(scan.IN_CODE)))
    return rows.select(*documents.columns, status.alias("status"), F.when(hint, "confidential").alias("suggested"))


def form_fields(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, field, value: all fields of each text, the first value of each."""

    def run(batches):
        for b in pieces(batches, text):
            yield pd.DataFrame([(k, n, v) for k, t in zip(b[key], b[text], strict=True) for n, v in scan.form_fields(t or "").items()], columns=[key, "field", "value"])

    return arrow(docs.select(key, text)).mapInPandas(run, f"{typed(docs, key)}, field string, value string")


def code_symbols(files: DataFrame, language: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for b in pieces(batches, text):
            yield pd.DataFrame([(k, s["name"], s["kind"], s["begin"], s["end"]) for k, t in zip(b[key], b[text], strict=True) for s in scan.code_symbols(t or "", language)], columns=[key, "name", "kind", "first_line", "last_line"])

    return arrow(files.select(key, text)).mapInPandas(run, f"{typed(files, key)}, name string, kind string, first_line int, last_line int")
