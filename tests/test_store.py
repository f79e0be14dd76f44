"""The document store: one version for all tables, batches that change nothing, failures that leave the old version."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docbasin.operators import retrieval, search
from docbasin.sources import segments, store


def embedder():
    """Made inside a function, so workers get its code and needn't import this module."""

    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count("a")), 1.0])

    return embed


embed = embedder()


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, filename string, text string")


def live(base):
    return {r.table: r.n for r in store.counts(base).collect()}


ROWS = [("d1", "a.txt", "we met Alice Jones about alpha"), ("d2", "b.txt", "then Alice Jones wrote. " + "beta words here. " * 80), ("d3", "c.txt", ""), ("d4", "d.txt", None)]


def test_tables_change_together(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = store.ingest(store.opened(spark, root), docs(spark, ROWS), embed, size=200, overlap=20)
    n = first.table("chunks").count()
    assert n > 8 and live(first)["documents"] == 4 and live(first)["vectors"] == n
    assert store.ingest(first, docs(spark, ROWS), embed, size=200).version == first.version
    again = store.ingest(first, docs(spark, [*ROWS[:1], ("d2", "b.txt", "gamma"), ("d5", "e.txt", "delta alpha")]), embed, size=200)
    assert again.version == 2 and {r.document_id for r in again.table("chunks").collect()} == {"d1", "d2", "d5"}
    assert {r.chunk_id: round(r.score, 9) for r in store.keyword_scores(again, "alpha").collect()}.keys() == {"d1:0", "d5:0"}
    chunks = again.table("chunks").select("chunk_id", "text")
    want = {r.chunk_id: round(r.score, 9) for r in retrieval.bm25_scores(chunks, "alpha gamma", "chunk_id").collect()}
    assert {r.chunk_id: round(r.score, 9) for r in store.keyword_scores(again, "alpha gamma").collect()} == want
    assert live(first)["documents"] == 4 and live(segments.latest(spark, root, "document_id")) == live(again)
    left = store.remove(again, docs(spark, ROWS[:1]).select("document_id"))
    assert {r.document_id for r in left.table("vectors").collect()} == {"d2", "d5"} == {r.document_id for r in left.table("entities").collect()} | {"d2", "d5"}
    whole = store.compacted(left)
    assert live(whole) == live(left) and len(whole.segments) == 1
    assert {r.chunk_id: round(r.score, 9) for r in store.keyword_scores(whole, "alpha gamma").collect()} == {r.chunk_id: round(r.score, 9) for r in store.keyword_scores(left, "alpha gamma").collect()}
    near = search.search(store.keyword_scores(whole, "gamma"), store.vectors(whole), pd.DataFrame({"query_id": [0], "vector": [embed(pd.Series(["gamma"]))[0]]}), k=1, key="chunk_id")
    assert near.first().chunk_id == "d2:0"


def test_a_failed_batch_leaves_the_old_version(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    base = store.ingest(store.opened(spark, root), docs(spark, ROWS), embed)

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        store.ingest(base, docs(spark, [("d9", "x.txt", "omega")]), broken)
    now = store.opened(spark, root)
    assert now.version == base.version and live(now) == live(base)
    after = store.ingest(now, docs(spark, [("d9", "x.txt", "omega")]), embed)
    assert {r.chunk_id for r in store.keyword_scores(after, "omega").collect()} == {"d9:0"}


def test_entities_of_the_store(spark, tmp_path):
    base = store.ingest(store.opened(spark, f"file://{tmp_path}/store"), docs(spark, [*ROWS, *[(f"f{i}", "f", f"filler {i}") for i in range(9)]]), embed)
    hits = store.entity_hits(base, "what of Alice Jones?")
    assert {r.chunk_id for r in hits.collect()} == {"d1:0", "d2:0"}
    assert base.table("entities").where(F.col("entity") == "alice jone").count() == 2


def test_stored_documents_are_not_broadcast(spark, tmp_path, monkeypatch):
    """What is stored already grows with the store, however small its files are: it is joined by a shuffle."""
    plans, add = [], store.Write.add

    def seen(self, table, rows, split=None):
        if table == "documents":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return add(self, table, rows, split)

    monkeypatch.setattr(store.Write, "add", seen)
    base = store.ingest(store.opened(spark, f"file://{tmp_path}/s"), docs(spark, ROWS), embed)
    assert store.ingest(base, docs(spark, ROWS), embed).version == base.version
    assert len(plans) == 2 and "SortMergeJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]
