"""Segmented stores: additions, replacements, deletes, compaction, conflicts, failed writes, and indexes that follow their files."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from docbasin.operators import retrieval
from docbasin.sources import index, segments

OLD = [(1, "alpha beta gamma", "a"), (2, "beta beta delta", "b"), (3, "gamma delta epsilon zeta", "a"), (4, "alpha alpha alpha beta", "b"), (5, "omega", "a"), (6, "the of", "b")]
NEW = [(2, "epsilon alpha", "a"), (5, "the", "a"), (9, "alpha omega", "c")]
QUERIES = ["alpha delta", "beta beta omega", "epsilon", "the", "nothing"]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, box string")


def check(stored, docs):
    for q in QUERIES:
        got = {r.doc_id: round(r.score, 9) for r in index.scores(stored, q).collect()}
        assert got == {r.doc_id: round(r.score, 9) for r in retrieval.bm25_scores(docs, q).collect()}, q
    assert sorted(map(tuple, index.postings(stored).select("doc_id", "length", "term", "tf").collect())) == sorted(map(tuple, retrieval.postings(docs).select("doc_id", "length", "term", "tf").collect()))
    sized = retrieval.worded(docs.withColumn("k", F.struct("doc_id", "box")), "k", "text").groupBy("k.box").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    assert {tuple(r) for r in index.sizes(stored).collect()} == {tuple(r) for r in sized.collect()}
    n, mean = index.figures(stored)
    assert n == index.documents(stored).count() and (not n or abs(mean - index.documents(stored).agg(F.avg("length")).first()[0]) < 1e-12)


def test_an_index_follows_every_change(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    docs = table(spark, OLD)
    first = index.upsert(segments.latest(spark, root, "doc_id"), docs, group="box")
    check(first, docs)
    new = table(spark, NEW)
    second = index.upsert(first, new, group="box")
    now = docs.join(new, "doc_id", "left_anti").unionByName(new)
    check(second, now)
    check(first, docs)  # a reader of the old version sees what it saw
    third = index.delete(second, spark.createDataFrame([(1,), (9,), (77,)], "doc_id long"))
    left = now.where(~F.col("doc_id").isin(1, 9))
    check(third, left)
    check(segments.latest(spark, root, "doc_id"), left)
    again = index.upsert(third, table(spark, [(1, "alpha again", "c")]), group="box")
    back = left.unionByName(table(spark, [(1, "alpha again", "c")]))
    check(again, back)
    partly = index.compacted(again, keep=1)
    assert len(partly.segments) == 2
    check(partly, back)
    whole = index.compacted(partly)
    assert len(whole.segments) == 1 and whole.n_dead() == 0
    check(whole, back)
    assert segments.vacuum(whole) and not segments.vacuum(whole)
    check(segments.latest(spark, root, "doc_id"), back)


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    stored = index.upsert(segments.latest(spark, f"file://{tmp_path}/index", "doc_id"), table(spark, OLD))
    files = index.postings(stored, ["alpha"]).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 and len(files) < len(index.postings(stored).inputFiles())


def test_of_two_writers_one_fails_and_a_failed_write_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    base = index.upsert(segments.latest(spark, root, "doc_id"), table(spark, OLD))
    index.upsert(base, table(spark, NEW))
    with pytest.raises(segments.Conflict):
        index.upsert(base, table(spark, NEW))
    now = segments.latest(spark, root, "doc_id")
    broken = table(spark, [(1, "x y", "a")]).withColumn("text", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("no"))).cast("string"))
    with pytest.raises(Exception, match="no"):
        index.upsert(now, broken)
    assert segments.latest(spark, root, "doc_id").version == now.version
    after = index.upsert(now, table(spark, [(1, "x1 y1", "a")]))  # the failed write is not in the way
    assert after.version == now.version + 1 and {r.doc_id for r in index.scores(after, "x1").collect()} == {1}


def test_an_index_notices_changed_new_and_vanished_files(spark, tmp_path):
    where = str(tmp_path / "docs")

    def put(name, rows):
        table(spark, rows).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "one"))
        os.makedirs(where, exist_ok=True)
        part = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
        shutil.copy(tmp_path / "one" / part, f"{where}/{name}.parquet")
        os.utime(f"{where}/{name}.parquet", (time.time() + put.turn, time.time() + put.turn))
        put.turn += 10

    put.turn = 1
    put("a", OLD[:3])
    put("b", OLD[3:])
    read = lambda: spark.read.parquet(where)
    first = index.ensure(read())
    assert index.ensure(read()).version == first.version == 1
    put("a", [(1, "omega omega", "a"), (7, "fresh words", "b")])  # 2 and 3 are gone
    put("c", NEW[2:])
    second = index.ensure(read())
    docs = read()
    for q in [*QUERIES, "fresh"]:
        assert {r.doc_id: round(r.score, 9) for r in index.scores(second, q).collect()} == {r.doc_id: round(r.score, 9) for r in retrieval.bm25_scores(docs, q).collect()}, q
    newest = second.segments[-1]["id"]
    assert {r.doc_id for r in second.rows("postings", [index.DOCUMENTS], [newest]).collect()} == {1, 7, 9}  # b was not read again
    os.remove(f"{where}/b.parquet")
    third = index.ensure(read())
    assert {r.doc_id for r in index.documents(third).collect()} == {1, 7, 9}
    assert {r.doc_id for r in index.scores(index.compacted(third), "omega").collect()} == {1, 9}


def test_a_filtered_table_has_an_index_of_its_own(spark, tmp_path):
    table(spark, OLD).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert index.documents(index.ensure(docs)).count() == 5 and index.documents(index.ensure(docs.where("box = 'a'"))).count() == 3


def test_terms_are_counted_where_a_document_is_read(spark):
    """Rows of an index come without a shuffle of every word, and repeated keys stay documents of their own."""
    docs = table(spark, [*OLD, (7, "beta 10 beta alpha 9 10 10 é10", "a"), (7, "beta", "b"), (8, None, "a"), (9, "", "a")])
    rows = index.rows_of(docs, "doc_id", group="box")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.collection, r.length, r.term or "", r.tf) for r in rows.collect())
    want = retrieval.postings(docs.withColumn("doc_id", F.struct("doc_id", "box"))).select("doc_id.*", "length", "term", "tf").collect()
    whole = retrieval.worded(docs.withColumn("k", F.struct("doc_id", "box")), "k", "text").select("k.*", F.size("words").alias("n")).collect()
    assert got == sorted([tuple(r) for r in want] + [(r.doc_id, r.box, r.n, "", 1) for r in whole])
