"""Operators on small tables, and the registered queries against DuckDB."""

import sqlite3

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docbasin.operators import content, governance, retrieval, tables
from docbasin.plans import queries
from docbasin.sources import files
from docbasin.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join("null" if v is None or v is pd.NaT or v != v else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name in queries.ORACLE:
        want = duck.execute(queries.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_bm25_equals_full_text_search_of_sqlite(spark):
    texts = ["alpha beta gamma", "beta beta delta", "gamma delta epsilon zeta", "alpha alpha alpha beta", "omega", "the of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(t)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("insert into f(rowid, t) values (?, ?)", [(i + 1, t) for i, t in enumerate(texts) if t != "the of"])
    want = {i - 1: -s for i, s in db.execute("select rowid, bm25(f) from f where f match 'alpha OR delta'")}
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(docs, "alpha delta").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert retrieval.bm25_scores(docs, "the").count() == 0
    asked = spark.createDataFrame([(1, "alpha delta"), (2, "nothing")], "query_id long, query string")
    batch = {r.doc_id: r.score for r in retrieval.bm25_search(retrieval.postings(docs), asked).collect()}
    assert all(abs(batch[k] - got[k]) < 1e-9 for k in got)


def test_rank_fusion_counts_ranks_before_skipping(spark):
    hits = [("a", 1, "x", ""), ("a", 2, "x", "t"), ("a", 3, "x", "t"), ("b", 4, "y", "t"), ("b", 1, "x", "t")]
    got = {r.key: (r.score, r.best_rank, r.branch_hits, r.weak) for r in retrieval.rank_fusion(spark.createDataFrame(hits, "branch string, rank int, key string, excerpt string")).collect()}
    assert got == {"x": (round(1 / 61 + 1 / 62, 8), 1, 2, False), "y": (round(1 / 64, 8), 4, 1, True)}


def test_filters(spark):
    docs = spark.createDataFrame([("d1", "alpha.pdf", "2026-01-10", "pdf"), ("d2", "beta.pdf", "2026-03-20", "pdf"), ("d3", "data.csv", "2026-06-01", "csv"), ("d4", "x", None, None)], "document_id string, filename string, upload_timestamp string, source_format string")

    def ids(**f):
        return {r.document_id for r in governance.filtered(docs, **f).collect()}

    assert ids() == {"d1", "d2", "d3", "d4"} and ids(ids=[]) == set() and ids(ids=["d1"]) == {"d1"}
    assert ids(formats=["PDF"]) == {"d1", "d2"} and ids(formats=[".csv"]) == {"d3"} and ids(names=["ALPHA.PDF"]) == {"d1"}
    assert ids(since="2026-02-01", until="2026-04-01") == {"d2"} and ids(formats=["pdf"], since="2026-02-01") == {"d2"}


def test_types(spark):
    table = spark.createDataFrame([("Apr 11, 2026", "1591.20", "10", "yes", "a"), ("04/12/2026", "(408.80)", "12", "no", "b"), ("n/a", "1.5K", "--", "", "c"), (None, "x", "7", "YES", "d"), ("2026-1-2 10:30", "2", "1,000", "No", "")], "`Trade Date` string, Amount string, Quantity string, Done string, Note string")
    kinds = {r.column: r.type for r in tables.infer_types(table).collect()}
    assert kinds == {"Trade Date": "date", "Amount": "real", "Quantity": "integer", "Done": "boolean", "Note": "text"}
    out = tables.coerce(table, kinds)
    assert out.columns == ["Trade_Date", "Trade_Date__raw", "Amount", "Amount__raw", "Quantity", "Quantity__raw", "Done", "Note"]
    got = [tuple(r) for r in out.collect()]
    assert [g[0] for g in got] == ["2026-04-11", "2026-04-12", None, None, "2026-01-02T10:30:00"]
    assert [g[2] for g in got] == [1591.2, -408.8, 1500.0, None, 2.0] and [g[4] for g in got] == [10, 12, None, 7, 1000]
    assert [g[6] for g in got] == [True, False, None, True, False]


REFUSED = [
    "select count(*) from t, parquet.`{path}` x", "select * from `parquet`.`{path}`", "select * from secret_other", "select (select max(id) from secret_other)",
    "with a as (select * from secret_other) select * from a", "select * from t where id in (select id from secret_other)",
    "select * from (with secret_other as (select 1 as id) select * from t) x, secret_other", "select reflect('java.lang.System', 'currentTimeMillis')",
    "select transform(id) using 'cat' as (x) from t", "with a as (select 1) insert into t select * from a", "show tables", "select * from read_files('/x')",
    "select * from identifier('secret_other')", "select * from identifier('secret'||'_other')", "select * from identifier('parquet.`{path}`')",
    "select identifier('java_method')('java.lang.System', 'getProperty', 'user.home') from t", "select identifier('reflect')('java.lang.System', 'currentTimeMillis') from t",
    "select try_reflect('java.lang.System', 'exit', 1)", "select system.builtin.java_method('a', 'b')", "select own_udf(id) from t", "select input_file_name() from t", "select current_user()",
    "select * from range(1000000000000)", "select explode(sequence(1, 1000000000000))", "select explode(sequence(1, id * 1000000000)) from t", "select * from t lateral view explode(sequence(1, 10000000)) as y",
    "select repeat('x', 1000000000)", "select array_repeat(id, 100000000) from t", "select lpad('x', 2000000000, 'y')", "select explode(sequence(timestamp'2000-01-01', timestamp'2100-01-01', interval 1 second))",
    "with a as (select * from identifier('secret_other')) select * from a", "select (select max(id) from identifier('secret_other'))", "select * from range(5) union all select * from range(0, 9000000000)",
    "select * from t; select 1", "select 1 from global_temp.x", "select a.* from t lateral view explode(array(1)) z as y, secret_other a", "select (1", "drop table t",
]
ALLOWED = {
    "select * from t": 10, "with a as (select id from t), b as (select * from a) select * from b where id > (select min(id) from a)": 9,
    "select id, y from t lateral view explode(array(1, 2)) z as y": 20, "select * from T union select * from t": 10, "select * from range(5)": 5, "select 'insert ; drop' as x from t": 10,
    "select id, sum(id) over (order by id) as s, row_number() over w as k from t window w as (partition by id % 2 order by id)": 10, "select * from (values (1, 'a'), (2, 'b')) v(x, y) join t on x = id": 2,
    "select explode(sequence(1, 12)) as y": 12, "select explode(sequence(date'2026-01-01', date'2026-12-31', interval 1 month)) as y": 12, "select transform(array(id, 2), x -> x + 1) as a, lpad(id, 5, '0') as b from t": 10,
    "select id % 2 as k, count(distinct id) as n, max(id) filter (where id > 3) as m from t group by rollup(id % 2) having count(*) > 0": 3, "select * from t where id in (select id from t where id < 3) order by id limit 2 offset 1": 2,
    "with recursive r as (select 1 as n union all select n + 1 from r where n < 5) select * from r": 5, "select id from t;;": 10,
}


def test_guarded_sql(spark, sf_dir):
    view = {"t": spark.range(10)}
    spark.range(3).createOrReplaceTempView("secret_other")
    spark.range(7).createOrReplaceTempView("t")
    spark.udf.register("own_udf", lambda x: x, "long")
    for sql in REFUSED:
        with pytest.raises(ValueError):
            tables.query(spark, sql.format(path=f"{sf_dir}/nation.parquet"), view)
    for sql, n in ALLOWED.items():
        assert tables.query(spark, sql, view).count() == n, sql
    assert spark.table("t").count() == 7
    assert tables.query(spark, "select id from t", view, 3).count() == 4
    assert tables.result(spark, "select id from t", view, 3) == {"columns": ["id"], "rows": [(0,), (1,), (2,)], "row_count": 3, "truncated": True}
    assert not tables.result(spark, "select id from t", view, 10)["truncated"]


def test_a_function_in_the_place_of_sparks_own_is_refused(spark):
    other = spark.newSession()
    other.udf.register("levenshtein", lambda a, b: 0, "int")
    with pytest.raises(ValueError):
        tables.query(other, "select levenshtein('a', 'b')", {"t": other.range(1)})
    assert tables.query(spark, "select levenshtein('a', 'b') as d", {"t": spark.range(1)}).first().d == 1


def test_threads_see_their_own_views(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: tables.query(spark, "select count(*) as n from same_name", {"same_name": spark.range(n)}).first().n, range(1, 17)))
    assert got == list(range(1, 17))


def test_entities_of_the_query_are_resolved_boosted_and_add_documents(spark):
    texts = ["met Alice Johnson about Titan Renewal", "for Alice Johnson and Titan Renewal", "of Zeta and Omega", "with Zeta and Omega", "plain budget words", "budget of Titan Renewal", *["filler"] * 14]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = content.entities(docs)
    usable = content.usable_entities(found, docs.count())

    def boosted(query):
        asked = content.asked_entities(usable, query)
        shared = found.join(asked, "entity").select("doc_id", "entity", "rarity")
        scores = spark.createDataFrame([(0, 1.0), (2, 2.0), (4, 3.0)], "doc_id long, score double")
        return {r.entity for r in asked.collect()}, {r.doc_id: round(r.score, 6) for r in retrieval.entity_boost(scores, shared).collect()}

    assert boosted("what is the budget") == (set(), {0: 1.0, 2: 2.0, 4: 3.0})
    # rarity: alice johnson 1 - 2/3, titan renewal 1 - 3/3
    lift = round(0.2 * (1 / 3) / (4 / 3), 6)
    assert boosted("did Alice know Project Titan") == ({"alice johnson", "titan renewal"}, {0: 1.0 + lift, 1: lift, 2: 2.0, 4: 3.0, 5: 0.0})
    assert boosted("about Zeta then")[1] == {0: 1.0, 2: 2.0, 3: 0.0, 4: 3.0}
    few = retrieval.entity_boost(spark.createDataFrame([], "doc_id long, score double"), spark.range(40).selectExpr("id as doc_id", "'e' as entity", "0.5 as rarity"))
    assert sorted(r.doc_id for r in few.collect()) == list(range(25))


def test_registered_sql_returns_every_row(spark):
    large = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{large}/{t}.parquet')")
    for name in ("user_sql_subquery", "user_sql_outer", "user_sql_window", "user_sql_window_all", "token_df"):
        got = queries.QUERIES[name](spark, large).toPandas()
        assert rows(got) == rows(con.execute(queries.ORACLE[name]).df())
    assert tables.query(spark, "select id from t", {"t": spark.range(3000)}, 5000).count() == 2001


def test_profile_of_many_distinct_values_is_exact_and_gathers_none(spark):
    table = spark.range(5000).selectExpr("(id * 7919 % 5000) * 0.5 - 100 as a", "case when id % 3 > 0 then cast(id % 11 as double) end as b", "cast(null as double) as c")
    out = tables.profile(table, ["a", "b", "c"])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, values = {r.column: r for r in out.collect()}, table.toPandas()
    for c in "ab":
        v = sorted(values[c].dropna())
        assert [got[c].p25, got[c].p50, got[c].p75] == [v[round(p * (len(v) - 1))] for p in (0.25, 0.5, 0.75)]
        assert (got[c].nulls, got[c].distinct, got[c].min, got[c].max) == (5000 - len(v), len(set(v)), v[0], v[-1])
    assert (got["c"].nulls, got["c"].distinct, got["c"].p50) == (5000, 0, None)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx\n# B\ny")
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.csv").write_text("Report,,\nName,Qty,Price\nann,1,2.5\nName,Qty,Price\nbob,2,3\n")
    found = {(r.path.rsplit("/", 1)[1], r.section): r.text for r in files.file_pages(files.text_files(spark, str(tmp_path))).collect()}
    assert found[("a.md", 0)] == "# A\nx" and found[("a.md", 1)] == "# B\ny" and found[("b.txt", 0)] == "café"
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv")).collect()) == [("ann", "1", "2.5"), ("bob", "2", "3")]


def test_bundle(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "clear", "h1"), ("d2", "quarantined", "h2"), ("d3", None, "h3")], "document_id string, policy_status string, content_hash string")
    files.export_bundle({"documents": docs}, str(tmp_path / "b"), "mine")
    back = files.import_bundle(spark, str(tmp_path / "b"), spark.createDataFrame([("h3",)], "content_hash string"))
    assert [r.document_id for r in back["documents"].collect()] == ["d1"]


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == content.chunk(docs).count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    live = ingest.usage_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(turns) from windows").first()[0] == events.count() == ingest.usage_windows(events).agg(F.sum("turns")).first()[0]


def test_sensitivity_and_quota(spark):
    levels = spark.createDataFrame([("public", "internal"), (None, "restricted"), ("odd", None)], "own string, coll string")
    assert [r[0] for r in levels.select(governance.sensitivity(F.col("own"), F.col("coll"))).collect()] == ["public", "restricted", "internal"]
    assert tuple(governance.quota(spark.createDataFrame([(150,)], "used long"), 100).first()) == (150, 0, 100.0)


def test_scanners_hold_few_texts_at_once(spark):
    """Batches are cut by rows and by characters, whatever the table's size; rows and their order stay."""
    from docbasin.operators import content

    texts = ["a" * 700_000, None, "b" * 600_000, "c", "d" * 1_500_000, "e"]
    cut = list(content.pieces([pd.DataFrame({"k": range(6), "text": texts})], "text"))
    assert [list(p["k"]) for p in cut] == [[0, 1], [2, 3], [4], [5]] and [list(p["k"]) for p in content.pieces([pd.DataFrame({"k": [], "text": []})], "text")] == [[]]
    content.chunk(spark.range(3).selectExpr("id as doc_id", "'word' as text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 300
