"""The stored index, the search driver, the registry of tables, research, the catalogue, and readers of files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docbasin.functions import requests, scan
from docbasin.operators import catalog, content, governance, registry, research, retrieval, search, tables
from docbasin.sources import files, index, segments

TEXTS = ["alpha beta gamma", "beta beta delta", "gamma delta epsilon zeta", "alpha alpha alpha beta", "omega", "the of"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], "doc_id long, text string, box string")


def scores(frame):
    return {r.doc_id: round(r.score, 9) for r in frame.collect()}


def test_stored_index_equals_a_scan(spark, docs, tmp_path):
    stored = index.upsert(segments.latest(spark, f"file://{tmp_path}/index", "doc_id"), docs, group="box")
    for query in ("alpha delta", "beta beta", "nothing", "the", ""):
        assert scores(index.scores(stored, query)) == scores(retrieval.bm25_scores(docs, query)), query
    asked = spark.createDataFrame([(1, "alpha delta"), (2, "nothing"), (3, "beta beta")], "query_id long, query string")
    batch = {(r.query_id, r.doc_id): round(r.score, 9) for r in index.search(stored, asked).collect()}
    assert batch == {(q, d): s for q, text in ((1, "alpha delta"), (3, "beta beta")) for d, s in scores(retrieval.bm25_scores(docs, text)).items()}


def test_search_filters_hides_widens_and_reranks(spark, docs):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "doc_id long, embedding array<double>")
    asked = pd.DataFrame({"query_id": [0], "vector": [[0.0, 1.0]]})
    keyword = retrieval.bm25_scores(docs, "alpha delta")
    assert [r.doc_id for r in search.search(keyword, vectors, None, mode="keyword", k=2).collect()] == [r.doc_id for r in retrieval.top(keyword, 2).collect()]
    assert search.search(keyword, vectors, None, mode="keyword", k=9).agg(F.max("score")).first()[0] == 1.0
    assert [r.doc_id for r in search.search(keyword, vectors, asked, mode="semantic", k=3).collect()] == [0, 1, 2]
    only = spark.createDataFrame([(3,), (4,)], "doc_id long")
    assert {r.doc_id for r in search.search(keyword, vectors, asked, k=5, allowed=only).collect()} == {3, 4}
    assert search.search(keyword, vectors, asked, k=5, allowed=only.limit(0)).isEmpty()
    assert {r.doc_id for r in search.search(keyword, vectors, asked, mode="semantic", k=2, hidden=spark.createDataFrame([(0,)], "doc_id long")).collect()} == {1}
    longest = search.reranked(lambda q, t: t.str.len(), "alpha", docs)
    assert search.search(keyword, vectors, asked, mode="semantic", k=1, rerank=longest).first().doc_id == 2

    def broken(pool):
        raise RuntimeError

    def broken_in_tasks(pool):
        return pool.select("doc_id", F.pandas_udf(lambda t: 1 / 0, "double")("score").alias("score"))

    for bad in (broken, broken_in_tasks):
        assert search.search(keyword, vectors, asked, mode="semantic", k=1, rerank=bad).first().doc_id == 0
    some = search.search(keyword, vectors, asked, mode="semantic", k=3, rerank=lambda pool: pool.where("doc_id = 2"))
    assert [r.doc_id for r in some.collect()] == [2, 0, 1]
    wrong = keyword.select("doc_id", F.raise_error(F.lit("the caller's own")).cast("double").alias("score"))
    with pytest.raises(Exception, match="the caller's own"):
        search.search(wrong, vectors, None, mode="keyword", k=1, rerank=broken).collect()
    with pytest.raises(ValueError):
        search.search(keyword, vectors, asked, mode="odd")


def test_entities_raise_and_add_what_shares_them(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "doc_id long, embedding array<double>")
    asked = pd.DataFrame({"query_id": [0], "vector": [[1.0, 0.0]]})
    held = spark.createDataFrame([(3, "a"), (3, "b"), (0, "a"), (7, "a"), (7, "b"), (7, "c"), (8, "c")], "doc_id long, entity string")
    wanted = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.0)], "entity string, rarity double")
    hits = retrieval.entity_hits(held, wanted, cap=3)
    assert [(r.doc_id, r.n, round(r.lift, 6)) for r in hits.collect()] == [(7, 3, 0.1), (3, 2, 0.1), (0, 1, 0.0)]
    keyword = spark.createDataFrame([], "doc_id long, score double")
    got = {r.doc_id: round(r.score, 6) for r in search.search(keyword, vectors, asked, mode="semantic", k=2, shared=hits).collect()}
    assert got == {0: 1.0, 1: round(1 / 2**0.5, 6)}
    found = spark.createDataFrame([(0, 0.05), (1, 0.04)], "doc_id long, score double")
    got = {r.doc_id: round(r.score, 6) for r in search.with_entities(found, hits, vectors, asked, 4).collect()}
    assert got == {0: 0.05, 1: 0.04, 3: round(1 / 10**0.5 + 0.1, 6), 7: 0.1}
    assert [r.doc_id for r in search.with_entities(found, hits, vectors, None, 4, most=1).orderBy("doc_id").collect()] == [0, 1, 7]


def test_search_all_keeps_collections_apart(spark, docs, tmp_path):
    stored = index.upsert(segments.latest(spark, f"file://{tmp_path}/index", "doc_id"), docs, group="box")
    found = search.search_all(stored, "beta", 1).collect()
    want = {box: retrieval.top(retrieval.bm25_scores(docs.where(F.col("box") == box), "beta"), 1).first() for box in "ab"}
    assert {r.collection: (r.doc_id, round(r.score, 9)) for r in found} == {b: (w.doc_id, round(w.score, 9)) for b, w in want.items()}
    assert search.search_all(stored, "the").isEmpty()


def test_registry(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Account Name,Ticker,Value\n" + "".join(f"a{i},T{i},{i}\n" for i in range(1, 8)))
    raw = files.read_csv(spark, str(tmp_path / "t.csv"))
    table = registry.numbered(raw)
    assert [r[registry.ROW] for r in table.orderBy(registry.ROW).collect()] == list(range(1, 8))
    assert {r.column: r.samples for r in registry.samples(table).collect()}["Ticker"] == ["T1", "T2", "T3", "T4", "T5"]
    assert [r["Account Name"] for r in registry.rows(tables.coerce(table, {"Value": "integer"}), {"Account_Name": "Account Name"}, 2).collect()] == ["a1", "a2"]
    one = registry.entry(table, "HBIL178aef9d", "HBIL178aef9d.csv", None, "csv_data_HBIL178aef9d")
    other = registry.entry(table, "d2", "b.csv", "s", "csv_b")
    known = registry.register(registry.register(one, other), other)
    assert known.count() == 2 and known.first().row_count == 7
    assert registry.suggest(known, "HBIL178aef9d - HBIL178aef9d.csv").first().table_name == "csv_data_HBIL178aef9d"
    assert registry.suggest(known, "unrelated").isEmpty() and registry.suggest(known, " ").isEmpty()
    assert registry.resolve(known, "b.csv").first().document_id == "d2" and registry.resolve(known, "b.csv", ["x"]).isEmpty()
    assert registry.drop(known, "d2").count() == 1 and registry.listed(known).first().filename == "HBIL178aef9d.csv"
    texts = spark.createDataFrame([("csv_data_HBIL178aef9d", "x" * 50), ("csv_b", "y" * 20)], "table_name string, json string")
    assert [r.table_name for r in registry.inlined(known, texts, budget=60).collect()] == ["csv_data_HBIL178aef9d"]
    lots = spark.createDataFrame([("1", "a"), ("--", "sum"), ("2", "TOTAL x"), ("3", None)], "lot string, name string")
    assert [r.lot for r in registry.rolled_lots(lots, "lot", "name").collect()] == ["1", "3"]


def test_research(spark):
    plan = research.plan('find "late returns" and EQ-17', ["FIND  \"late returns\" and eq-17", "other"])
    assert [b["mode"] for b in plan] == ["hybrid", "hybrid", "keyword", "literal", "literal"] and plan[3]["query"] == "late returns"
    searches = spark.createDataFrame([(0, False), (0, True), (1, True), (2, False), (3, False)], "query_index long, failed boolean")
    selected = spark.createDataFrame([(0, "x", False), (0, "y", True), (3, "y", True)], "query_index long, key string, weak boolean")
    got = {r.query_index: (r.status, r.n_evidence, r.n_strong) for r in research.coverage(searches, selected).collect()}
    assert got == {0: ("retrieved", 2, 1), 1: ("search_failed", 0, 0), 2: ("no_selected_evidence", 0, 0), 3: ("weak_evidence", 1, 0)}
    assert research.next_steps(["retrieved"], 1) == ["context"] and research.next_steps(["weak_evidence"], 1) == ["context", "read_weak"] and research.next_steps(["search_failed"], 0) == ["rephrase"]
    table = spark.createDataFrame([("c", "d", "k1", 1, "e"), ("c", "d", None, 1, "e"), ("c", "d", None, 1, "e"), ("cd", "", None, 1, "e")], "c string, d string, k string, p int, e string")
    keys = [r[0] for r in table.select(research.evidence_key(*map(F.col, "cdkpe"))).collect()]
    assert len(set(keys)) == 3 and keys[1] == keys[2] and all(len(k) == 24 for k in keys)
    hits, failed = research.across({"a": selected, "b": ValueError("x")})
    assert failed == {"b": "ValueError"} and {r.collection_id for r in hits.collect()} == {"a"}
    with pytest.raises(ValueError):
        research.across({})
    shown = spark.createDataFrame([(10,), (20,)], "shown long")
    assert tuple(research.budget(searches, shown, 100).first()) == (100, 30, 3)


def test_catalogue(spark):
    boxes = spark.createDataFrame([("a", "Alpha", None), ("b", " ", False), ("c", "Gamma", True)], "collection_id string, name string, restricted boolean")
    assert [tuple(r) for r in catalog.list_collections(boxes, "b").collect()] == [("a", "Alpha", False), ("b", "b", True)]
    assert [r.collection_id for r in catalog.list_collections(boxes, "b", ["c"]).collect()] == ["c"] and catalog.scoped(boxes, []).isEmpty()
    rows = spark.createDataFrame([("d1", "a", "p1", "f1", "clear"), ("d2", "a", "p1", "f2", "quarantined"), ("d3", "b", "p2", "f3", None), ("d4", "b", None, "f4", None)], "document_id string, collection_id string, source_path string, filename string, policy_status string")
    assert {r.document_id for r in catalog.selected(rows, ["d1", "d2"], ["d2", "d3"]).collect()} == {"d2"} and catalog.selected(rows, None, []).isEmpty()
    assert catalog.document(rows, "d2").isEmpty() and catalog.document(rows, "d3").count() == 1
    assert {r.document_id for r in catalog.without_inlined(rows, rows.where("filename = 'f1'")).collect()} == {"d2", "d3", "d4"}
    again, missing = catalog.reindex_sources(rows, spark.createDataFrame([("p1",)], "path string"))
    assert [r.path for r in again.collect()] == ["p1"] and [r.path for r in missing.collect()] == ["p2"]
    assert catalog.cloned(rows, "a", "z", 1, 2, 3).where("collection_id = 'z'").count() == 2
    with pytest.raises(ValueError):
        catalog.cloned(rows, "a", "z", 2, 2, 3)
    assert catalog.cleared({"t": rows, "n": boxes.drop("collection_id")}, "a")["t"].count() == 2
    chunks = spark.createDataFrame([("k2", "d1", 1, 1), ("k1", "d1", 1, 0), ("k3", "d1", 2, 0), ("k4", "dx", 1, 0)], "chunk_id string, document_id string, page_number int, chunk_index int")
    assert [r.chunk_id for r in catalog.chunks_of(chunks, "d1", 2).collect()] == ["k1", "k2"]
    assert {r.document_id for r in catalog.existing(rows, chunks).collect()} == {"d1"}
    hits = spark.createDataFrame([("k1", 1.0), ("k4", 0.5), ("k9", 0.1)], "chunk_id string, score double")
    assert {(r.chunk_id, r.filename) for r in catalog.described(hits, chunks, rows).collect()} == {("k1", "f1"), ("k4", None)}
    past = spark.createDataFrame([(4, "t1", '{"q": "x"}')], "search_id long, timestamp string, payload string")
    more = catalog.add_history(past, spark.createDataFrame([("t3", "bad"), ("t2", None)], "timestamp string, payload string"))
    assert [(r.search_id, r.payload.q if r.payload else None) for r in catalog.recent_history(more, "q string").collect()] == [(6, None), (5, None), (4, "x")]
    jobs = spark.createDataFrame([(1, "done"), (2, "running"), (3, "pending")], "job_id long, status string")
    assert [r.job_id for r in catalog.active_jobs(jobs).collect()] == [3, 2] and catalog.recent_jobs(jobs, 0).count() == 1
    entries = spark.createDataFrame([("s#1", 2), ("s", 1), ("sx#1", 5)], "scope_key string, hits long")
    assert tuple(catalog.cache_stats(entries).first()) == (3, 8) and [r.scope_key for r in catalog.cache_cleared(entries, "s").collect()] == ["sx#1"]
    people = spark.createDataFrame([(1, "Ann")], "person_id long, name string")
    assert [tuple(r) for r in catalog.expertise(people, spark.createDataFrame([(1, "b"), (1, "a"), (2, "z")], "person_id long, topic string")).collect()] == [("a", "Ann"), ("b", "Ann")]


def test_csv_files_keep_rows_that_repeat_the_preamble(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("As Of,01/15/2026\nOwner: Ann\nName,Qty,Price\nann,1,2.5\nAs Of,01/15/2026,\n" + "".join(f"r{i},{i},1\n" for i in range(120)))
    got = [tuple(r) for r in files.read_csv(spark, path).collect()]
    assert len(got) == 122 and ("As Of", "01/15/2026", None) in [(a, b, c or None) for a, b, c in got]
    assert files.csv_metadata(spark, path) == {"As Of": "01/15/2026", "Owner": "Ann", "_raw_preamble": ["As Of | 01/15/2026", "Owner: Ann"]}
    pages = {r.page: r.text.split("\n") for r in files.csv_prose(spark, path).collect()}
    assert sorted(pages) == [1, 2, 3] and pages[1][:3] == ["Name | Qty | Price", "-" * 18, "ann | 1 | 2.5"] and len(pages[1]) == 52 and len(pages[3]) == 22


def test_formats(spark, tmp_path):
    (tmp_path / "a.py").write_text("\n".join(f"x = {i}" for i in range(150)))
    (tmp_path / "b.json").write_text("{not json")
    found = files.text_files(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.section): r.text for r in files.file_pages(files.checked_formats(found)).collect()}
    assert got[("a.py", 1)].startswith("x = 100") and got[("b.json", 0)] == "{not json"
    (tmp_path / "c.exe").write_text("x")
    with pytest.raises(ValueError):
        files.checked_formats(files.text_files(spark, str(tmp_path)))


def test_scanners(spark):
    assert scan.form_likelihood("") == 0 and scan.form_likelihood("Name: x\nAge: 3") == pytest.approx(0.75) and scan.form_likelihood(" ".join(["w"] * 30)) == 0
    code = "import os\n\n" + "\n".join(f"setting_{i} = {i}" for i in range(10)) + "\n\ndef f(x):\n" + "    y = 1\n" * 300 + "\nclass A:\n    pass\n"
    out = scan.code_chunks(code, "python")
    assert [c["kind"] for c in out][0] == "code_block" and out[-1]["name"] == "A" and all(len(c["text"]) <= 1500 for c in out)
    covered = {n for c in out for n in range(c["begin"], c["end"] + 1)}
    lines = code.splitlines()
    assert all(n in covered for n, line in enumerate(lines, 1) if line.strip()) and all("\n".join(lines[c["begin"] - 1 : c["end"]]) == c["text"] for c in out)
    assert content.code_chunks(spark.createDataFrame([("k", code)], "id string, text string"), "python", key="id").count() == len(out)
    assert content.chunk(spark.createDataFrame([("k", "short")], "id string, text string"), key="id").first().id == "k"
    pages = spark.createDataFrame([("d", 0.2, False, False), ("d", 0.7, True, False), ("e", 0.0, False, False)], "document_id string, score double, flagged boolean, critical boolean")
    assert {tuple(r) for r in content.document_policy(pages).collect()} == {("d", 0.7, True, False, 1), ("e", 0.0, False, False, 0)}
    assert scan.begins_sentence("a. " + " " * 50 + "P", 53) and scan.begins_sentence('x!") P', 5) and not scan.begins_sentence("a  P", 3)
    assert scan.entities("He came." + " " * 50 + "London was far.") == [] and scan.entities("He saw London.") == ["london"]


def test_requests():
    assert requests.load_bearing("unless 2024.") == requests.load_bearing("UNLESS 2024") == ["2024", "unless"] and requests.load_bearing("I don't") == ["don't"]
    assert requests.same_question("How  many?", "how many?", 1.0) and not requests.same_question("not a", "a", 0.9) and requests.same_question("the sum of 3", "sum 3", 0.9)
    assert requests.exact_intent('find "x y"') and requests.exact_intent("the exact words") and not requests.exact_intent("exactness")
    assert requests.cacheable(1, 2, 0) and not requests.cacheable(2, 2, 0) and not requests.cacheable(1, 0, 0) and not requests.cacheable(1, 1, 1)
    assert tables.FORBIDDEN[:3] == ["insert", "update", "delete"]


def test_integers_are_cut_towards_zero(spark):
    got = tables.coerce(spark.createDataFrame([("-408.8",), ("408.8",), ("1e30",)], "a string"), {"a": "integer"}, raw=False).collect()
    assert [r.a for r in got] == [-408, 408, None]


def test_entity_boost_by_hand(spark):
    """The query's rows against plain Python over a made corpus: resolving, lifts of two or more entities, and what has no score."""
    made = ["Alice Brown met the Baltic Board in June.", "The Baltic Board wrote to Alice Brown and Carl Stone.", "Carl Stone alone. Rain fell.", "nothing named here, rain", "we saw Dora Reed and the Baltic Board", None, "", *["rain"] * 4]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = content.entities(docs)
    by_doc = {}
    for r in found.select("doc_id", "entity").distinct().collect():
        by_doc.setdefault(r.doc_id, set()).add(r.entity)
    rarity = {r.entity: r.rarity for r in content.usable_entities(found, docs.count()).collect()}
    question = "did Alice Brown ask the Baltic Board about rain"
    asked = content.asked_entities(content.usable_entities(found, docs.count()), question)
    names = {r.entity for r in asked.collect()}
    assert names == {"alice brown", "baltic board"}
    scores = spark.createDataFrame([(2, 1.0), (3, 0.5), (0, 0.25)], "doc_id long, score double")
    out = retrieval.entity_boost(scores, found.join(asked, "entity").select("doc_id", "entity", "rarity"))
    expected = {2: 1.0, 3: 0.5, 0: 0.25}
    for d, held in by_doc.items():
        shared = held & names
        total = sum(rarity[e] for e in shared)
        if shared:
            expected[d] = expected.get(d, 0.0) + (0.2 * total / (1 + total) if len(shared) >= 2 else 0.0)
    assert {r.doc_id: round(r.score, 9) for r in out.collect()} == {d: round(v, 9) for d, v in expected.items()} and {0, 1, 4} <= set(expected)


QUOTED = [
    'a,b,c\n1,"two\nlines",3\n4,"say ""hi"", then\n\n""bye""",6\n7,8 "mid" quote,9\n',
    'x,"y\r\nz",w\r\n"1","2","3"\r\n,"",\r\n',
    '"only\none\nfield\n"\n\n"a"b"c",d,"e\n,f"g\nh,i,j',
    'p,q,r\n"open"\n"closed, ""twice""\nand ""more"",",t,u\nv,w,x\n',
    "bare\rreturn,s,t\nu,\"v\rw\",x\n",
]


def test_records_equal_pythons_wherever_the_file_is_cut(spark, tmp_path, monkeypatch):
    import csv
    import io

    for i, text in enumerate(QUOTED):
        (tmp_path / f"q{i}.csv").write_bytes(text.encode())
    want = [(f"q{i}.csv", r) for i, text in enumerate(QUOTED) for r in csv.reader(io.StringIO(text, newline="")) if r]
    before = {n: spark.conf.get(n, None) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    real, cuts = files.stored, []

    def cut_small(size):
        def run(df, name):
            try:
                for n, v in zip(before, (str(size), "0", "1"), strict=True):
                    spark.conf.set(n, v)
                cuts.append(df.rdd.getNumPartitions())
                return real(df, name)
            finally:
                for n, v in before.items():
                    spark.conf.set(n, v) if v is not None else spark.conf.unset(n)

        return run

    for size in [2, 5, 10_000]:
        monkeypatch.setattr(files, "stored", cut_small(size))
        got = files.cells(files.records(spark, str(tmp_path))).collect()
        placed = sorted((r.path.rsplit("/", 1)[1], r.record, r.part, list(r["cells"])) for r in got)
        assert [(p, c) for p, _, _, c in placed] == want, size
    assert cuts[0] > 100 and cuts[1] > 40


def test_quoted_cells_become_a_table_and_a_quote_left_open_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text('Report,,\nName,Note,Price,Qty\nann,"one\ntwo, three",1.5,7\nbob,,2,\nName,Note,Price,Qty\n"c""d",x,3,8\n')
    table = files.read_table(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in table.orderBy(registry.ROW).collect()] == [("ann", "one\ntwo, three", "1.5", "7", 1), ("bob", None, "2", None, 2), ('c"d', "x", "3", "8", 3)]
    monkeypatch.setattr(files, "RECORD_CHARS", 20)
    (tmp_path / "o.csv").write_text('a,b,c\n1,"never closed,3\n' + "4,5,6\n" * 10)
    with pytest.raises(ValueError, match="isn't closed"):
        files.records(spark, str(tmp_path / "o.csv"))


def test_every_row_is_numbered_once(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    want = [r.o_orderkey for r in orders.select("o_orderkey").orderBy("o_orderkey").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = registry.numbered(orders, ["o_orderkey"]).select(registry.ROW, "o_orderkey").orderBy(registry.ROW).collect()
            assert [r[registry.ROW] for r in got] == list(range(1, len(want) + 1)) and [r.o_orderkey for r in got] == want
        assert {r[0] for r in registry.numbered(orders).select(registry.ROW).collect()} == set(range(1, len(want) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def money():
    def number(t):
        return pd.to_numeric(t.str.replace(r"[$,]", "", regex=True), errors="coerce")

    return tables.TypeExtension("currency", "double", lambda t: t.str.match(r"^-?\$[\d,]+(\.\d+)?$"), lambda t: number(t.where(t.str.contains("$", regex=False))))


def percent():
    return tables.TypeExtension("percent", "double", lambda t: t.str.match(r"^-?[\d.]+%$"), lambda t: pd.to_numeric(t.str.rstrip("%"), errors="coerce").where(t.str.endswith("%")))


def test_type_extensions_and_roles(spark):
    rows = [("$1,591.20", "5%", "$10", "2.5", "1", "yes"), ("$3", "7.5%", "(408.80)", "1%", "2", "no"), ("$4.5", "n/a", "20", "3", "$3", "yes"), ("$5", "x", "$1,000", "x", "4", "no"), ("x", "1%", "30", "4", "5", "yes"), ("$7", "2%", "$2", "5", "6", "no")]
    table = spark.createDataFrame(rows, "price string, rate string, mixed string, plain string, whole string, flag string")
    extensions = [money(), percent()]
    got = {r.column: r.type for r in tables.infer_types(table, extensions).collect()}
    assert got == {"price": "currency", "rate": "percent", "mixed": "real", "plain": "real", "whole": "real", "flag": "boolean"}
    assert {r.column: r.type for r in tables.infer_types(table).collect()} == {"price": "text", "rate": "text", "mixed": "text", "plain": "text", "whole": "integer", "flag": "boolean"}
    typed = [tuple(r) for r in tables.coerce(table, got, extensions=extensions).select("price", "price__raw", "rate", "mixed", "whole").collect()]
    assert typed[0] == (1591.2, "$1,591.20", 5.0, 10.0, 1.0) and typed[1][3] == -408.8 and typed[2] == (4.5, "$4.5", None, 20.0, 3.0) and typed[4][:2] == (None, "x")
    found = tables.roles(tables.infer_types(table), [lambda c, t: "share" if "rate" in c else None, lambda c, t: "label" if t == "text" else None])
    assert {r.column: r.role for r in found.collect()} == {"price": "label", "rate": "share", "mixed": "label", "plain": "label", "whole": None, "flag": None}
    big = spark.createDataFrame([("9007199254740993",), ("-9,007,199,254,740,995",), ("1e3",)], "n string")
    assert [r.n for r in tables.coerce(big, {"n": "integer"}).collect()] == [9007199254740993, -9007199254740995, 1000]


def test_profiles_take_the_first_values_in_order(spark):
    rows = [(i, float(i) if i % 3 else None, float("nan") if i == 1 else float(-i)) for i in range(1, 31)]
    table = spark.createDataFrame(rows, "k long, a double, b double").repartition(5)
    got = {r.column: r.asDict() for r in tables.column_profile(table, ["a", "b"], "k", most=4).collect()}
    assert got["a"] == {"column": "a", "nulls": 10, "distinct": 4, "n": 4, "min": 1.0, "max": 5.0, "mean": 3.0, "total": 12.0, "p25": 2.0, "p50": 4.0, "p75": 4.0}
    assert got["b"]["nulls"] == 1 and got["b"]["min"] == -5.0 and got["b"]["total"] == -14.0
    small = [(r.column, r.k, r.v) for r in tables.first_values(table, ["a"], "k", most=5, block=2).orderBy("k").collect()]
    assert small == [("a", i, v) for i, v in enumerate(["1.0", "2.0", "4.0", "5.0", "7.0"], 1)]
    assert tables.column_profile(table.limit(0), ["a"], "k").first().n == 0


PATTERNS = ["b+c", "(?<=a)b", "(?P<x>b)c", r"c\Z", "c$", "^a.c", r"\bword\b", r"\d+", "[^a-c]+", "é", "(a|b)(c|d)?", "x{2,3}?", r"(b)\1", "straSSe", "k", "s+t", "a[[b]", "(?i)ABC", "a.b"]


@pytest.mark.parametrize("ignore", [True, False])
def test_patterns_find_what_python_finds(spark, ignore):
    import re

    texts = ["abc", "abbcc", "a\nc", "abc\n", "ABC", "word sword", "x٣٤ 12", "É é", "xxxx", "bb", "straße STRASSE", "K kelvin", "ſt st", "a[b", "a\r\nc ", "a\rb", "a\u0085b", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    routes = set()
    for p in PATTERNS:
        routes.add(retrieval.same_in_java(p, ignore))
        compiled = re.compile(p, re.I if ignore else 0)
        want = [(i, m[0], m.start() + 1) for i, t in enumerate(texts) if t is not None and (m := compiled.search(t))]
        assert [tuple(r) for r in retrieval.find_regex(docs, p, ignore_case=ignore).collect()] == want, p
    assert routes == {True, False}
    with pytest.raises(ValueError):
        retrieval.find_regex(docs, "(")
    slow = spark.createDataFrame([(1, "a" * 60 + "!")], "doc_id long, text string")
    with pytest.raises(Exception, match="(?i)timed? ?out"):
        retrieval.find_regex(slow, r"(?=a)(a|aa)+$\Z", seconds=0.2).collect()


def test_shares(spark):
    shares = spark.createDataFrame([("s1", "c1", "read", True, "Ann@x.org", None), ("s2", "c1", "readwrite", True, "bob@x.org", "2020-01-01"), ("s3", "c2", "read", False, "ann@x.org", None), ("s4", "c2", "readwrite", True, None, "2999-01-01")], "share_id string, collection_id string, permission string, is_active boolean, invited_email string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    members = spark.createDataFrame([("s1", "ann@x.org"), ("s2", "ANN@x.org"), ("s3", "ann@x.org"), ("s4", "eve@x.org"), ("s2", "ann@x.org")], "share_id string, user_id string")
    emails = spark.createDataFrame([(" ann@X.org ",), ("eve@x.org",), ("nobody@x.org",), ("bob@x.org",)], "email string")
    counted = governance.active_shares(emails, shares, members)
    assert {tuple(r) for r in counted.collect()} == {("ann@x.org", 2), ("eve@x.org", 1), ("nobody@x.org", 0), ("bob@x.org", 1)}
    assert {r.email: r.shares for r in governance.active_shares(emails, shares, members, exclude="s1").collect()}["ann@x.org"] == 1
    assert "NestedLoop" not in counted._jdf.queryExecution().executedPlan().toString()
    access = governance.share_access(shares, members, "2026-01-01", ["readwrite", "read"])
    assert {tuple(r) for r in access.collect()} == {("c1", "ann@x.org", "read"), ("c2", "eve@x.org", "readwrite")}
    collections = spark.createDataFrame([("c1", 2), ("c2", 1)], "collection_id string, created_at int")
    assert [(r.collection_id, r.permission) for r in governance.shared_collections(collections, shares, members, "ann@x.org").collect()] == [("c1", "read"), ("c1", "readwrite")]


def test_bundles_leave_out_what_is_hidden_blocked_or_of_another_model(spark, tmp_path):
    documents = spark.createDataFrame([("d1", "h1", None), ("d2", "h2", "quarantined"), ("d3", "h3", "clear")], "document_id string, content_hash string, policy_status string")
    vectors = spark.createDataFrame([(d, [1.0]) for d in ("d1", "d2", "d3")], "document_id string, embedding array<double>")
    path = f"file://{tmp_path}/bundle"
    files.export_bundle({"documents": documents, "vectors": vectors, "postings": vectors}, path, "b", "local::m")
    same = files.import_bundle(spark, path, documents.where("document_id = 'd3'"), "local::m")
    assert {t: {r.document_id for r in f.collect()} for t, f in same.items()} == {"documents": {"d1"}, "vectors": {"d1"}}
    assert set(files.import_bundle(spark, path, signature="other")) == {"documents"} == set(files.import_bundle(spark, path))


def test_collections_of_a_search_and_searches_that_fail_when_they_run(spark):
    assert research.chosen_collections(["*"], list("abcdefghij")) == list("abcdefgh") and research.chosen_collections(["b", "a", "b"], ["a", "b"]) == ["b", "a"]
    for bad in ([], ["a", "*"], ["x"], list("abcdefghi")):
        with pytest.raises(ValueError):
            research.chosen_collections(bad, list("abcdefghi"))
    good = spark.createDataFrame([("k", 1.0)], "key string, score double")
    found, failed = research.across_collections(spark, {"a": lambda: good, "b": lambda: good.select("key", F.raise_error(F.lit("x")).cast("double").alias("score"))})
    assert [tuple(r) for r in found.collect()] == [("k", 1.0, "a")] and list(failed) == ["b"]


def test_small_tables_as_json_and_fields_of_recognised_chunks(spark):
    table = spark.createDataFrame([(2, "b", None, "x"), (1, "a", 1.5, "y")], f"{registry.ROW} long, name string, v double, v__raw string")
    assert registry.as_json(table, "t.CSV").first().json == '[{"name":"a","v":1.5},{"name":"b","v":null}]'
    assert registry.as_json(table, "t.csv", rows=1).isEmpty() and registry.as_json(table, "t.pdf").isEmpty()
    chunks = spark.createDataFrame([("d1", "d1:0", 1, 0, "Order: 7\nStatus: open"), ("d1", "d1:1", 2, 0, "plain"), ("d2", "d2:0", 1, 0, "Order: 9")], "document_id string, chunk_id string, page_number int, chunk_index int, text string")
    documents = spark.createDataFrame([("d1", "ocr"), ("d2", "text")], "document_id string, method string")
    assert [(r.chunk_id, r.fields) for r in catalog.inspected(chunks, documents, "d1").collect()] == [("d1:0", {"Order": "7", "Status": "open"}), ("d1:1", {})]
    assert [r.fields for r in catalog.inspected(chunks, documents, "d2").collect()] == [{}]


def test_no_field_of_a_long_form_is_left_out(spark):
    forms = spark.range(3).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("Line "), i, F.lit(": "), i + F.col("id"))), "\n").alias("text"))
    found = content.form_fields(forms)
    assert found.count() == 600 and found.where("field <> concat('Line ', cast(value as bigint) - doc_id)").isEmpty()
    chunks = forms.where("doc_id = 0").select(F.lit("d").alias("document_id"), F.lit("d:0").alias("chunk_id"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), "text")
    assert len(catalog.inspected(chunks, spark.createDataFrame([("d", "hybrid")], "document_id string, method string"), "d").first().fields) == 200
