import io
import zipfile

from pyspark.sql import functions as F

from docbasin.operators import maintenance as m
from docbasin.sources import office


def docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Lots" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([f"p{i}" for i in range(12)] + [" "]))
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.docx").write_bytes(b"broken")
    assert office.xlsx_sheets(xlsx()) == [("Lots", [["Name", "", "Qty"], ["7"]])]
    got = {(r.path.rsplit("/", 1)[1], r.section): r.text for r in office.office_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", 0): "\n\n".join(f"p{i}" for i in range(10)), ("a.docx", 1): "p10\n\np11", ("b.xlsx", 0): "[Sheet: Lots]\nName | Qty\n7"}


def test_documents(spark):
    old = spark.createDataFrame([("x", "clear", "2026-01-02", "d1"), ("y", "flagged", "2026-01-01", "d2"), ("z", "quarantined", "2026-01-03", "d3")], "filename string, policy_status string, upload_timestamp string, document_id string")
    assert [r.document_id for r in m.review_queue(old).collect()] == ["d3", "d2"]
    assert {r.document_id: r.policy_status for r in m.set_where(old, F.col("document_id") == "d2", policy_status=None).collect()} == {"d1": "clear", "d2": None, "d3": "quarantined"}
    assert {r.filename for r in m.upsert(old, old.limit(0), "document_id").collect()} == {"x", "y", "z"}
    assert m.delete_documents({"d": old, "n": spark.range(2)}, old.where("document_id = 'd1'"))["d"].count() == 2
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "filename string, text string")
    there = rows.limit(1).select(F.sha2("text", 256).alias("content_hash"))
    bad = spark.createDataFrame([("two",)], "t string").select(F.sha2("t", 256).alias("content_hash"))
    assert {r.filename: r.status for r in m.add_documents(there, rows, bad).collect()} == {"a": "duplicate", "b": "blocked", "c": "new"}
    grants = [spark.createDataFrame(g, "collection_id string, permission string") for g in ([("c1", "read")], [("c1", "owner"), ("c2", "read")], [("c2", "write")])]
    assert {tuple(r) for r in m.visible_collections(grants).collect()} == {("c1", "owner"), ("c2", "write")}


def test_cache(spark):
    schema = "entry_id long, scope_key string, embedding_model string, vec array<float>, last_used long, fingerprints array<struct<collection_id:string,document_id:string,filename:string,upload_timestamp:string,num_chunks:int>>"
    mark = [("c", "d1", "a.pdf", "2026", 3)]
    entries = spark.createDataFrame([(1, "s", "m", [1.0, 0.0, 0.0], 10, mark), (2, "s", "m", [0.0, 1.0, 0.0], 20, [("c", "d2", "b.pdf", "2026", 1)]), (3, "t", "m", [1.0, 0.0, 0.0], 5, [])], schema)
    assert m.cache_find(entries, "s", "m", [0.9, 0.1, 0.0], 0.9).first().entry_id == 1
    assert m.cache_find(entries, "s", "m", [0.5, 0.5, 0.7], 0.9).count() == 0 and m.cache_find(entries, "s", "other", [1, 0, 0], 0.1).count() == 0
    new = spark.createDataFrame([(4, "s", "m", [1.0, 0.01, 0.0], 30, mark)], schema)
    assert {r.entry_id for r in m.cache_store(entries, new, cap=2).collect()} == {2, 3, 4}
    assert {r.entry_id for r in m.cache_store(entries, new, cap=1).collect()} == {3, 4}
    documents = spark.createDataFrame([("c", "d1", "a.pdf", "2026", 3, None), ("c", "d2", "b.pdf", "2026", 1, "quarantined")], "collection_id string, document_id string, filename string, upload_timestamp string, num_chunks int, policy_status string")
    assert {r.entry_id for r in m.cache_valid(entries, documents).collect()} == {1, 3}
