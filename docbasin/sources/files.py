"""Readers of files as rows: text with a fallback encoding, CSV with a sniffed header, pages of other formats, bundles."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbasin.functions.scan import preamble
from docbasin.operators.content import sections
from docbasin.operators.registry import ROW, numbered
from docbasin.operators.tables import DATES
from docbasin.session import stored

CODE = {"py": "python", "rb": "ruby", "js": "javascript", "ts": "typescript", "java": "java", "c": "c", "cpp": "cpp", "go": "go", "rs": "rust", "cs": "csharp"}
PAGED = {"md": "markdown", "html": "html", "htm": "html", "json": "json", "jsonl": "jsonl"}


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, extension, content_hash, text: UTF-8, else Latin-1; searched in all folders below."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    as_is = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_is), as_is).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def file_pages(files: DataFrame) -> DataFrame:
    """text_files rows -> path, section, text; what has no sections is one page, trimmed."""
    paged = list(PAGED) + list(CODE)
    out = files.where(~F.col("extension").isin(paged)).select("path", F.lit(0).alias("section"), F.trim("text").alias("text"))
    for kind in sorted({*PAGED.values(), "code"}):
        own = [e for e, k in PAGED.items() if k == kind] if kind != "code" else list(CODE)
        mine = files.where(F.col("extension").isin(own))
        out = out.unionByName(sections(mine, kind, "path", "text").select("path", "section", "text"))
    return out


def checked_formats(files: DataFrame) -> DataFrame:
    """`files`; raises ValueError for an extension that none of the readers takes."""
    known = [*PAGED, *CODE, "txt", "csv", "docx", "xlsx"]
    if odd := [r.extension for r in files.where(~F.col("extension").isin(known)).select("extension").distinct().limit(10).collect()]:
        raise ValueError(f"unsupported: {', '.join(sorted(odd))}")
    return files


def number_like(cell: str) -> bool:
    """A number with thousands commas, currency or percent signs, or brackets for negative."""
    return bool(re.fullmatch(r"[(+-]*[$€£]?\s*(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*[kKmMbB%]?\)?", cell.strip()))


def date_like(cell: str) -> bool:
    return any(re.match(shape, cell.strip()) for shape, _ in DATES)


def sniff(lines: list[str], rows: list[list[str]] | None = None) -> tuple[str, int]:
    """Separator and header row of the first lines of a file (or of `rows`, cells of a sheet).

    The separator is what Python's own sniffer makes of the lines, a comma if it is at a loss. A header has three or more
    filled cells, at least half of its cells, and four fifths of them text of under 80 characters; the row after it must look
    like data: three or more cells, two fifths of them numbers or dates. Without one the first row is the header.
    """
    sep = ","
    if rows is None:
        try:
            sep = csv.Sniffer().sniff("\n".join(lines)[:8192], delimiters=",;\t|").delimiter
        except csv.Error:
            pass
        rows = list(csv.reader(io.StringIO("\n".join(lines[:30]), newline=""), delimiter=sep))[:30]

    def filled(row: list[str]) -> list[str]:
        return [c.strip() for c in row if c.strip() and c.strip().lower() != "nan"]

    def typed(cells: list[str]) -> int:
        return sum(number_like(c) or date_like(c) for c in cells)

    for i, row in enumerate(rows[:-1]):
        own, after = filled(row), filled(rows[i + 1])
        words = sum(not number_like(c) and not date_like(c) and len(c) < 80 for c in own)
        if len(own) >= 3 and len(own) >= 0.5 * len(row) and words >= 0.8 * len(own) and len(after) >= 3 and typed(after) >= 0.4 * len(after):
            return sep, i
    return sep, 0


#: Characters of a record of several lines at most: a quote that is never closed is an error, not a group of all that follows.
RECORD_CHARS = 1 << 24


def _line_codes(sep: str) -> Callable[[str], int]:
    """What a line does to the state of being inside a quoted field: 2 keeps it, 0 leaves it outside, 3 inside, 1 changes it."""
    other = f"[^{re.escape(sep)}\r]"
    field = f'(?:"[^"]*+(?:""[^"]*+)*+"(?:(?!"){other}*+)|(?!"){other}++)?'
    rest = f"(?:[{re.escape(sep)}\r]{field})*+"
    outside = re.compile(field + rest)
    closing, after = re.compile(r'[^"]*+(?:""[^"]*+)*+"(?!")'), re.compile(f"{other}*+{rest}")

    def code(line: str) -> int:
        if '"' not in line:
            return 2
        opened = outside.fullmatch(line) is None
        end = closing.match(line)
        stays = end is None or after.fullmatch(line, end.end()) is None
        return opened + 2 * stays

    return code


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """path, record (from 1 in each file), text of the records of separated files; a record may hold newlines inside quotes.

    Whether a line begins a record depends on all lines before it, so each line is reduced to what it does to the state
    (inside quotes or not), lines are combined by block of the file, and blocks by a running combination over the file's
    blocks, a row for each. Records of one line, nearly all, stay where they are; only lines of longer ones are shuffled.
    """
    classify = F.pandas_udf(lambda lines: lines.map(_line_codes(sep)).astype("int32"), "int")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), place.alias("line"), "value")
    lines = stored(raw.withColumn("code", classify("value")), "csv-lines")
    in_block = Window.partitionBy("path", "block").orderBy("line")
    in_file = Window.partitionBy("path").orderBy("block")  # a row for each block
    blocks = lines.groupBy("path", "block").agg(F.max_by(F.when(F.col("code").isin(0, 3), F.col("code")), F.when(F.col("code").isin(0, 3), F.col("line"))).alias("set"), F.max(F.when(F.col("code").isin(0, 3), F.col("line"))).alias("at"))
    swaps = lines.join(blocks.select("path", "block", "at"), ["path", "block"]).where((F.col("code") == 1) & (F.col("at").isNull() | (F.col("line") > F.col("at")))).groupBy("path", "block").agg(F.count("*").alias("swaps"))
    effect = blocks.join(swaps, ["path", "block"], "left").withColumn("swaps", F.coalesce("swaps", F.lit(0)) % 2)
    effect = effect.select("path", "block", F.when(F.col("set").isNull(), F.when(F.col("swaps") == 1, 1).otherwise(2)).when((F.col("set") == 3) != (F.col("swaps") == 1), 3).otherwise(0).alias("code"))
    entry = _with_state(effect, F.lit(0), in_file).select("path", "block", F.col("state").alias("entry"))
    placed = _with_state(lines.join(entry, ["path", "block"]), F.col("entry"), in_block)
    starts = placed.groupBy("path", "block").agg(F.sum((F.col("state") == 0).cast("long")).alias("n"))
    offsets = starts.select("path", "block", (F.sum("n").over(in_file) - F.col("n")).alias("offset"))
    counted = placed.join(offsets, ["path", "block"]).withColumn("record", F.col("offset") + F.sum((F.col("state") == 0).cast("long")).over(in_block))
    ends_outside = ~(F.when(F.col("state") == 0, F.col("code").isin(1, 3)).otherwise(F.col("code").isin(2, 3)))
    whole = (F.col("state") == 0) & ends_outside
    several = counted.where(~whole)
    longest = several.groupBy("path", "record").agg(F.sum(F.length("value") + 1).alias("chars")).agg(F.max("chars")).first()[0] or 0
    if longest > RECORD_CHARS:
        raise ValueError(f"a record of {longest} characters: a quote isn't closed")
    joined = several.groupBy("path", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    out = counted.where(whole).select("path", "record", F.col("value").alias("text")).unionByName(joined)
    return out.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _with_state(rows: DataFrame, entry: Column, window: Window) -> DataFrame:
    """`rows` (code) with the state before each row of a window: what the last row that sets it says, or the state on entry, and the changes since."""
    swap = (F.col("code") == 1).cast("int")
    upto, earlier = F.sum(swap).over(window.rowsBetween(Window.unboundedPreceding, 0)), window.rowsBetween(Window.unboundedPreceding, -1)
    # A set state less the changes so far: with the changes before a later row it is that row's state.
    marked = rows.withColumn("__level", F.when(F.col("code").isin(0, 3), (F.col("code") == 3).cast("int") - upto))
    level = F.coalesce(F.last("__level", ignorenulls=True).over(earlier), entry)
    return marked.withColumn("state", F.pmod(level + F.coalesce(F.sum(swap).over(earlier), F.lit(0)), F.lit(2)).cast("int")).drop("__level")


def cells(found: DataFrame, sep: str = ",") -> DataFrame:
    """records() -> path, record, part, cells: as Python's csv reads them. A bare carriage return ends a row too: `part` counts its rows."""

    def run(batches):
        for b in batches:
            rows = [(p, r, i, row) for p, r, t in zip(b["path"], b["record"], b["text"], strict=True) for i, row in enumerate(csv.reader(io.StringIO(t, newline=""), delimiter=sep)) if row]
            yield pd.DataFrame(rows, columns=["path", "record", "part", "cells"])

    return found.mapInPandas(run, "path string, record long, part int, cells array<string>")


def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """path, record, part, cells below the sniffed header, and the header's names. The first 30 lines and records come to the driver."""
    sep, _ = sniff([r.value for r in spark.read.text(path).limit(30).collect()])
    all_rows = cells(records(spark, path, sep), sep)
    head = [list(r["cells"]) for r in all_rows.where(F.col("record") <= 30).orderBy("path", "record", "part").limit(30).collect()]
    if not head:
        return all_rows, []
    at = sniff([], head)[1]
    first = all_rows.orderBy("path", "record", "part").limit(at + 1).collect()[-1]
    names = [n.strip() or f"column_{i + 1}" for i, n in enumerate(head[at])]
    return all_rows.where((F.col("record") > first.record) | ((F.col("record") == first.record) & (F.col("part") > first.part))), names


def named_cells(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """`keep` and a text column for each name, null where a row is short; rows that repeat the header go."""
    each = [F.trim(F.coalesce(F.get("cells", i), F.lit(""))) for i in range(len(names))]
    same = sum((F.when((F.lower(c) == n.lower()) & (c != ""), 1).otherwise(0) for c, n in zip(each, names, strict=True)), F.lit(0))
    filled = sum((F.when(c != "", 1).otherwise(0) for c in each), F.lit(0))
    kept = rows.where(~((filled >= 3) & (same >= 0.6 * filled)))
    unique, seen = [], set()
    for n in names:
        while n in seen:
            n += "_2"
        seen.add(n)
        unique.append(n)
    return kept.select(*keep, *(F.nullif(F.get("cells", i), F.lit("")).alias(n) for i, n in enumerate(unique)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text under the sniffed header's names; rows above the header and rows that repeat it go."""
    rows, names = read_rows(spark, path)
    return named_cells(rows, names, []) if names else spark.createDataFrame([], "value string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """read_csv() with __row_number, in the order of files and records."""
    rows, names = read_rows(spark, path)
    return numbered(named_cells(rows, names, ["path", "record", "part"]), ["path", "record", "part"]).drop("path", "record", "part")


def csv_metadata(spark: SparkSession, path: str) -> dict:
    """What the lines above the header say. Only the first 30 lines come to the driver."""
    head = [r.value for r in spark.read.text(path).limit(30).collect()]
    sep, at = sniff(head)
    return preamble([next(csv.reader([line], delimiter=sep), []) for line in head[:at]])


def csv_prose(spark: SparkSession, path: str, per_page: int = 50) -> DataFrame:
    """page, text: `a | b` lines, so many rows a page; the header and a rule on the first page. A page is gathered by its number, so none holds more than its rows."""
    rows = read_table(spark, path)
    columns = [c for c in rows.columns if c != ROW]
    head = " | ".join(columns)
    lines = rows.select(ROW, F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`"), F.lit("nan")) for c in columns)).alias("line"))
    paged = lines.groupBy((F.floor((F.col(ROW) - 1) / per_page) + 1).cast("int").alias("page")).agg(F.array_join(F.sort_array(F.collect_list(F.struct(ROW, "line"))).getField("line"), "\n").alias("text"))
    return paged.select("page", F.when(F.col("page") == 1, F.concat(F.lit(f"{head}\n{'-' * len(head)}\n"), "text")).otherwise(F.col("text")).alias("text"))


def export_bundle(tables: dict[str, DataFrame], path: str, name: str, signature: str | None = None, key: str = "document_id") -> None:
    """Tables as Parquet folders and a manifest with the signature of the vectors' model; quarantined documents stay behind in every table."""
    spark = next(iter(tables.values())).sparkSession
    hidden = None
    for frame in tables.values():
        if "policy_status" in frame.columns and key in frame.columns:
            own = frame.where(F.col("policy_status") == "quarantined").select(key)
            hidden = own if hidden is None else hidden.unionByName(own)
    for table, frame in tables.items():
        kept = frame.where(F.coalesce("policy_status", F.lit("clear")) != "quarantined") if "policy_status" in frame.columns else frame
        if hidden is not None and key in frame.columns:
            kept = kept.join(hidden.distinct(), key, "left_anti").select(*frame.columns)
        kept.write.mode("overwrite").parquet(f"{path}/{table}")
    manifest = json.dumps({"name": name, "tables": sorted(tables), "signature": signature})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, blocked: DataFrame | None = None, signature: str | None = None, key: str = "document_id") -> dict[str, DataFrame]:
    """The tables of a bundle; documents whose content_hash is blocked stay out of every table. Vectors come along only if both
    sides' models have the same signature; postings never do, as they are built anew."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    names = [t for t in manifest["tables"] if t not in ("postings", "sizes") and (t != "vectors" or (signature is not None and manifest.get("signature") == signature))]
    out = {t: spark.read.parquet(f"{path}/{t}") for t in names}
    if blocked is not None:
        bad = [f.join(blocked.select("content_hash"), "content_hash", "left_semi").select(key) for f in out.values() if {"content_hash", key} <= set(f.columns)]
        for t, f in out.items():
            kept = f.join(blocked.select("content_hash"), "content_hash", "left_anti").select(*f.columns) if "content_hash" in f.columns else f
            for ids in bad:
                kept = kept.join(ids.distinct(), key, "left_anti").select(*f.columns) if key in f.columns else kept
            out[t] = kept
    return out
