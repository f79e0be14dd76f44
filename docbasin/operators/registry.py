"""The registry of typed tables: row numbers, registration, listing, lookup by any identifier, suggestions, rows, inlining."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbasin.operators.tables import MAX_ROWS, known
from docbasin.session import stored

ROW = "__row_number"
FIELDS = "document_id string, sheet_name string, filename string, table_name string, row_count long, columns string"


def numbered(table: DataFrame, order: list[str] | None = None) -> DataFrame:
    """`table` with __row_number from 1: by `order` (unique), else as its partitions come.

    The ranges are written once, so each row has one partition and one place in it, however often the table is read; a
    partition's rows are numbered after those of the partitions before. No task holds the whole table.
    """
    if order:
        table = table.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(table.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # a row for each partition
    own = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)
    return placed.join(F.broadcast(offsets), "__part").withColumn(ROW, (own + F.col("__before") + 1).cast("long")).drop("__part", "__id", "__before")


def samples(table: DataFrame, rows: int = 5, chars: int = 100) -> DataFrame:
    """column, samples: texts of the first `rows` rows that aren't blank, cut to `chars`."""
    columns = [c for c in table.columns if c != ROW and not c.endswith("__raw")]
    cells = table.where(F.col(ROW) <= rows).select(ROW, F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("cell")) for i, c in enumerate(columns)))).alias("x")).select(ROW, "x.*")
    shown = F.sort_array(F.collect_list(F.when(F.col("cell") != "", F.struct(ROW, F.substr("cell", F.lit(1), F.lit(chars)).alias("cell")))))
    return cells.groupBy("at", "column").agg(shown.getField("cell").alias("samples")).orderBy("at").select("column", "samples")


def entry(table: DataFrame, document_id: str, filename: str, sheet_name: str | None, table_name: str) -> DataFrame:
    """The registry's row for a table: its size and columns (JSON of names and types)."""
    columns = json.dumps([{"name": c, "type": t} for c, t in table.dtypes if c != ROW])
    values = [F.lit(document_id), F.lit(sheet_name).cast("string"), F.lit(filename), F.lit(table_name)]
    names = ["document_id", "sheet_name", "filename", "table_name"]
    return table.agg(F.count("*").alias("row_count")).select(*(v.alias(n) for v, n in zip(values, names, strict=True)), "row_count", F.lit(columns).alias("columns"))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """`registry` with `new` in the place of the same document's same sheet."""
    same = (registry["document_id"] == new["document_id"]) & registry["sheet_name"].eqNullSafe(new["sheet_name"])
    return registry.join(new, same, "left_anti").unionByName(new)


def drop(registry: DataFrame, document_id: str) -> DataFrame:
    return registry.where(F.col("document_id") != document_id)


def listed(registry: DataFrame) -> DataFrame:
    return registry.orderBy("filename", "sheet_name")


def resolve(registry: DataFrame, identifier: str, only: list[str] | None = None) -> DataFrame:
    """The table that a table name, file name or document id stands for: the first by sheet; `only` restricts documents."""
    mine = registry if only is None else registry.where(F.col("document_id").isin(only) if only else F.lit(False))
    return mine.where((F.col("table_name") == identifier) | (F.col("filename") == identifier) | (F.col("document_id") == identifier)).orderBy("sheet_name", "table_name").limit(1)


def plain(name: Column) -> Column:
    """Lower case, without quotes, a table file's extension, and separators."""
    s = F.lower(F.regexp_replace(F.trim(name), r"^[\"']+|[\"']+$", ""))
    return F.regexp_replace(F.regexp_replace(s, r"\.(csv|xlsx|xls)$", ""), r"[-_\s.]+", "")


def suggest(registry: DataFrame, identifier: str, limit: int = 3) -> DataFrame:
    """table_name, filename, document_id of tables with a name that equals the guess, holds it, or is in it; the longest overlap first."""
    guess = plain(F.lit(identifier))

    def score(name: str) -> Column:
        own = plain(F.col(name))
        inside = F.contains(own, guess) | F.contains(guess, own)
        return F.when((own == "") | (guess == "") | own.isNull(), 0).when(own == guess, 10_000).when(inside, F.least(F.length(own), F.length(guess))).otherwise(0)

    best = F.greatest(*(score(c) for c in ("table_name", "filename", "document_id")))
    return registry.withColumn("score", best).where("score > 0").orderBy(F.desc("score"), "filename", "sheet_name").limit(limit).select("table_name", "filename", "document_id", "score")


def rows(table: DataFrame, names: dict[str, str] | None = None, limit: int = 200) -> DataFrame:
    """The first rows in source order (1 to 2000), under the source's own column names where given."""
    first = table.where(F.col(ROW) <= min(max(limit, 1), MAX_ROWS)).orderBy(ROW)
    return first.select(*(F.col(f"`{c}`").alias((names or {}).get(c, c)) for c in table.columns if c != ROW and not c.endswith("__raw")))


TABULAR = ("csv", "tsv", "xlsx", "xls")


def as_json(table: DataFrame, filename: str, rows: int = 150) -> DataFrame:
    """json: a table's rows in source order as one text, without raw companions; no row if it has more than `rows` or its file is no table's."""
    columns = [c for c in table.columns if c != ROW and not c.endswith("__raw")]
    if filename.rsplit(".", 1)[-1].lower() not in TABULAR:
        return table.sparkSession.createDataFrame([], "json string")
    first = table.where(F.col(ROW) <= rows + 1)  # so many at most are gathered
    held = first.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(ROW, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row")))).alias("all"))
    return held.where(F.col("n") <= rows).select(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["row"]), ","), F.lit("]")).alias("json"))


def inlined(registry: DataFrame, texts: DataFrame, rows: int = 150, budget: int = 60_000) -> DataFrame:
    """registry and texts (table_name, json) -> table_name, chars, used of small tables whose texts fit the budget, in listing order."""
    small = registry.where(F.col("row_count") <= rows).join(texts, "table_name").withColumn("chars", F.length("json"))
    w = Window.partitionBy(F.lit(0)).orderBy("filename", "sheet_name", "table_name").rowsBetween(Window.unboundedPreceding, 0)  # a row for each small table
    return small.withColumn("used", F.sum("chars").over(w)).where(F.col("used") <= budget).select("table_name", "chars", "used")


def rolled_lots(lots: DataFrame, marker: str, name: str) -> DataFrame:
    """Lots without the rows that sum up others: those without a lot marker, and footers that begin with TOTAL."""
    footer = F.upper(F.trim(F.coalesce(F.col(name), F.lit("")))).startswith("TOTAL")
    return lots.where(known(F.col(marker)).isNotNull() & ~footer)
