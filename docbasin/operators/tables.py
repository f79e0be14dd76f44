"""Typed tables: inference, coercion, profiles, aggregation, roll-ups, guarded SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbasin.functions.text import nearest_rank

# Cell texts that mean no value; words a query must not hold; shapes of dates.
NULL_MARKERS = ["", "--", "-", "n/a", "na", "nan", "null", "none", "nil", "—", "–", "n.a.", "n.a", "#n/a", "#na", "#null", "#value!", "#ref!", "#div/0!", "provide", "missing", "unknown", "tbd", "tba", "undefined"]
FORBIDDEN = "insert update delete drop alter create attach detach pragma vacuum reindex truncate grant revoke begin commit rollback savepoint".split()
DATES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}(\s+\d{1,2}:\d{2}(:\d{2})?)?$", ["yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d"]),
    (r"^\d{1,2}/\d{1,2}/\d{2,4}$", ["M/d/yyyy", "M/d/yy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$", ["d-MMM-yyyy", "d-MMM-yy"]),
    (r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$", ["MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy"]),
]
FUNCTIONS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
MAX_ROWS = 2000
# Spark's names. Nodes that a parsed query may hold, those it may hold once it is analysed, what the parser
# leaves open in expressions, and the groups of functions that only look at their arguments.
PARSED = set("""Project Filter Aggregate Sort Distinct GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases
UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation Union Intersect Except Generate UnresolvedWith WithWindowDefinition UnresolvedHaving
Pivot Unpivot Sample UnresolvedTableValuedFunction UnresolvedTVFAliases UnionLoop""".split())
ANALYSED = set("""Project Filter Aggregate Sort Distinct GlobalLimit LocalLimit Offset Join LateralJoin SubqueryAlias View OneRowRelation LocalRelation
Union Intersect Except Generate WithCTE CTERelationDef CTERelationRef Window Expand Sample Range UnionLoop UnionLoopRef""".split())
OPEN = set("""UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias MultiAlias UnresolvedNamedLambdaVariable
UnresolvedExtractValue UnresolvedOrdinal UnresolvedGenerator UnresolvedWindowExpression UnresolvedSubqueryColumnAliases ResolvedStar""".split())
GROUPS = set("""agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs
lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs window_funcs""".split())
#: Expressions that run code of others.
FOREIGN = {"ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPythonUDTF", "CallMethodViaReflection", "TryReflect", "ApplyFunctionExpression", "V2Aggregator"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: Functions whose result is as long as an argument says, by class: the place of that argument.
SIZED = {"ArrayRepeat": 1, "StringRepeat": 1, "StringSpace": 0, "StringLPad": 1, "StringRPad": 1}
#: Rows or elements that a query may make out of nothing.
MADE = 1_000_000
#: Ranges of values that a column's profile is dealt by.
RANGES = 200


def known(cell: Column) -> Column:
    """The trimmed cell, null if it says that there is no value."""
    t = F.trim(cell.cast("string"))
    return F.when(~F.lower(t).isin(NULL_MARKERS), t)


def number(cell: Column) -> Column:
    """Thousands commas, brackets for negative, K, M or B for factors; null for what is no finite number."""
    t = F.regexp_replace(known(cell), ",", "")
    t = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(t, r"[()]", ""))).otherwise(t)
    factor = F.when(t.rlike(r"(?i)^-?\d*\.?\d+\s*k$"), 1e3).when(t.rlike(r"(?i)^-?\d*\.?\d+\s*m$"), 1e6).when(t.rlike(r"(?i)^-?\d*\.?\d+\s*b$"), 1e9).otherwise(1.0)
    digits = F.regexp_replace(t, r"(?i)\s*[kmb]$", "")
    plain = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits)
    return plain.try_cast("double") * factor


def date(cell: Column) -> Column:
    """ISO text, with a time only where the source had one; null for what is no date. A cell is parsed by its shape's formats only."""
    t = known(cell)
    parsed = F.lit(None).cast("timestamp")
    for shape, formats in reversed(DATES):
        parsed = F.when(t.rlike(shape), F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))).otherwise(parsed)
    return F.when(t.rlike(r"\d:\d"), F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(parsed, "yyyy-MM-dd"))


@dataclass(frozen=True)
class TypeExtension:
    """A column type of a deployment's own: `detect` and `coerce` take a series of trimmed texts (no nulls) and give booleans,
    and values of the storage type (double or string) or None. A column has the type if four fifths of its values are detected.
    """

    name: str
    storage: str
    detect: Callable[[pd.Series], pd.Series]
    coerce: Callable[[pd.Series], pd.Series]

    def found(self, cell: Column) -> Column:
        """Whether each cell is one of this type; cells that aren't known are not."""
        return F.pandas_udf(_over_known(self.detect, False), "boolean")(known(cell))

    def value(self, cell: Column) -> Column:
        return F.pandas_udf(_over_known(self.coerce, None), self.storage)(known(cell))


def _over_known(fn: Callable[[pd.Series], pd.Series], missing):
    """`fn` over a series' values that aren't null, each different one once; the others are `missing`."""

    def run(cells: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(cells)  # null: -1, the last of what is looked up
        own = [None if v is None or v != v else v for v in fn(pd.Series(texts, dtype=cells.dtype))] if len(texts) else []
        looked_up = np.empty(len(own) + 1, object)
        looked_up[:] = [*own, missing]
        return pd.Series(looked_up[codes], index=cells.index, dtype=object)

    return run


def infer_types(table: DataFrame, extensions: Sequence[TypeExtension] = ()) -> DataFrame:
    """column, n, type: boolean, date, an extension's name, integer, real or text, one row a column, by one aggregation over all rows.

    Boolean needs all known cells and at most three spellings, the others four fifths, in this order. A cell counts as a
    number if it is one or if an extension of numbers makes it one; a column with such cells is real even if they are whole.
    """
    value_of = {c: number(F.col(f"`{c}`")) for c in table.columns}
    aggregates, first = [], table
    if extensions:  # Python sees each cell once
        more = {}
        for i, c in enumerate(table.columns):
            for j, e in enumerate(extensions):
                more[f"__is_{i}_{j}"], more[f"__as_{i}_{j}"] = e.found(F.col(f"`{c}`")), e.value(F.col(f"`{c}`"))
        first = table.withColumns(more)
    for i, c in enumerate(table.columns):
        cell, value = F.lower(known(F.col(f"`{c}`"))), value_of[c]
        truth = cell.isin("true", "false", "yes", "no", "y", "n")
        numeric = [F.col(f"__as_{i}_{j}") for j, e in enumerate(extensions) if e.storage == "double"]
        made = F.coalesce(*numeric) if numeric else F.lit(None).cast("double")
        counts = {
            "n": F.count(cell), "bools": F.count_if(truth), "spellings": F.size(F.collect_set(F.when(truth, cell))), "dates": F.count_if(date(F.col(f"`{c}`")).isNotNull()),
            "numbers": F.count_if(F.coalesce(value, made).isNotNull()), "wholes": F.count_if(F.coalesce(value, made) == F.floor(F.coalesce(value, made))), "helped": F.count_if(value.isNull() & made.isNotNull()),
        }
        own = [F.struct(F.count_if(f"__is_{i}_{j}").alias("is"), F.count(f"__as_{i}_{j}").alias("as")) for j in range(len(extensions))]
        aggregates.append(F.struct(F.lit(c).alias("column"), *(a.cast("long").alias(k) for k, a in counts.items()), *([F.array(*own).alias("own")] if own else [])).alias(f"__{i}"))
    seen = first.agg(*aggregates).select(F.explode(F.array(*(F.col(f"__{i}") for i in range(len(table.columns))))).alias("x")).select("x.*")
    most = 0.8 * F.col("n")
    kind = F.when(F.col("n") == 0, "text").when((F.col("bools") == F.col("n")) & (F.col("spellings") <= 3), "boolean").when(F.col("dates") >= most, "date")
    for j, e in enumerate(extensions):
        kind = kind.when((F.get("own", j)["is"] >= most) & (F.get("own", j)["as"] > 0), e.name)
    kind = kind.when((F.col("numbers") >= most) & (F.col("wholes") == F.col("numbers")) & (F.col("helped") == 0), "integer").when(F.col("numbers") >= most, "real").otherwise("text")
    return seen.select("column", "n", kind.alias("type"))


def roles(types: DataFrame, detectors: Sequence[Callable[[str, str], str | None]]) -> DataFrame:
    """column, type of a table -> with role: what the first detector says that says anything, else null. A row for each column comes to the driver."""
    rows = [(r.column, r.type, next((role for d in detectors if (role := d(r.column, r.type))), None)) for r in types.select("column", "type").collect()]
    return types.join(types.sparkSession.createDataFrame(rows, "column string, type string, role string"), ["column", "type"])


def coerce(table: DataFrame, types: dict[str, str], raw: bool = True, extensions: Sequence[TypeExtension] = ()) -> DataFrame:
    """Typed columns under safe names, each with its source text as <name>__raw where the type may lose it.

    Integers are cut towards zero; whole numbers beyond what a double holds exactly are read as they are written. In a real
    column a cell that is no plain number is what the first extension of numbers makes of it.
    """
    out, used, own = [], set(), {e.name: e for e in extensions}
    for c in table.columns:
        name, n = safe_name(c), 2
        while name.lower() in used:
            name, n = f"{safe_name(c)}_{n}", n + 1
        used.add(name.lower())
        cell, kind = F.col(f"`{c}`"), types.get(c, "text")
        plain = F.regexp_replace(known(cell), ",", "")
        whole = F.coalesce(F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long")), number(cell).try_cast("long"))
        real = F.coalesce(number(cell), *(e.value(cell) for e in extensions if e.storage == "double")) if kind == "real" else None
        typed = {"integer": whole, "real": real, "date": date(cell), "boolean": F.lower(known(cell)).isin("true", "yes", "y", "1")}.get(kind)
        typed = own[kind].value(cell) if kind in own else typed if typed is not None else known(cell)
        out.append(typed.alias(name))
        if raw and (kind in ("integer", "real", "date") or kind in own):
            out.append(known(cell).alias(f"{name}__raw"))
    return table.select(*out)


def safe_name(name: str) -> str:
    s = re.sub(r"[^A-Za-z0-9_]", "_", name.strip()).strip("_") or "column"
    return (f"_{s}" if s[0].isdigit() else s)[:60]


def aggregate(table: DataFrame, column: str, fn: str, by: str | None = None, sort: str | None = None, limit: int = MAX_ROWS) -> DataFrame:
    """fn of a column, for each value of `by` if given; sort: value or group, _asc or _desc."""
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {fn!r}")
    out = (table.groupBy(by) if by else table).agg(FUNCTIONS[fn](column).alias("result"))
    if sort:
        field = "result" if sort.startswith("value") else by
        out = out.orderBy(F.desc(field) if sort.endswith("desc") else F.asc(field), *([by] if by else []))
    return out.limit(min(max(limit, 1), MAX_ROWS))


def profile(table: DataFrame, columns: list[str], scale: int | None = None) -> DataFrame:
    """column, nulls, distinct, min, max, mean, total, p25, p50, p75 (nearest rank, ties to even) of numeric columns.

    Percentiles are exact. The distinct values with their counts stay rows, dealt by ranges of values; a value's place is
    its running count in its range plus the counts of the ranges before. The cut points come to the driver (at most
    RANGES a column); they need only be about even, but the same for all who deal by them. With `scale`, sums and means
    are of decimals with so many places, the mean to six, so they don't depend on the order of rows.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))  # noqa: E731 NaN counts as no value
    cells = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    counted = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    added = F.sum((F.col("v") if scale is None else F.col("v").cast(f"decimal(18,{scale})")) * F.col("n"))
    mean = added / total if scale is None else added.cast(f"decimal(38,{scale})") / total
    figures = counted.groupBy("column").agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), mean.cast("double").alias("mean"), added.cast("double").alias("total"), total.alias("all"))
    known_values = counted.where("v is not null")
    cuts = known_values.groupBy("column").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)]).alias("cuts")).collect()
    cut = table.sparkSession.createDataFrame([(r["column"], sorted(set(r.cuts))) for r in cuts], "column string, cuts array<double>")
    dealt = known_values.join(F.broadcast(cut), "column").select("column", "v", "n", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    sums = dealt.groupBy("column", "part").agg(F.sum("n").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(Window.partitionBy("column").orderBy("part")) - F.col("held")).select("column", "part", "before")
    running = F.sum("n").over(Window.partitionBy("column", "part").orderBy("v"))
    ends = dealt.withColumn("running", running).join(F.broadcast(before), ["column", "part"]).join(F.broadcast(figures.select("column", "all")), "column").withColumn("end", F.col("running") + F.col("before"))  # a row for each part and column, and for each column

    def at(percent: int) -> Column:
        rank = F.bround(F.lit(percent / 100.0) * (F.col("all") - 1), 0)
        return F.max(F.when((F.col("end") > rank) & (F.col("end") - F.col("n") <= rank), F.col("v")))

    ranks = ends.groupBy("column").agg(*(at(p).alias(f"p{p}") for p in (25, 50, 75)))
    return figures.join(F.broadcast(ranks), "column", "left").select("column", "nulls", "distinct", "min", "max", "mean", "total", "p25", "p50", "p75")


def first_values(table: DataFrame, columns: list[str], place: str, most: int = 2000, block: int = 10_000) -> DataFrame:
    """column, v, k of the first `most` values of each column that aren't null, k from 1, in the order of `place` (1, 2, 3, ...).

    Values are counted by blocks of places; a running sum over the blocks (a row for each) says in which a column's first
    values lie, and only those blocks' values are numbered, fewer than `most` + `block` a column.
    """
    cells = table.select(place, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("x")).select(place, "x.*").where("v is not null")
    at = F.floor((F.col(place) - 1) / block).alias("block")
    held = cells.groupBy("column", at).agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("column").orderBy("block")) - F.col("n")).where(F.col("before") < most)
    near = cells.select(place, "column", "v", at).join(F.broadcast(before.select("column", "block")), ["column", "block"])  # `most` blocks a column at most
    return near.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(place))).where(F.col("k") <= most).select("column", "v", "k")


def column_profile(table: DataFrame, columns: list[str], place: str, most: int = 2000) -> DataFrame:
    """column, nulls (of all rows), distinct, n, min, max, mean, total, p25, p50, p75 of the first `most` values; numeric columns.

    NaN counts as no value. Percentiles are by nearest rank, ties to even.
    """
    typed = table.select(place, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    nulls = typed.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns))).alias("x")).select("x.*")
    v = F.col("v").cast("double")
    values = F.collect_list(v)  # `most` at most
    seen = first_values(typed, columns, place, most).groupBy("column").agg(F.count_distinct(v).alias("distinct"), F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v.cast("decimal(28,6)")).cast("double").alias("mean"), F.sum(v.cast("decimal(28,6)")).cast("double").alias("total"), *(nearest_rank(values, p).alias(f"p{p}") for p in (25, 50, 75)))
    return nulls.join(seen, "column", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("distinct", "n")})


def roll_up(lots: DataFrame, keys: list[str], sums: list[str], labels: list[str]) -> DataFrame:
    """One row for each holding: key = the first of `keys` that isn't blank; sums, greatest labels, lots, unit cost."""
    key = F.coalesce(*(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys)).alias("key")
    out = lots.where("quantity is not null").groupBy(key).agg(*(F.sum(s).alias(s) for s in sums), *(F.max(c).alias(c) for c in labels), F.count("*").alias("lot_count"))
    return out.withColumn("unit_cost", F.try_divide(F.col("cost"), F.nullif("quantity", F.lit(0.0))))


def checked(sql: str) -> str:
    """One SELECT or WITH without forbidden words outside literals; raises ValueError otherwise."""
    sql = sql.strip()
    while sql.endswith(";"):
        sql = sql[:-1].rstrip()
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", " ", sql)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.S)
    words = re.findall(r"[a-z_]+", bare.lower())
    if not words or words[0] not in ("select", "with"):
        raise ValueError("only SELECT and WITH are allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    if bad := sorted(set(words) & set(FORBIDDEN)):
        raise ValueError(f"forbidden: {', '.join(bad)}")
    return sql


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Guard:
    """Walks plans, subqueries too, and raises ValueError for all that isn't on the lists above."""

    def __init__(self, spark: SparkSession, views: list[str]):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.builtin = self.jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.views = {v.lower() for v in views}

    def is_plan(self, e) -> bool:
        return is_instance_of(self.gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def function(self, parts: list[str]) -> None:
        """A function must be Spark's own, under its plain name, of a group that only looks at its arguments."""
        name = parts[-1].lower()
        known = self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        own, here = self.builtin.lookupFunction(known), self.registry.lookupFunction(known)
        if len(parts) != 1 or own.isEmpty() or own.get().getGroup() not in GROUPS:
            raise ValueError(f"function {'.'.join(parts)} is not allowed")
        if here.isEmpty() or here.get().getClassName() != own.get().getClassName():
            raise ValueError(f"function {name} has been replaced")

    def parsed(self, p, scope: set[str] | None = None) -> None:
        """The parser's plan: it reads the given views and its own WITH names, and nothing else."""
        scope = self.views if scope is None else scope
        kind = p.getClass().getSimpleName()
        if kind not in PARSED:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _each(p.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in scope:
                raise ValueError(f"unknown table {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            parts = [str(x) for x in _each(p.name())]
            if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                raise ValueError(f"table function {'.'.join(parts)} is not allowed")
        elif kind == "UnresolvedWith":
            inner = set(scope)
            for relation in _each(p.cteRelations()):
                name = str(relation._1()).lower()
                self.parsed(relation._2(), inner | {name} if p.allowRecursion() else inner)
                inner.add(name)
            scope = inner
        for e in _each(p.expressions()):
            self.parsed_expression(e, scope)
        for child in _each(p.children()):
            self.parsed(child, scope)

    def parsed_expression(self, e, scope: set[str]) -> None:
        where, kind = e.getClass().getName(), e.getClass().getSimpleName()
        if kind not in OPEN and not where.startswith("org.apache.spark.sql.catalyst.expressions.") or kind in FOREIGN:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind == "UnresolvedFunction":
            self.function([str(x) for x in _each(e.nameParts())])
        elif kind == "UnresolvedGenerator":
            self.function([str(e.name().funcName())])
        if self.is_plan(e):
            self.parsed(e.plan(), scope)
        for child in _each(e.children()):
            self.parsed_expression(child, scope)

    def analysed(self, p) -> None:
        """The analysed plan: its leaves are the given views, values of the query, and ranges of bounded size."""
        kind = p.getClass().getSimpleName()
        if kind not in ANALYSED:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind == "View":
            name = p.desc().identifier()
            if not p.isTempView() or name.table().lower() not in self.views:
                raise ValueError(f"unknown table {name.table()}")
            return  # what a view itself reads is its owner's
        if kind == "Range" and int(str(p.numElements())) > MADE:
            raise ValueError(f"a range of more than {MADE} rows")
        for e in _each(p.expressions()):
            self.analysed_expression(e)
        for child in [*_each(p.children()), *_each(p.innerChildren())]:
            if is_instance_of(self.gateway, child, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
                self.analysed(child)

    def analysed_expression(self, e) -> None:
        kind = e.getClass().getSimpleName()
        if not e.getClass().getName().startswith("org.apache.spark.sql.catalyst.") or kind in FOREIGN:
            raise ValueError(f"not allowed in a query: {kind}")
        if kind in SIZED or kind == "Sequence":
            self.bounded(e, kind)
        if self.is_plan(e):
            self.analysed(e.plan())
        for child in _each(e.children()):
            self.analysed_expression(child)

    def bounded(self, e, kind: str) -> None:
        """Sizes must be constants of at most MADE; a sequence may be of whole numbers or dates."""
        children = _each(e.children())
        sized = children[:3] if kind == "Sequence" else [children[SIZED[kind]]]
        if not all(c.foldable() for c in sized):
            raise ValueError(f"the size of {kind} is no constant")
        values = [c.eval(None) for c in sized]
        if any(v is None for v in values):
            return
        if kind != "Sequence":
            n = int(str(values[0]))
        elif children[0].dataType().simpleString() in ("tinyint", "smallint", "int", "bigint", "date"):
            whole = len(values) == 3 and not hasattr(values[2], "getClass")
            step = abs(int(values[2])) if whole else 1  # a step of days or months is one at least
            n = abs(int(values[1]) - int(values[0])) // max(step, 1) + 1
        else:
            raise ValueError("a sequence of timestamps")
        if n > MADE:
            raise ValueError(f"{kind} of more than {MADE} elements")


def _own_session(spark: SparkSession, views: dict[str, DataFrame]) -> SparkSession:
    """A session with the caller's settings in which the views, and no other thread's, are known by their names."""
    cloned = spark._jsparkSession.cloneSession()
    datasets = getattr(spark._jvm.org.apache.spark.sql.classic, "Dataset$").__getattr__("MODULE$")
    for name, frame in views.items():
        datasets.ofRows(cloned, frame._jdf.queryExecution().logical()).createOrReplaceTempView(name)
    return SparkSession(spark.sparkContext, cloned)


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int | None = 500) -> DataFrame:
    """A guarded query over the given views only; at most max_rows + 1 rows, the last of which says that there are more; all rows with None.

    Both the parser's plan and the analysed one are held against lists of what is allowed. The views are those of a session
    of the query's own, so threads don't see each other's, and the caller's views stay.
    """
    text, guard = checked(sql), _Guard(spark, list(views))
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"not a query: {str(e).splitlines()[0]}") from e
    guard.parsed(parsed)
    found = _own_session(spark, views).sql(text)
    guard.analysed(found._jdf.queryExecution().analyzed())
    return found if max_rows is None else found.limit(min(max_rows, MAX_ROWS) + 1)


def result(spark: SparkSession, sql: str, views: dict[str, DataFrame], max_rows: int = 500) -> dict:
    """columns, rows, row_count, truncated: at most max_rows rows (2000 at most), truncated if there is one more."""
    most = min(max(max_rows, 1), MAX_ROWS)
    found = query(spark, sql, views, most)
    taken = [tuple(r) for r in found.collect()]  # most + 1 at most
    return {"columns": found.columns, "rows": taken[:most], "row_count": min(len(taken), most), "truncated": len(taken) > most}
