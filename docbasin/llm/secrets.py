r"""Secrets in text by plain patterns and a battery of randomness tests, in DataFrame functions only.

Plain patterns give the base spans: assigned values, access keys, long hexadecimal runs. Between these, runs of 20 or more
characters of `[A-Za-z0-9+/_=-]` are tested. A token's encoding is the smallest alphabet that holds all its characters; tests
are of its letters (trailing = apart), in the alphabet's order:

* chi-squared of the letters' counts against the uniform distribution over the alphabet;
* runs above and below the middle of the alphabet (Wald and Wolfowitz);
* serial correlation of neighbouring letters (cyclic, lag 1).

A random token passes all three: each may reject at one in a thousand only. To pass by chance, a token of ordinary letters
would need a small chi-squared: under the distribution of ordinary text the statistic is about normal with mean
k - 1 + n d and variance 2 (k - 1) + 4 n d, d = k * (chance that two ordinary letters are equal) - 1. The lower tail is the
token's p-value. It falls with the length, and tokens are compared among those of their encoding and length (powers of
two): Benjamini and Hochberg's procedure in each such class keeps the false-discovery rate at RATE. P-values are rounded up
to hundredths of a decade, so the procedure needs only counts by class and step; distinct tokens count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbasin.llm.common import read, stored

KINDS = ["assign", "access", "hex", "random"]
_KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: What the tests leave alone: any base span.
BASE = f"{ASSIGN.replace('([A', '[A').replace('-]+)', '-]+')}|{ACCESS}|{HEX}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Name, alphabet in its order, pattern of its letters, chance that two letters of ordinary text in it are equal (decimal digits; words).
ENCODINGS = [
    ("hex", _DIGITS + "abcdef", "0-9a-f", 0.1),
    ("upper hex", _DIGITS + "ABCDEF", "0-9A-F", 0.1),
    ("base32", _UPPER + "234567", "A-Z2-7", 0.065),
    ("base36", _DIGITS + _LOWER, "0-9a-z", 0.065),
    ("base62", _UPPER + _LOWER + _DIGITS, "A-Za-z0-9", 0.065),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", "A-Za-z0-9+/", 0.065),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", "A-Za-z0-9_-", 0.065),
]
#: The false-discovery rate; standard scores of one in a thousand, one-sided and two-sided.
RATE, ONE_SIDED, TWO_SIDED = 0.01, 3.0902, 3.2905
#: Steps of p-values a decade, and the last step.
STEPS, LAST = 100, 3000
#: Places that are summed at once in a running sum.
CHUNK = 256
ROW = "row number of the scan"
# Coefficients of the normal distribution's tail (Abramowitz and Stegun 26.2.17).
_TAIL = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def _each(n: Column, f: Callable[[Column], Column]) -> Column:
    """f(0), ..., f(n - 1); an empty array for 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array())


def _before(sizes: Column) -> Column:
    """The sums of all values before each, in steps of CHUNK values."""
    chunks = F.ceil(F.size(sizes) / CHUNK).cast("int")
    sums = _each(chunks, lambda c: _sum(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))

    def dealt(sums: Column) -> Column:
        bases = _each(F.size(sums), lambda c: _sum(F.slice(sums, F.lit(1), c)))
        within = lambda c, base: _each(F.least(F.lit(CHUNK), F.size(sizes) - c * CHUNK), lambda i: base + _sum(F.slice(sizes, c * CHUNK + 1, i)))
        return F.flatten(F.transform(bases, lambda base, c: within(c, base)))

    return _let(sums, dealt)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<at, size, hit>>: where each match begins (from 0), its length, and its text or that of its group.

    The text between matches comes from the same matcher, so a match begins after all pieces and matches before it.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    hits = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    none = F.array().cast("array<struct<at:bigint,size:bigint,hit:string>>")

    def placed(m: Column) -> Column:
        sizes = F.transform(m.whole, lambda w, i: F.char_length(F.get(m.gaps, i)).cast("long") + F.char_length(w))
        return _let(F.struct(_let(sizes, _before).alias("before"), m.gaps.alias("gaps"), m.whole.alias("whole"), m.hits.alias("hits")), lambda k: F.transform(k.whole, lambda w, i: F.struct((F.get(k.before, i) + F.char_length(F.get(k.gaps, i))).alias("at"), F.char_length(w).cast("long").alias("size"), F.get(k.hits, i).alias("hit"))))

    some = _let(F.struct(F.split(text, p).alias("gaps"), whole.alias("whole"), hits.alias("hits")), placed)
    return F.when(F.regexp_like(text, p), some).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> in order; kind is the place in KINDS."""

    def spans(kind: int, pattern: str, group: int, least: int) -> Column:
        kept = F.filter(found(text, pattern, group), lambda m: F.char_length(m.hit) >= least)
        return F.transform(kept, lambda m: F.struct(m["at"].alias("start"), F.lit(kind).alias("kind"), (m["at"] + m["size"]).alias("end")))

    return F.sort_array(F.concat(spans(0, ASSIGN, 1, 6), spans(1, ACCESS, 0, 20), spans(2, HEX, 0, 24)))


def candidates(text: Column) -> Column:
    """array<struct<at, token>>: what is tested, in the pieces of text between base spans."""
    gaps = F.split(text, BASE)

    def inner(g: Column) -> Column:
        own = lambda m: F.transform(m.hits, lambda h: F.struct((F.get(g.before, m.k) + h["at"]).alias("at"), h["hit"].alias("token")))
        return F.flatten(F.transform(g.gaps, lambda piece, k: _let(F.struct(found(piece, CANDIDATE).alias("hits"), k.alias("k")), own)))

    def outer(g: Column) -> Column:
        sizes = F.transform(g.gaps, lambda piece, k: F.char_length(piece).cast("long") + F.coalesce(F.char_length(F.get(g.whole, k)), F.lit(0)))
        return _let(F.struct(_let(sizes, _before).alias("before"), g.gaps.alias("gaps")), inner)

    some = _let(F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(BASE), F.lit(0)).alias("whole")), outer)
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), some).otherwise(F.array().cast("array<struct<at:bigint,token:string>>"))


def lower_tail(z: Column) -> Column:
    """The normal distribution's probability of a standard score under 0."""
    t = 1 / (1 + 0.2316419 * -z)
    poly = F.lit(0.0)
    for b in reversed(_TAIL):
        poly = (poly + b) * t
    return F.exp(-z * z / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def _place_in(alphabet: str) -> Callable[[Column], Column]:
    return lambda c: F.instr(F.lit(alphabet), c).cast("long")


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span.kind == kind


def tested(tokens: DataFrame) -> DataFrame:
    """tokens (token) -> with encoding, length_class, step (of the p-value) and passes (the three tests); tokens without an encoding go."""
    letters = F.regexp_replace("token", "=+$", "")
    encoding = F.when(letters.rlike("^[0-9]*$"), F.lit(None))
    for name, _, pattern, _ in ENCODINGS:
        encoding = encoding.when(letters.rlike(f"^[{pattern}]+$"), name)

    def by_encoding(value: Callable[[str, float], object]) -> Column:
        out = F.when(F.lit(False), F.lit(value(ENCODINGS[0][1], ENCODINGS[0][3])))
        for name, alphabet, _, equal in ENCODINGS:
            out = out.when(F.col("encoding") == name, F.lit(value(alphabet, equal)))
        return out

    # Each step reads the columns of the one before; the generators keep the optimiser from folding them into one.
    cut = tokens.select("*", F.explode(F.array(F.struct(letters.alias("s"), encoding.alias("encoding")))).alias("c")).select(*tokens.columns, "c.*")
    cut = cut.where("encoding is not null and length(s) >= 20").withColumn("n", F.char_length("s").cast("long"))
    n, k = F.col("n"), by_encoding(lambda a, _: len(a))
    squares = F.aggregate(F.split(by_encoding(lambda a, _: a), ""), F.lit(0).cast("long"), lambda t, c: t + (n - F.char_length(F.replace("s", c))) * (n - F.char_length(F.replace("s", c))))
    bits = F.lit(None).cast("string")
    values = F.lit(None).cast("array<bigint>")
    for name, alphabet, _, _ in ENCODINGS:
        half = len(alphabet) // 2
        here = F.col("encoding") == name
        bits = F.when(here, F.translate("s", alphabet, "0" * half + "1" * (len(alphabet) - half))).otherwise(bits)
        values = F.when(here, F.transform(F.split("s", ""), _place_in(alphabet))).otherwise(values)
    counted = cut.select("*", F.explode(F.array(F.struct(k.alias("k"), squares.alias("squares"), bits.alias("bits"), values.alias("v")))).alias("c")).select(*cut.columns, "c.*")
    ones = n - F.char_length(F.replace("bits", F.lit("1")))
    changes = F.expr("(2 * n - length(replace(bits, '01', '')) - length(replace(bits, '10', ''))) div 2")
    neighbours = _sum(F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), F.slice("v", F.lit(2), F.size("v") - 1), lambda a, b: a * b)) + F.get("v", 0) * F.get("v", F.size("v") - 1)
    sums = counted.select(*cut.columns, "k", "squares", ones.alias("ones"), (changes + 1).alias("runs"), _sum(F.col("v")).alias("s1"), _sum(F.transform("v", lambda x: x * x)).alias("s2"), neighbours.alias("s11"))
    freedom, nd = F.col("k") - 1, n * (F.col("k") * by_encoding(lambda _, equal: equal) - 1)
    chi = F.col("k") * F.col("squares") / n - n
    spread = F.lit(2.0) / (9 * freedom)
    uniform = (F.cbrt(chi / freedom) - (1 - spread)) / F.sqrt(spread)
    ordinary = (chi - (freedom + nd)) / F.sqrt(2 * freedom + 4 * nd)
    zeros = n - F.col("ones")
    mean = 2.0 * F.col("ones") * zeros / n + 1
    of_runs = F.when((F.col("ones") > 0) & (zeros > 0), (F.col("runs") - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    below = n * F.col("s2") - F.col("s1") * F.col("s1")
    deviation = n / ((n - 1) * F.sqrt((n - 2).cast("double")))
    serial = F.when(below > 0, ((n * F.col("s11") - F.col("s1") * F.col("s1")) / below + F.lit(1.0) / (n - 1)) / deviation)
    scored = sums.select(*cut.columns, uniform.alias("z_uniform"), ordinary.alias("z_ordinary"), of_runs.alias("z_runs"), serial.alias("z_serial"))
    step = F.when(F.col("z_ordinary") >= 0, 0).otherwise(F.least(F.floor(-STEPS * F.log10(lower_tail(F.greatest("z_ordinary", F.lit(-30.0))))).cast("int"), F.lit(LAST)))
    passes = (F.col("z_uniform") <= ONE_SIDED) & (F.abs("z_runs") <= TWO_SIDED) & (F.abs("z_serial") <= TWO_SIDED)
    return scored.select(*tokens.columns, "encoding", F.floor(F.log2("n")).cast("int").alias("length_class"), step.alias("step"), F.coalesce(passes, F.lit(False)).alias("passes"))


def discoveries(tests: DataFrame) -> DataFrame:
    """tested() -> encoding, length_class, least: the least step that is a discovery in each class that has any."""
    counted = tests.select("token", "encoding", "length_class", "step").distinct().groupBy("encoding", "length_class", "step").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("encoding", "length_class")  # LAST + 1 rows at most
    at_least = F.sum("n").over(mine.orderBy(F.desc("step")))
    ranked = counted.select("encoding", "length_class", "step", at_least.alias("at_least"), F.sum("n").over(mine).alias("all"))
    return ranked.where(F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS))) * F.col("all") <= RATE * F.col("at_least")).groupBy("encoding", "length_class").agg(F.min("step").alias("least"))


def secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: array<struct<start, kind, end>> of every row, ordered by start and kind.

    Offsets are of code points, from 0, ends exclusive; kind is the place in KINDS. A null or empty text has none. Each row
    is a document: repeated rows and rows with a null doc_id have rows of their own. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    placed = docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("candidates")).withColumn(ROW, F.monotonically_increasing_id())
    scan = stored(placed, "secrets-scan")
    tokens = scan.select(ROW, F.explode("candidates").alias("c")).select(ROW, F.col("c.at").alias("start"), "c.token")
    tests = stored(tested(tokens), "secrets-tests")
    hits = tests.where("passes").join(F.broadcast(discoveries(tests)), ["encoding", "length_class"]).where("step >= least")  # a row for each class
    span = F.struct("start", F.lit(3).alias("kind"), (F.col("start") + F.char_length("token")).alias("end"))
    added = hits.groupBy(ROW).agg(F.collect_list(span).alias("added"))  # of one text
    both = scan.select(ROW, "doc_id", "base").join(added, ROW, "left")
    return both.select("doc_id", F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(both.schema["base"].dataType)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found_spans = secrets(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s.kind < 3)
    return found_spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_found(text: str, pattern: str, group: int) -> str:
    """A list of structs like found()'s; `at` is a word of SQL there, so it is `pos`."""
    p = pattern.replace("'", "''")
    return f"""(select list({{'pos': (list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::bigint), 'size': length(w[i])::bigint, 'hit': h[i]}} order by i)
      from (select regexp_split_to_array({text}, '{p}') as g, regexp_extract_all({text}, '{p}') as w, regexp_extract_all({text}, '{p}', {group}) as h) _m, range(1, len(w) + 1) _r(i))"""


def _sql_case(column: str, value: Callable[[str, str, str, float], str]) -> str:
    return "case " + " ".join(f"when {column} = '{e[0]}' then {value(*e)}" for e in ENCODINGS) + " end"


def _sql_bits(alphabet: str) -> str:
    half = len(alphabet) // 2
    return f"translate(s, '{alphabet}', '{'0' * half + '1' * (len(alphabet) - half)}')"


_SQL_ENCODING = "case when regexp_full_match(s, '[0-9]*') then null " + " ".join(f"when regexp_full_match(s, '[{p}]+') then '{n}'" for n, _, p, _ in ENCODINGS) + " end"
_T = "(1 / (1 + 0.2316419 * -greatest(z_ordinary, -30.0)))"
_SQL_TAIL = "".join(f"{_T} * ({b} + " for b in _TAIL) + "0" + ")" * len(_TAIL)
OP12_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
b0 as (select r, doc_id, t, list_concat(
    list_transform(list_filter(coalesce({_sql_found("t", ASSIGN, 1)}, []), lambda m: length(m.hit) >= 6), lambda m: {{'start': m.pos, 'kind': 0, 'end': m.pos + m.size}}),
    list_transform(coalesce({_sql_found("t", ACCESS, 0)}, []), lambda m: {{'start': m.pos, 'kind': 1, 'end': m.pos + m.size}}),
    list_transform(coalesce({_sql_found("t", HEX, 0)}, []), lambda m: {{'start': m.pos, 'kind': 2, 'end': m.pos + m.size}})) as base,
  regexp_split_to_array(t, '{BASE.replace("'", "''")}') as g, regexp_extract_all(t, '{BASE.replace("'", "''")}') as w from d),
pc as (select r, i, g[i] as piece, coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)::bigint as pos from b0, range(1, len(g) + 1) _q(i)),
ca as (select r, pos + c.pos as start, c.hit as token from (select r, pos, unnest({_sql_found("piece", CANDIDATE, 0)}) as c from pc)),
e0 as (select r, start, token, regexp_replace(token, '=+$', '') as s from ca),
e1 as (select *, {_SQL_ENCODING} as encoding, length(s)::bigint as n from e0),
e2 as (select *, {_sql_case("encoding", lambda n, a, p, q: str(len(a)))} as k, {_sql_case("encoding", lambda n, a, p, q: str(q))}::double as q,
  {_sql_case("encoding", lambda n, a, p, q: _sql_bits(a))} as bits, list_transform(string_split(s, ''), lambda c: instr({_sql_case("encoding", lambda n, a, p, q: f"'{a}'")}, c)::hugeint) as v from e1 where encoding is not null and n >= 20),
e3 as (select r, start, token, encoding, n, k, q, (select sum(x * x) from (select count(*) as x from (select unnest(string_split(s, '')) as c) group by c))::double as squares,
  length(replace(bits, '0', '')) as ones, 1 + (2 * n - length(replace(bits, '01', '')) - length(replace(bits, '10', ''))) // 2 as runs,
  list_sum(v)::double as s1, list_sum(list_transform(v, lambda x: x * x))::double as s2, list_sum(list_transform(range(1, n), lambda i: v[i] * v[i + 1]))::double + (v[1] * v[n])::double as s11 from e2),
e4 as (select *, k * squares / n - n as chi, n * (k * q - 1) as nd, 2.0 / (9 * (k - 1)) as spread, 2.0::double * ones * (n - ones) / n + 1 as mean, n * s2 - s1 * s1 as below from e3),
e5 as (select r, start, token, encoding, n, (cbrt(chi / (k - 1)) - (1 - spread)) / sqrt(spread) as z_uniform, (chi - (k - 1 + nd)) / sqrt(2 * (k - 1) + 4 * nd) as z_ordinary,
  case when ones > 0 and ones < n then (runs - mean) / sqrt((mean - 1) * (mean - 2) / (n - 1)) end as z_runs,
  case when below > 0 then ((n * s11 - s1 * s1) / below + 1.0::double / (n - 1)) / (n / ((n - 1) * sqrt((n - 2)::double))) end as z_serial from e4),
e6 as (select r, start, token, encoding, floor(log2(n))::int as length_class,
  case when z_ordinary >= 0 then 0 else least(floor(-{STEPS} * log10(exp(-greatest(z_ordinary, -30.0) * greatest(z_ordinary, -30.0) / 2) / sqrt(2 * 3.141592653589793::double) * {_SQL_TAIL}))::int, {LAST}) end as step,
  coalesce(z_uniform <= {ONE_SIDED} and abs(z_runs) <= {TWO_SIDED} and abs(z_serial) <= {TWO_SIDED}, false) as passes from e5),
c1 as (select encoding, length_class, step, count(distinct token) as n from e6 group by all),
c2 as (select encoding, length_class, step, sum(n) over (partition by encoding, length_class order by step desc) as above, sum(n) over (partition by encoding, length_class) as al from c1),
c3 as (select encoding, length_class, min(step) as least from c2 where pow(10.0::double, -step / {float(STEPS)}::double) * al <= {RATE}::double * above group by all),
ad as (select r, list({{'start': start, 'kind': 3, 'end': start + length(token)}}) as added from e6 join c3 using (encoding, length_class) where passes and step >= least group by r),
sp as (select doc_id, list_sort(list_concat(base, coalesce(added, []))) as spans from b0 left join ad using (r)),
tx as (select *, list_transform(spans, lambda x: (['assign', 'access', 'hex', 'random'])[x.kind + 1] || ':' || x.start::varchar || ':' || x.end::varchar) as named, list_filter(spans, lambda x: x.kind < 3) as bs from sp)
select doc_id, {", ".join(f"len(list_filter(spans, lambda x: x.kind = {k}))::bigint as n_{n}" for k, n in enumerate(KINDS))},
  sha256(array_to_string(list_transform(bs, lambda x: (['assign', 'access', 'hex'])[x.kind + 1] || ':' || x.start::varchar || ':' || x.end::varchar), ',')) as base_sha256, array_to_string(named, ',') as spans from tx
"""
