"""Text expressions that several operators share; all are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search leaves out.
STOPWORDS = """a an and are as at be by for from has he in is it its of on that the to was were will with this but they
have had what when where who which why how all each every both few more most other some such no nor not only own same so
than too very can just should now""".split()


def tokens(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, of two characters or more, without stopwords; repeats stay.

    A word with any other letter in it gives none: it is split off whole, then left out.
    """
    whole = r"(?<![\p{L}\p{N}_])[a-z0-9]{2,}(?![\p{L}\p{N}_])"
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(whole), F.lit(0)), lambda w: ~w.isin(STOPWORDS))


def query_tokens(text: str) -> list[str]:
    import re

    return [w for w in re.findall(r"\b[a-z0-9]+\b", text.lower()) if len(w) >= 2 and w not in STOPWORDS]


def excerpt(text: Column, needle: str, around: int = 80, ignore_case: bool = True) -> Column:
    """The first occurrence of `needle` between « and », with `around` characters on either side and ... where text was cut."""
    at = F.instr(F.lower(text), needle.lower()) if ignore_case else F.instr(text, needle)
    begin, end = F.greatest(at - around, F.lit(1)), F.least(at + (len(needle) + around - 1), F.length(text))
    hit = F.substr(text, at, F.lit(len(needle)))
    return F.concat(F.when(begin > 1, "...").otherwise(""), F.substr(text, begin, at - begin), F.lit("«"), hit, F.lit("»"), F.substr(text, at + len(needle), end - at - len(needle) + 1), F.when(end < F.length(text), "...").otherwise(""))


def extension(name: Column) -> Column:
    """Lower-case extension, `unknown` without a dot."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)), F.lit("")), F.lit("unknown"))


def nearest_rank(values: Column, percent: int) -> Column:
    """The value at rank round-half-even(p / 100 * (n - 1)) of an array; null of an empty one."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.bround(F.lit(percent / 100.0) * (F.size(values) - 1), 0).cast("int"))


# What keeps a short line of a scanned page (months' names, and words of letters and forms).
OCR_MONTHS = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b"
OCR_WORDS = r"(?i)\b(?:docket|license|operating|appendix|region|dear|mr|mrs|ms|dr|ro|ler|pdr|nrc|office)\b"


def _chars(line: Column, pattern: str) -> Column:
    """How many characters of a class a line has."""
    return F.regexp_count(line, F.lit(pattern))


def noise_line(line: Column) -> Column:
    """Whether a line of a scanned page is an artifact of stamps, specks and margins: by the counts of its characters' classes."""
    length, kept = F.char_length(line), line.rlike(OCR_MONTHS) | line.rlike(OCR_WORDS)
    letters, digits = _chars(line, r"\p{L}"), _chars(line, r"\p{Nd}")
    alnum, symbols = _chars(line, r"[\p{L}\p{N}]"), _chars(line, r"[^\p{L}\p{N}\s]")
    tokens, single = _chars(line, "[A-Za-z0-9]+"), _chars(line, "(?<![A-Za-z0-9])[A-Za-z0-9](?![A-Za-z0-9])")
    odd = (length <= 2) | ((length <= 4) & (letters <= 1) & (digits <= 2)) | ((length <= 8) & (letters == 0) & (digits > 0))
    odd = odd | ((tokens >= 3) & (single >= 0.75 * tokens) & (length <= 18)) | ((alnum <= 4) & (symbols >= 2) & (length <= 16))
    odd = odd | ((letters <= 2) & (digits <= 4) & (symbols >= 1) & (length <= 12))
    return line.rlike(r"""^[|+\-=_:.~,'`"/\\]+$""") | (~kept & odd)


def ocr_cleaned(text: Column) -> Column:
    """The text of a scanned page without its noise: rules, empty table rows and artifacts go, table cells are trimmed, blanks and
    repeated rule characters shrink. Lines that stay are joined by newlines; null is empty."""

    def cells(line: Column) -> Column:
        each = F.transform(F.split(line, r"\|"), lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ :_-]+|[ :_-]+$", ""))
        return F.filter(each, lambda c: c != "")

    def tabled(line: Column) -> Column:
        own = cells(line)
        rule = F.forall(own, lambda c: c.rlike(r"^[-=:.~]{2,}$"))
        return F.when(_chars(line, r"\|") >= 2, F.when(rule, "").otherwise(F.array_join(own, " | "))).otherwise(line)

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.rlike(r"^[|+\-=_:.~]{3,}$"))
    shown = F.transform(F.transform(lines, tabled), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"([|+\-=_:.~])\1{3,}", "$1"))
    kept = F.filter(shown, lambda x: (x != "") & ~x.rlike(r"^[|+\-=_:.~]{2,}$") & ~((_chars(x, r"[\p{L}\p{N}]") == 0) & (_chars(x, r"[^\p{L}\p{N}\s]") >= 3)))
    return F.trim(F.array_join(F.filter(kept, lambda x: ~noise_line(x)), "\n"))
