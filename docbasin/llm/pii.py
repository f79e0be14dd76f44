"""Personal data in text: plain patterns, and disguised identifiers by offset-preserving transducers.

Three transducers are applied in turn; each reads a text and writes another, with for every character written the span
it came from: (1) characters that look like ASCII ones (full width, Cyrillic and Greek look-alikes, mathematical
letters, other decimal digits) are replaced, invisible ones removed; (2) "at" and "dot" in brackets or between words
become @ and . ; (3) digits spelled out become digits. Their maps compose, so what the patterns find in the last text
maps back to characters of the source. The plain patterns' own matches always stay; a disguised match is added where it
overlaps none of its kind. Undoing a disguise can join an identifier to digits beside it, so in rewritten text runs that
fail a check (digits, Luhn) are also tried by groups of digits; plain text is never tried again.

A map is kept as runs: stretches that were copied, and stretches that replace others. So it is as long as what was
changed, not as the text.

Each text is one unit of work; the transducers only run on texts in which a cheap pattern has seen something to undo.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, pieces, read

KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: if the run's first digit leads to none, no later one does. The looks
# behind and the possessive runs only keep long runs from being read again and again.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: Cyrillic and Greek letters and the ASCII letters they look like.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοινρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaoivpukABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {w: str(d) for d, ws in enumerate(["zero null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf"]) for w in ws.split()}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT = r"(?:at|arroba|arobase|ät)", r"(?:dot|punkt|punto|point)"
# A plain "at" needs a domain behind it that ends in a spelled dot's label or in one of letters, so times ("at 9.30pm") are none.
BRACKET_AT = re.compile(rf"(?:(?<!\s)\s+)?[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]\s*", re.I)
BRACKET_DOT = re.compile(rf"(?:(?<!\s)\s+)?[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*", re.I)
PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+{_AT}\s+(?=[A-Za-z0-9-]+(?:(?:\s+{_DOT}\s+|\.)[A-Za-z0-9-]+)*(?:\s+{_DOT}\s+[A-Za-z0-9-]|\.[A-Za-z][A-Za-z0-9-]))|(?<=[A-Za-z0-9])[_-]{_AT}[_-](?=[A-Za-z0-9]+[_-]{_DOT}[_-])", re.I)
PLAIN_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+{_DOT}\s+|[_-]{_DOT}[_-])(?=[A-Za-z0-9])", re.I)
NUMBER_RUN = re.compile(rf"(?<!\w)(?:plus\s+)?(?:{_WORD}|[0-9]+)(?:[\s,.()-]{{1,3}}(?:(?:dot|point|punkt|punto)[\s,-]{{1,3}})?(?:{_WORD}|[0-9]+))+(?!\w)", re.I)
RUN_PART = re.compile(rf"(?P<word>{_WORD})(?!\w)|(?P<plus>plus\s+)|(?P<dot>[\s,.-]*(?:dot|point|punkt|punto)[\s,.-]*)|(?P<num>[0-9]+)|(?P<gap>[\s,.()-]+)", re.I)
#: What makes it worth while to run the transducers over a text: HINT_AT holds for all that the four patterns of marks need.
HINT_AT = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s*[\])}}>]|[\s_-]{_DOT}[\s_-]|\s{_AT}\s+[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)
HINT_WORD = re.compile(rf"(?<!\w)(?:(?:{_WORD})[\s,.-]{{1,3}}){{2}}|(?<!\w)(?:{_WORD})[\s,.-]{{1,3}}[0-9]|[0-9][\s,.-]{{1,3}}(?:{_WORD})(?!\w)", re.I)
LEET = re.compile(r"(?<![A-Za-z0-9])[0-9OolI](?:[ -]?[0-9OolI]){12,18}(?![A-Za-z0-9])")
Spans = list[tuple[int, int]]


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """Code point -> its ASCII look-alike ("" if invisible)."""
    out = {ord(c): a for c, a in LOOKALIKES.items()} | {ord(c): "" for c in INVISIBLE}
    for cp in (*range(0x0660, 0x3000), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        c = chr(cp)
        if cp in out or unicodedata.category(c) == "Cn":
            continue
        if (digit := unicodedata.decimal(c, None)) is not None:
            out[cp] = str(digit)
        elif cp >= 0xFF00 and len(n := unicodedata.normalize("NFKC", c)) == 1 and 32 < ord(n) < 127:
            out[cp] = n
    return out


#: Characters that may have an ASCII look-alike: plain ranges, which are fast to look for.
FOREIGN = re.compile("[­ɐ-\U0010ffff]")


def spells(text: str) -> bool:
    """Whether two digits beside each other are spelled out, or one beside a digit."""
    words = text.lower().replace(",", " ").replace(".", " ").replace("-", " ").split()
    return not SPELLED.keys().isdisjoint(words) and HINT_WORD.search(text) is not None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Spans:
    """As the pattern's leftmost matches: the local part is the run of its characters before an @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def plain(text: str) -> dict[str, Spans]:
    """The plain patterns' matches that pass their checks."""
    out: dict[str, Spans] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split("."))]
        out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() <= 37 and _card(re.sub("[ -]", "", m.group()))]
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15]
    return out


def again(text: str) -> dict[str, Spans]:
    """Cards and phones inside runs that failed as a whole: windows of whole groups of digits."""
    out: dict[str, Spans] = {"card": [], "phone": []}
    for m in CARD.finditer(text):
        whole = m.group()
        if sum(c.isdigit() for c in whole) > 19:
            groups, i = [g.span() for g in re.finditer("[0-9]+", whole)], 0
            while i < len(groups):
                digits, best = "", None
                for j in range(i, len(groups)):
                    digits += whole[slice(*groups[j])]
                    if len(digits) > 19:
                        break
                    if _card(digits):
                        best = j
                if best is not None:
                    out["card"].append((m.start() + groups[i][0], m.start() + groups[best][1]))
                i = i + 1 if best is None else best + 1
    for m in PHONE.finditer(text):
        digits, end = 0, 0
        if len(DIGITS.findall(m.group())) > 15:
            for g in re.finditer("[0-9]+", m.group()):
                digits += len(g.group())
                if digits > 15:
                    break
                end = g.end() if digits >= 9 else 0
            if end:
                out["phone"].append((m.start(), m.start() + end))
    return out


class Tape:
    """A text and the runs it is made of: where each begins, the source span it is for, and whether it is that span's copy."""

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        self.runs = [(0, 0, len(text), True)] if runs is None else runs
        self.at = [r[0] for r in self.runs]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A new tape with the pieces [begin, end) replaced, in order and without overlap."""
        if not edits:
            return self
        out, runs, size, at, k = [], [], 0, 0, 0
        for begin, end, new in [*edits, (len(self.text), len(self.text), "")]:
            while at < begin:  # what stays, run by run
                start, b, e, same = self.runs[k]
                stop = min(begin, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                if at < stop:
                    runs.append((size, b + at - start, b + stop - start, True) if same else (size, b, e, False))
                    out.append(self.text[at:stop])
                    size += stop - at
                    at = stop
                if at < begin:
                    k += 1
            if new:
                runs.append((size, *self.source(begin, end), False))
                out.append(new)
                size += len(new)
            at = max(at, end)
            while k + 1 < len(self.at) and self.at[k + 1] <= at:
                k += 1
        return Tape("".join(out), runs)

    def source(self, begin: int, end: int) -> tuple[int, int]:
        start, b, _, same = self.runs[bisect_right(self.at, begin) - 1]
        first = b + begin - start if same else b
        start, b, e, same = self.runs[bisect_right(self.at, end - 1) - 1]
        return first, b + end - start if same else e

    def changed(self, begin: int, end: int) -> bool:
        """Whether anything in it was replaced or left out."""
        b, e = self.source(begin, end)
        lo, hi = bisect_right(self.at, begin) - 1, bisect_right(self.at, end - 1)
        return e - b != end - begin or not all(r[3] for r in self.runs[lo:hi])


def fold(tape: Tape) -> Tape:
    table = folding()
    return tape.rewrite([(m.start(), m.end(), table[ord(m.group())]) for m in FOREIGN.finditer(tape.text) if ord(m.group()) in table])


def marks(tape: Tape) -> Tape:
    for pattern, new in ((BRACKET_AT, "@"), (BRACKET_DOT, "."), (PLAIN_AT, "@"), (PLAIN_DOT, ".")):
        tape = tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text)])
    return tape


def numbers(tape: Tape) -> Tape:
    """Spelled digits become digits, and gaps between two of them go; letters that stand for digits in long numbers too."""
    edits = []
    for run in NUMBER_RUN.finditer(tape.text):
        parts = [(p.lastgroup, run.start() + p.start(), run.start() + p.end()) for p in RUN_PART.finditer(run.group())]
        if not any(k == "word" for k, _, _ in parts):
            continue
        for i, (kind, begin, end) in enumerate(parts):
            if kind == "word":
                edits.append((begin, end, SPELLED[tape.text[begin:end].lower()]))
            elif kind == "plus":
                edits.append((begin, end, "+"))
            elif kind == "dot":
                edits.append((begin, end, "."))
            elif kind == "gap" and 0 < i < len(parts) - 1 and "word" in (parts[i - 1][0], parts[i + 1][0]) and "." not in tape.text[begin:end]:
                edits.append((begin, end, "" if parts[i - 1][0] == parts[i + 1][0] else " "))
    tape = tape.rewrite(edits)
    table = {"O": "0", "o": "0", "l": "1", "I": "1"}
    return tape.rewrite([(i, i + 1, table[tape.text[i]]) for m in LEET.finditer(tape.text) if len(DIGITS.findall(m.group())) >= 10 for i in range(*m.span()) if tape.text[i] in table])


def disguised(text: str) -> dict[str, Spans]:
    """Identifiers that appear once the disguises are undone, in source offsets."""
    out: dict[str, Spans] = {k: [] for k in KINDS}
    tapes = []
    tape = Tape(text)
    if not text.isascii() and any(ord(c) in folding() for c in set(FOREIGN.findall(text))):
        tape = fold(tape)
        tapes.append(tape)
    if HINT_AT.search(tape.text):
        tape = marks(tape)
        tapes.append(tape)
    if spells(tape.text) or LEET.search(tape.text):
        after = numbers(tape)
        tapes += [after] if after is not tape else []
    for t in tapes:
        found = plain(t.text)
        for kind, spans in again(t.text).items():
            found[kind] += spans
        for kind in KINDS:
            out[kind] += [t.source(b, e) for b, e in found[kind] if t.changed(b, e)]
    return out


def merge(spans: Spans, more: Spans) -> Spans:
    """`spans`, which don't overlap, and those of `more` that overlap nothing so far, the longest first."""
    out = sorted(spans)
    for b, e in sorted(set(more), key=lambda s: (s[0] - s[1], s[0])):
        k = bisect_right(out, (b, e))
        if (k == 0 or out[k - 1][1] <= b) and (k == len(out) or e <= out[k][0]):
            out.insert(k, (b, e))
    return out


def find(text: str) -> tuple[dict[str, Spans], dict[str, Spans]]:
    """The plain patterns' spans, and all spans, by kind; code points, end exclusive."""
    base, more = plain(text), disguised(text)
    return base, {k: merge(base[k], more[k]) if more[k] else base[k] for k in KINDS}


def listed(spans: dict[str, Spans]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k in KINDS for b, e in spans[k])


def redact(text: str, spans: dict[str, Spans]) -> str:
    """Every span replaced by its kind in brackets; of overlapping spans one bracket, of the first one's kind."""
    out, at = [], 0
    for b, e, k in sorted((b, e, k) for k in KINDS for b, e in spans[k]):
        if b >= at:
            out += [text[at:b], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, n_spans (all spans), base_sha256, spans, base_spans.

    A null text counts as empty: no spans. Rows stand by themselves, so repeated rows get repeated results; other columns
    are ignored. One pass, no shuffle.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans", "base_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for text in piece["text"].to_pylist():
                base, every = find(text or "")
                own, n = listed(base), [len(every[k]) for k in KINDS]
                rows.append((*n, sum(n), hashlib.sha256(own.encode()).hexdigest(), listed(every), own))
            types = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string, base_spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind, and n_chars (where there is one) counted anew; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            text = pa.array([t and redact(t, find(t)[1]) for t in piece["text"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else piece[c] for c in piece.schema.names], names=piece.schema.names)

    out = arrow(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"))
    base = [(F.regexp_count("base_spans", F.lit(f"{k}:"))).cast("long").alias(f"base_{k}") for k in KINDS]
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans", *base)
