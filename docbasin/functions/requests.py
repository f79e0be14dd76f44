"""What a request is turned into before any plan is built: plain functions on short strings."""

from __future__ import annotations

import hashlib
import json
import re

NEGATIONS = {"no", "not", "never", "none", "without", "cannot", "except", "neither", "nor", "unless"}
NUMERIC = {"total", "sum", "average", "mean", "count", "many", "much", "highest", "lowest", "largest", "smallest", "top", "percent", "minimum", "maximum"}


def clean_queries(question: str, more: list[str] | None = None) -> list[str]:
    """The question and at most three others, white space folded, each once whatever its case."""
    if not isinstance(question, str) or not question.strip():
        raise ValueError("a question is needed")
    out: dict[str, str] = {}
    for q in [question, *(more or [])[:3]]:
        text = " ".join(q.split())
        if not 1 <= len(text) <= 1000:
            raise ValueError("queries have 1 to 1000 characters")
        out.setdefault(text.casefold(), text)
    return list(out.values())


def literals(queries: list[str], cap: int = 2) -> list[str]:
    """Quoted pieces of 2 to 120 characters, then identifiers such as EQ-17; each once."""
    quoted = [m for q in queries for m in re.findall(r'"([^"]{2,120})"', q)]
    ids = [m for q in queries for m in re.findall(r"\b[A-Za-z]{1,12}-\d+(?:-\d+)*\b", q)]
    return list(dict.fromkeys(quoted + ids))[:cap]


def clean_filters(filters: dict | None) -> dict[str, list[str] | str] | None:
    """Known keys only, trimmed; strings become lists where a list is meant; nothing left is None."""
    out: dict[str, list[str] | str] = {}
    for key in ("document_ids", "source_formats", "filenames"):
        value = (filters or {}).get(key)
        items = [v.strip() for v in ([value] if isinstance(value, str) else value or []) if isinstance(v, str) and v.strip()]
        if items:
            out[key] = items
    for key in ("date_from", "date_to"):
        if isinstance(value := (filters or {}).get(key), str) and value.strip():
            out[key] = value.strip()
    return out or None


def numeric_intent(question: str) -> bool:
    return bool(NUMERIC & set(re.findall(r"[a-z]+", question.lower()))) or "how many" in question.lower()


def exact_intent(question: str) -> bool:
    """Whether words are to be found as they stand: quoted, or asked for by exact, verbatim or literally."""
    return bool(re.search(r"\"[^\"]+\"|\b(?:exact|exactly|verbatim|literal|literally|word for word)\b", question.lower()))


def cacheable(turn: int, sources: int, tool_calls: int) -> bool:
    """Answers are kept for a first turn, with sources, without tools."""
    return turn == 1 and sources > 0 and tool_calls == 0


def same_question(a: str, b: str, threshold: float) -> bool:
    """Whether a kept answer may serve: the same words, or, below a threshold of 1, the same words that change a meaning."""
    return " ".join(a.lower().split()) == " ".join(b.lower().split()) or (threshold < 1 and load_bearing(a) == load_bearing(b))


def load_bearing(question: str) -> list[str]:
    """Negations and whatever holds a digit: two questions that differ here aren't the same."""
    words = [w.strip(".-") for w in re.findall(r"[\w.'’%-]+", question.lower().replace("’", "'"))]
    return sorted(w for w in words if w in NEGATIONS or w.endswith("n't") or any(c.isdigit() for c in w))


def scope_key(scope: str, **settings) -> str:
    """The scope and a digest of all that answers depend on."""
    return f"{scope}#{hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]}"


def speech_pages(segments: list[tuple[float, str]], seconds: int = 240) -> list[str]:
    """(start, text) of a transcript -> pages of so many seconds, each line with its time."""
    pages: dict[int, list[str]] = {}
    for start, text in sorted(segments):
        pages.setdefault(int(start // seconds), []).append(f"[{int(start // 60):02d}:{int(start % 60):02d}] {text.strip()}")
    return ["\n".join(lines) for _, lines in sorted(pages.items())]


def review_sample(pages: list[str], cap: int = 6, chars: int = 2000) -> list[tuple[int, str]]:
    """The first two pages and others evenly spaced, cut to so many characters; (page from 1, text)."""
    if len(pages) <= cap:
        chosen = list(range(len(pages)))
    else:
        step = (len(pages) - 2) / (cap - 2)
        chosen = sorted({0, 1, *(min(len(pages) - 1, 2 + int(i * step)) for i in range(cap - 2))})
    return [(i + 1, pages[i][:chars]) for i in chosen]
