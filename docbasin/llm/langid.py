"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by a hash of its code point. A letter trigram is the product of its
letters' vectors, the first rolled by two places and the second by one (binding with order); a text is the sum of its
trigrams' vectors (bundling); a language's prototype is the sum over its training texts, less what all languages have in
common. A text gets the language of the prototype with the largest cosine.

Bundling is linear, so a task sums its texts' vectors by language and only these sums are shuffled; documents are scored
in one pass over the scan. A task holds DIMENSIONS numbers a language and the vectors of BLOCK trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, mix, pieces, read

DIMENSIONS = 1024
#: Trigrams whose vectors are made at once.
BLOCK = 4096
#: Texts that are compared at once.
ROWS = 1000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def alphabetic() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(points: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for each code point (0 stands for the gap between words)."""
    seeds = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(seeds + np.uint64(1))).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def vectors(grams: np.ndarray) -> np.ndarray:
    """Trigram vectors by binding; grams: three code points a row."""
    points, at = np.unique(grams, return_inverse=True)
    v, at = letters(points), at.reshape(grams.shape)
    return (np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]).astype(np.float32)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and trigram number of each trigram of letters, and the distinct trigrams; words are cased down and set apart by one gap."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = pc.utf8_length(lowered).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le"), np.uint32)
    s = np.where(alphabetic()[points], points, np.uint32(0))
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    first = np.ones(len(s), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = (s > 0) | first
    keep[1:] |= s[:-1] > 0
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 3), np.uint32)
    place = np.zeros(0x110000, np.int64)
    place[s] = 1
    known = np.flatnonzero(place)
    place[known] = np.arange(len(known))
    at, k = place[s], len(known)
    code = (at[:-2] * k + at[1:-1]) * k + at[2:]
    # A one-letter word at a text's edge has no neighbour there; texts of fewer than three symbols give none.
    ok = (doc[:-2] == doc[2:]) & (s[1:-1] > 0)
    code, doc = code[ok], doc[:-2][ok]
    if k**3 <= 1 << 24:  # few letters: by counting instead of sorting
        there = np.zeros(k**3, bool)
        there[code] = True
        used = np.flatnonzero(there)
        slot = np.zeros(k**3, np.int64)
        slot[used] = np.arange(len(used))
        gram = slot[code]
    else:
        used, gram = np.unique(code, return_inverse=True)
    return doc, gram, known[np.stack([used // (k * k), used // k % k, used % k], 1)].astype(np.uint32)


def bundles(row: np.ndarray, gram: np.ndarray, weight: np.ndarray | None, grams: np.ndarray, rows: int) -> np.ndarray:
    """Sums of trigram vectors by row, a block of trigrams at a time."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    key = row.astype(np.int64) * max(len(grams), 1) + gram
    if weight is None:
        key, total = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, weight, len(key))
    row, gram = key // max(len(grams), 1), key % max(len(grams), 1)
    order = np.argsort(gram // BLOCK, kind="stable")
    row, gram, total = row[order], gram[order], total[order]
    for begin in range(0, len(grams), BLOCK):
        lo, hi = np.searchsorted(gram // BLOCK, [begin // BLOCK, begin // BLOCK + 1])
        part = np.zeros((rows, min(BLOCK, len(grams) - begin)), np.float32)
        part[row[lo:hi], gram[lo:hi] - begin] = total[lo:hi]
        out += part @ vectors(grams[begin : begin + BLOCK])
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """docs (text, lang) -> unit prototypes; "" has what they have in common. To the driver come DIMENSIONS sums a language: the model.

    Each text counts with weight 1 / its number of trigrams, so long texts don't outweigh short ones. Rows without lang
    or text, and texts without trigrams, teach nothing; repeated rows count as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in pieces(batches):
            doc, gram, grams = trigrams(piece["text"])
            langs = piece["lang"].dictionary_encode()
            names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            weight = 1 / np.maximum(np.bincount(doc, minlength=piece.num_rows), 1)
            for name, own in zip(names, bundles(which[doc], gram, weight[doc], grams, len(names)), strict=True):
                total[name] = total.get(name, 0.0) + own.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["lang", "sums"])

    known = arrow(docs).where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("text", "lang")
    found = known.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    sums = {name: g.x.to_numpy().astype(np.float32) for name, g in found.sort_values(["lang", "at"]).groupby("lang")}
    sums = {k: v for k, v in sums.items() if v.any()}
    if not sums:
        return {}
    units = {k: v / (np.linalg.norm(v) + 1e-9) for k, v in sums.items()}
    common = np.mean(list(units.values()), 0) if len(units) > 1 else 0
    return {k: (v - common) / (np.linalg.norm(v - common) + 1e-9) for k, v in units.items()} | {"": common * np.ones(DIMENSIONS)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, lang_pred, score. Each row stands by itself; other columns never reach the scorer.

    A null text, and one without a letter, is undetermined with score 0, as is every text if no language was learned.
    Of equal cosines the language that sorts first wins. A text with letters but too short for a trigram gets the
    first language with score 0. score = (1 + cosine) / 2 of the winner.
    """
    names = sorted(k for k in prototypes if k)
    table = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    common = np.asarray(prototypes.get("", np.zeros(DIMENSIONS)), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, rows=ROWS):
            n = piece.num_rows
            pred, score = [UNDETERMINED] * n, np.zeros(n)
            doc, gram, grams = trigrams(piece["text"])
            lettered = has_letter(piece["text"])
            bundle = bundles(doc, gram, None, grams, n)
            bundle = bundle / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9) - common
            cosine = bundle @ table.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
            some = np.bincount(doc, minlength=n) > 0
            for i in np.flatnonzero(lettered) if names else ():
                best = int(cosine[i].argmax()) if some[i] else 0
                pred[i] = names[best]
                score[i] = min(1.0, max(0.0, (1 + float(cosine[i, best])) / 2)) if some[i] else 0.0
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: its row isn't learned from, isn't held out, and is judged like any other."""
    docs = read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = identify(docs, profiles(docs.where(fold != 1)))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
