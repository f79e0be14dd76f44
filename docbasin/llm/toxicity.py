"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, not for tokens, so tokens are labelled first: over a bounded sample of labelled
training documents, a word of a toxic document is a toxic token if the share of toxic documents that hold it exceeds
the share of clean ones by far (`fit`). A two-state chain (clean, toxic) over hashed features of a word, its first and
last letters and the words beside it is then fitted to these sequences by gradient ascent on the conditional likelihood. Forward-backward gives each token's
marginal; the expected number of toxic tokens and the largest marginal, through a logistic fit to the documents' own
labels, give the document's score. The tokens with a marginal of one half or more are the offending spans.

Everything that is learned is small (hashed weights, 2 x 2 transitions, three coefficients) and travels with the task's
closure; scoring is one pass over the scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, hash_words, mix, pieces, read, split_words, stored

#: Bounds of the sample of labelled rows that is fitted to, parameters of `fit`: labelled documents whose words are
#: counted; of these, documents (half of them toxic) for the chain; characters of the latter together.
LEXICON_DOCS = 16_000
CHAIN_DOCS = 1_200
CHAIN_CHARS = 6_000_000
#: Slots of hashed features: far more than there are words, as a word that shares a toxic word's slot would be taken for it.
FEATURES = 1 << 21
COLUMNS = 1024
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Chain:
    weights: np.ndarray  # by hashed feature: log odds of toxic against clean
    moves: np.ndarray  # 2 x 2 log potentials
    start: np.ndarray
    logistic: np.ndarray  # intercept, expected toxic tokens, largest marginal


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens per text, each token's index in the dictionary, the dictionary of lower-cased words without outer punctuation."""
    per, index, dictionary = split_words(texts, False)
    return per, index, pc.utf8_trim(pc.utf8_lower(dictionary), TRIM)


def features(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word: three of its own (itself, first five letters, last three), two it gives to the words after and before it."""
    n = np.uint64(FEATURES)
    if not len(dictionary):
        return np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)

    def hashed(parts: pa.Array, role: int) -> np.ndarray:
        coded = parts.dictionary_encode()
        return (mix(hash_words(coded.dictionary) + np.uint64(role)) % n)[coded.indices.to_numpy()]

    own = [hashed(dictionary, 0), hashed(pc.utf8_slice_codeunits(dictionary, 0, 5), 1), hashed(pc.utf8_slice_codeunits(dictionary, -3), 2)]
    return np.stack(own, 1).astype(np.int64), np.stack([hashed(dictionary, 3), hashed(dictionary, 4)], 1).astype(np.int64)


def emissions(weights: np.ndarray, dictionary: tuple[np.ndarray, np.ndarray], index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token the log odds that its features give; `first` marks each document's first token, which has no word before."""
    own, given = dictionary
    e = weights[own].sum(1)[index].astype(np.float64)
    inner = ~first[1:]
    e[1:] += np.where(inner, weights[given[:, 0]][index[:-1]], 0)
    e[:-1] += np.where(inner, weights[given[:, 1]][index[1:]], 0)
    return e


def feature_sums(values: np.ndarray, dictionary: tuple[np.ndarray, np.ndarray], index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each feature the sum of its tokens' values."""
    own, given = dictionary
    n, inner = len(own), ~first[1:]
    word = np.bincount(index, values, n)
    after, before = np.bincount(index[:-1], values[1:] * inner, n), np.bincount(index[1:], values[:-1] * inner, n)
    out = np.bincount(own.ravel(), np.repeat(word, own.shape[1]), FEATURES)
    return out + np.bincount(given[:, 0], after, FEATURES) + np.bincount(given[:, 1], before, FEATURES)


def forward_backward(emission: np.ndarray, first: np.ndarray, chain: Chain, pairs: bool = False):
    """Marginals of toxic for tokens of many documents laid end to end; `first` marks each document's first token.

    A document's first token has a rank-one move (it forgets what came before), so the documents form one chain. It is
    folded into columns that advance together: products of each column, then the columns' starts, then the messages.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    rows = -(-n // COLUMNS)
    e = np.zeros(rows * COLUMNS)
    f = np.ones(rows * COLUMNS, bool)
    e[:n], f[:n] = np.clip(emission, -30, 30), first
    e, f = e.reshape(COLUMNS, rows).T, f.reshape(COLUMNS, rows).T
    a, pi = np.exp(chain.moves), np.exp(chain.start)
    lift = np.exp(e / 2)
    m = np.empty((rows, COLUMNS, 2, 2))
    for i in range(2):
        for j in range(2):
            m[:, :, i, j] = np.where(f, pi[j], a[i, j]) * (lift if j else 1 / lift)
    product = m[0].copy()
    for t in range(1, rows):
        product = product @ m[t]
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((COLUMNS, 2)), np.empty((COLUMNS, 2))
    v = np.array([1.0, 0.0])
    for k in range(COLUMNS):
        ahead[k] = v
        v = v @ product[k]
        v /= v.sum()
    v = np.ones(2)
    for k in range(COLUMNS - 1, -1, -1):
        behind[k] = v
        v = product[k] @ v
        v /= v.sum()
    alpha, beta = np.empty((rows, COLUMNS, 2)), np.empty((rows, COLUMNS, 2))
    v = ahead
    for t in range(rows):
        v = (v[:, :, None] * m[t]).sum(1)
        v /= v.sum(1, keepdims=True)
        alpha[t] = v
    v = behind
    for t in range(rows - 1, -1, -1):
        beta[t] = v
        v = (m[t] * v[:, None, :]).sum(2)
        v /= v.sum(1, keepdims=True)
    both = alpha * beta
    marginal = (both[:, :, 1] / both.sum(2)).T.reshape(-1)[:n]
    if not pairs:
        return marginal, None, None
    past = np.concatenate([ahead[None], alpha[:-1]])
    xi = past[:, :, :, None] * m * beta[:, :, None, :]
    xi /= xi.sum(axis=(2, 3), keepdims=True)
    xi = xi.transpose(1, 0, 2, 3).reshape(-1, 2, 2)[:n]
    return marginal, xi[~first].sum(0), xi[first].sum((0, 1))


def fit_chain(texts: list[str], toxic: np.ndarray, lexicon: set[str], rounds: int = 30) -> Chain:
    """Labels tokens by the lexicon, fits the chain to them, and the document's logistic to the documents' labels."""
    chain = Chain(np.zeros(FEATURES), np.log(np.full((2, 2), 0.5)), np.log(np.full(2, 0.5)), np.array([-2.0, 0.0, 0.0]))
    per, index, dictionary = tokens(pa.array(texts, pa.string()))
    if not len(index):
        return chain
    bad = np.array([w in lexicon for w in dictionary.to_pylist()])
    doc = np.repeat(np.arange(len(per)), per)
    y = bad[index] & (toxic[doc] > 0)
    feats = features(dictionary)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    seen, gold = feature_sums(np.ones(len(y)), feats, index, first), feature_sums(y.astype(float), feats, index, first)
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:-1][~first[1:]].astype(int), y[1:][~first[1:]].astype(int)), 1)
    began = np.bincount(y[first].astype(int), minlength=2).astype(float)
    # The start: smoothed log odds of each of a word's own features, a third each as three add up; clean stays clean.
    rate, own = y.mean(), np.zeros(FEATURES, bool)
    own[feats[0].ravel()] = True
    odds = np.log((gold + 0.5 * rate + 1e-3) / (seen - gold + 0.5)) - np.log((rate + 1e-6) / (1 - rate + 1e-6))
    chain.weights = odds / 3 * ((seen > 0) & own)
    chain.moves, chain.start = np.log((moved + 1) / (moved + 1).sum(1, keepdims=True)), np.log((began + 1) / (began + 1).sum())
    scale = np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p, xi, x0 = forward_backward(emissions(chain.weights, feats, index, first), first, chain, pairs=True)
        grad = gold - feature_sums(p, feats, index, first) - 0.02 * chain.weights
        scale += grad * grad
        chain.weights += 0.3 * grad / np.sqrt(scale)
        chain.moves += 0.5 * (moved - xi) / (moved.sum() + 1) * 10
        chain.start += 0.5 * (began - x0) / (began.sum() + 1)
        chain.moves -= np.log(np.exp(chain.moves).sum(1, keepdims=True))
    p, _, _ = forward_backward(emissions(chain.weights, feats, index, first), first, chain)
    chain.logistic = fit_logistic(evidence(p, per), toxic)
    chain.weights = chain.weights.astype(np.float32)
    return chain


def evidence(marginals: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Of each document: 1, log(1 + expected toxic tokens), largest marginal."""
    total, most, at = np.zeros(len(per)), np.zeros(len(per)), np.flatnonzero(per)
    if len(at):
        begin = (np.cumsum(per) - per)[at]
        total[at], most[at] = np.add.reduceat(marginals, begin), np.maximum.reduceat(marginals, begin)
    return np.stack([np.ones(len(per)), np.log1p(total), most], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text, toxic) -> word, in_toxic, in_clean: documents of either label that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            per, index, dictionary = tokens(piece["text"])
            folded = dictionary.dictionary_encode()
            doc = np.repeat(np.arange(len(per)), per)
            size = max(len(folded.dictionary), 1)
            pair = np.unique(doc * size + folded.indices.to_numpy()[index]) if len(index) else np.zeros(0, np.int64)
            label = piece["toxic"].to_numpy(zero_copy_only=False)[pair // size] > 0
            counts = [np.bincount(pair[m] % size, minlength=len(folded.dictionary)) for m in (label, ~label)]
            yield pa.RecordBatch.from_arrays([folded.dictionary.cast(pa.string()), pa.array(counts[0]), pa.array(counts[1])], names=["word", "in_toxic", "in_clean"])

    return arrow(docs.select("text", "toxic")).mapInArrow(run, "word string, in_toxic long, in_clean long").groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))


def contexts(docs: DataFrame, candidates: set[str]) -> DataFrame:
    """docs (text) -> word, around: the candidates with a hash of the words beside them, as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            per, index, dictionary = tokens(piece["text"])
            h = hash_words(dictionary)[index] if len(index) else np.zeros(0, np.uint64)
            padded = np.concatenate([[np.uint64(0)], h, [np.uint64(0)]])
            wanted = np.flatnonzero(np.array([w in candidates for w in dictionary.to_pylist()], bool)[index]) if len(index) else np.zeros(0, np.int64)
            around = mix(padded[wanted] + mix(padded[wanted + 2]))
            yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(index[wanted])).cast(pa.string()), pa.array(around.view(np.int64))], names=["word", "around"])

    return arrow(docs.select("text")).mapInArrow(run, "word string, around long")


def drawn(sizes: list[tuple[int, int]], docs: int, chars: int) -> list[int]:
    """Of rows (doc_id, n) the first `docs` that fit into `chars` together; a document longer than what is left is passed over."""
    out, left = [], chars
    for doc_id, n in sizes:
        if len(out) < docs and n <= left:
            out.append(doc_id)
            left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, lexicon_docs: int = LEXICON_DOCS, chain_docs: int = CHAIN_DOCS, chain_chars: int = CHAIN_CHARS) -> Chain:
    """Learns from the labelled documents whose crc32(doc_id) mod `folds` is not 0; of repeated labels the largest counts.

    The sample is drawn by a hash of doc_id: `lexicon_docs` documents, and of them for the chain `chain_docs` with at
    most `chain_chars` characters, half of either label each. A toxic word is in at least 3 toxic documents and 0.5 % of
    them, at a share 40 times that among the clean ones, and there in as many different surroundings: copies of one
    document have a word's neighbours in common. So there are at most 200 times as many toxic words as a document has.
    Of texts that share a doc_id the least counts. Rows without doc_id, label or text teach nothing. Without documents of both labels the chain knows no toxic words.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(lexicon_docs).toPandas()  # bounded by lexicon_docs
    if not len(chosen) or not chosen.toxic.sum() or chosen.toxic.all():
        return Chain(np.zeros(FEATURES), np.log(np.full((2, 2), 0.5)), np.log(np.full(2, 0.5)), np.array([-2.0, 0.0, 0.0]))
    ids = spark.createDataFrame(chosen, "doc_id long, toxic int")
    sample = stored(docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    n_toxic, n_clean = int(chosen.toxic.sum()), int((1 - chosen.toxic).sum())
    least = max(3, 0.005 * n_toxic)
    strong = word_counts(sample).where((F.col("in_toxic") >= least) & ((F.col("in_toxic") / n_toxic) >= 40 * (F.col("in_clean") + 0.5) / n_clean) & (F.col("word") != ""))
    candidates = {r.word for r in strong.collect()}
    varied = contexts(sample.where("toxic = 1"), candidates).groupBy("word").agg(F.countDistinct("around").alias("n")).where(F.col("n") >= least)
    lexicon = {r.word for r in varied.collect()}  # at most the candidates
    sizes = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()  # at most lexicon_docs rows
    ids = [i for t in (0, 1) for i in drawn(sizes[sizes.toxic == t][["doc_id", "n"]].values.tolist(), chain_docs // 2, chain_chars // 2)]
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = sample.join(F.broadcast(wanted), "doc_id").toPandas().sort_values("doc_id", key=lambda c: c * 2654435761 % 4294967296)
    chain = fit_chain(rows.text.tolist(), rows.toxic.to_numpy(), lexicon)
    # The two classes were drawn evenly: back to their true odds.
    odds = (rows.toxic.sum() + 0.5) / ((1 - rows.toxic).sum() + 0.5)
    chain.logistic[0] += np.log((n_toxic / n_clean) / odds)
    return chain


def _judge(texts: pa.Array, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts, tokens per text, every token's marginal."""
    per, index, dictionary = tokens(texts)
    doc = np.repeat(np.arange(len(per)), per)
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    p, _, _ = forward_backward(emissions(chain.weights, features(dictionary), index, first) if len(index) else np.zeros(0), first, chain)
    return 1 / (1 + np.exp(-np.clip(evidence(p, per) @ chain.logistic, -30, 30))), per, p


def score(docs: DataFrame, chain: Chain, *, threshold: float = 0.5) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, score, predicted, spans (begin and end of offending tokens in code points).

    Null and empty texts have no tokens and so the score of a document without toxic tokens. Each row is scored by
    itself: repeated rows get repeated results. Other columns never reach the scorer.
    """
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            value, per, p = _judge(piece["text"], chain)
            doc = np.repeat(np.arange(len(per)), per)
            spans: list[list[dict]] = [[] for _ in per]
            begin = np.cumsum(per) - per
            for d in np.unique(doc[p >= 0.5]):
                hits = set(np.flatnonzero(p[begin[d] : begin[d] + per[d]] >= 0.5).tolist())
                spans[d] = [{"begin": m.start(), "end": m.end()} for i, m in enumerate(WORD.finditer(piece["text"][int(d)].as_py())) if i in hits]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "score", "predicted", "spans"])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<begin:int,end:int>>")


def clean(docs: DataFrame, chain: Chain, *, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` scored below the threshold, as they are, whatever their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield piece.filter(pa.array(_judge(piece["text"], chain)[0] < threshold))

    return arrow(docs).mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out: its row has no label to learn from, and is scored like any other."""
    docs = read(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.begin, s.end)), ",").alias("spans"))
