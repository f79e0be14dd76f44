"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model interpolates bigrams with the smoothed unigrams:
P(w|v) = (1 - b(v)) c(vw) / c(v) + b(v) (c(w) + 0.1) / (N + 0.1 (V + 1)), b(v) = FLOOR + (1 - FLOOR) HALF / (HALF + c(v)),
where v is the word before (a start mark at a text's first word) and each text ends with an end token. It sums to one
over the V words and the unknown one for every v, as unknown words have no bigrams.

Word counts are summed by a shuffle of distinct words per piece of text. Each piece then looks up its words' counts: in a
broadcast table while the vocabulary is below a bound, else by a join on the piece's own words. The distinct bigrams of
a piece are dealt to shards by a hash of the pair, so a word that follows or precedes many others is spread over all
shards; a bigram carries its quantised unigram probability and context count and the texts it is in. Each shard counts
the training bigrams, builds its part of the trie, looks up all bigrams and returns sums per text.

A shard's trie: the contexts (32-bit hashes of words) in Elias-Fano code, with monotone pointers (Elias-Fano) to the
ranges of their successors; successors (32 more bits) relative to their context's place in the level, in Elias-Fano code
again, so that one search in the packed bits finds a successor inside its context's range; quantised smoothed
probabilities. The levels are a task's own scratch: a file that is mapped into memory and has no name from the start.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, gathered, hash_words, mix, pieces, read, stored, words

FLOOR, HALF = 0.3, 2.0
#: Distinct words up to which the table of counts (12 bytes each) is broadcast.
BROADCAST_WORDS = 8_000_000
PIECE, SHARD_BYTES, ROWS = 6 << 20, 32 << 20, 60_000
#: Bits of a bigram's context and of its successor (hashes); steps of a factor of ten in its two codes of 12 bits, -log10 P(w) and log10 c(v).
HALF_BITS, STEPS = 32, 370.0
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def _packed(unary: np.ndarray) -> np.ndarray:
    """Bits, the first lowest, in 64-bit words."""
    packed = np.packbits(unary, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in each word its set bit number `rank` is."""
    at = np.zeros(len(word), np.int64)
    rank = rank.copy()
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
        up = rank >= below
        rank -= np.where(up, below, 0)
        word = np.where(up, word >> np.uint64(half), word)
        at += half * up
    return at


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; a directory counts the bits before each word of the latter."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.cumsum(np.bitwise_count(high), dtype=np.int64).astype(np.uint32)
        self.zeros = (np.arange(1, len(high) + 1, dtype=np.int64) * 64 - self.ones).astype(np.uint32)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((universe >> low_bits) + n + 1, np.uint8)
        unary[at] = 1
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            part, shift = v & np.uint64((1 << low_bits) - 1), bit & np.uint64(63)
            word = (bit >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift > np.uint64(64 - low_bits)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return n, low_bits, low, _packed(unary)

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Place of set (or unset) bit number i of the high part."""
        counts = self.ones if ones else self.zeros
        word = np.searchsorted(counts, i.astype(np.uint32), side="right")
        before = np.where(word > 0, counts[word - 1], 0).astype(np.int64)
        bits = self.high[word] if ones else ~self.high[word]
        return word * 64 + _in_word(bits, i - before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = self.low[word] >> shift
        over = shift > np.uint64(64 - self.low_bits)
        part[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return part & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x (up to the universe) the first place with a value of x or more, n if there is none.

        The zeros of the high part bound the values with x's high bits; among these few the low bits are searched.
        """
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        hi = self._select(high, False) - high
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                return lo
            mid = (lo[on] + hi[on]) >> 1
            less = self._low(mid) < low[on]
            lo[on], hi[on] = np.where(less, mid + 1, lo[on]), np.where(less, hi[on], mid)


class Trie:
    """Two levels over hashed contexts and successors. Built from distinct sorted keys and a probability for each."""

    def __init__(self, keys: np.ndarray, log10: np.ndarray):
        context = keys >> np.uint64(HALF_BITS)
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(begin), dtype=np.uint64), np.diff(np.append(begin, len(keys))))
        relative = place << np.uint64(HALF_BITS) | keys & np.uint64((1 << HALF_BITS) - 1)
        levels = [EliasFano.encode(context[begin], 1 << HALF_BITS), EliasFano.encode(np.append(begin, len(keys)), len(keys) + 1), EliasFano.encode(relative, max(len(begin), 1) << HALF_BITS)]
        codes = np.clip(np.round(-log10 * 4096), 0, 65535).astype(np.uint16)
        arrays = [a for level in levels for a in level[2:]] + [codes]
        with tempfile.TemporaryFile() as f:  # unlinked from the start
            for a in arrays:
                f.write(a.tobytes() + bytes(-a.nbytes % 8))
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
        at, back = 0, []
        for a in arrays:
            back.append(np.frombuffer(mapped, a.dtype, len(a), at))
            at += a.nbytes + -a.nbytes % 8
        self.contexts, self.pointers, self.successors = (EliasFano(*level[:2], *back[2 * k : 2 * k + 2]) for k, level in enumerate(levels))
        self.codes = back[6]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Quantised log10 of (1 - b(v)) c(vw) / c(v), -inf where the trie has no such bigram."""
        out = np.full(len(keys), -np.inf)
        asked = keys >> np.uint64(HALF_BITS)
        place = self.contexts.successor(asked)
        known = np.flatnonzero(place < self.contexts.n)
        known = known[self.contexts.access(place[known]) == asked[known]]
        place = place[known]
        relative = place.astype(np.uint64) << np.uint64(HALF_BITS) | keys[known] & np.uint64((1 << HALF_BITS) - 1)
        at = self.successors.successor(relative)
        begin, end = self.pointers.access(place).astype(np.int64), self.pointers.access(place + 1).astype(np.int64)
        there = np.flatnonzero((at >= begin) & (at < end))
        there = there[self.successors.access(at[there]) == relative[there]]
        out[known[there]] = self.codes[at[there]] / -4096.0
        return out


def backoff(count: np.ndarray) -> np.ndarray:
    return FLOOR + (1 - FLOOR) * HALF / (HALF + count)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of tokens (its words and an end), each token's and its predecessor's place in `table`, the table of hashes."""
    per, index, dictionary = words(texts)
    table = np.concatenate([hash_words(dictionary), [END, START]])
    n = per + 1
    last = np.cumsum(n) - 1
    token = np.full(int(n.sum()), len(dictionary), np.int64)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = index
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last - per] = len(dictionary) + 1
    return n, token, before, table


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> word (hash), n: how often each occurs; the start mark counts once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in gathered(batches, "text", PIECE, ROWS):
            n, token, _, table = tokens(piece["text"])
            count = np.bincount(token, minlength=len(table))
            count[-1] = len(n)
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(table[some].view(np.int64)), pa.array(count[some])], names=["word", "n"])

    return arrow(docs.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def looked_up(table: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of hashes, out of a sorted table; 0 for the unknown."""
    if not len(known):
        return np.zeros(len(table), np.int64)
    at = np.minimum(np.searchsorted(known, table), len(known) - 1)
    return np.where(known[at] == table, counts[at], 0).astype(np.int64)


def sorted_counts(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of a vocabulary that has been found to be small."""
    local = counts.toArrow()
    known, n = local["word"].to_numpy().view(np.uint64), local["n"].to_numpy().astype(np.uint32 if total < 1 << 32 else np.int64)
    del local
    order = np.argsort(known)
    return known[order], n[order]


PAYLOAD = "shard int, piece long, kind int, doc_ids binary, body binary, other binary"


def dealt(piece: int, texts: pa.Array, doc_ids: pa.Array, train: np.ndarray, find, total: int, distinct: int, shards: int) -> pa.RecordBatch:
    """The rows of one piece: kind 0 has the texts' own figures; kind 1, for each shard, its bigrams of training and of other texts."""
    n, token, before, table = tokens(texts)
    count = find(table)
    p = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
    begin = np.cumsum(n) - n
    figures = np.stack([n, np.add.reduceat(count[token] > 0, begin, dtype=np.int64)]) if len(n) else np.zeros((2, 0), np.int64)
    base = np.add.reduceat(p[token], begin) if len(n) else np.zeros(0)
    ids = doc_ids.cast(pa.int64())
    rows: list[tuple] = [(piece % shards, piece, 0, np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]).tobytes(), figures.tobytes(), base.tobytes())]
    pair = mix(table[before] + mix(table[token]))
    key = mix(table[before] + np.uint64(7)) >> np.uint64(HALF_BITS) << np.uint64(HALF_BITS) | pair >> np.uint64(HALF_BITS)
    shard = (pair & np.uint64(0xFFFFFFFF)) % np.uint64(shards)
    coded_p = np.clip(np.round(-p[token] * STEPS), 0, 4095).astype(np.uint32)
    coded_v = np.clip(np.round(np.log10(np.maximum(count[before], 1)) * STEPS) + (count[before] > 0), 0, 4095).astype(np.uint32)
    codes = coded_p << np.uint32(12) | coded_v
    doc = np.repeat(np.arange(len(n)), n)
    group = shard.astype(np.int64) * 2 + train[doc]
    order = np.lexsort((key, group))
    group, key, codes, doc = group[order], key[order], codes[order], doc[order].astype(np.uint16)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    cut = np.searchsorted(group, np.arange(2 * shards + 1))
    for s in range(shards):
        if cut[2 * s] == cut[2 * s + 2]:
            continue
        parts = []
        for a, b in ((cut[2 * s], cut[2 * s + 1]), (cut[2 * s + 1], cut[2 * s + 2])):
            at = np.flatnonzero(fresh[a:b])
            runs = np.diff(np.append(at, b - a)).astype(np.uint32)
            own = codes[a:b][at].view(np.uint8).reshape(-1, 4)[:, :3]
            parts.append(np.array([len(at)], np.uint64).tobytes() + key[a:b][at].tobytes() + runs.tobytes() + doc[a:b].tobytes() + own.tobytes())
        rows.append((s, piece, 1, None, *parts))
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.split()[0] for f in PAYLOAD.split(", ")])


def _parts(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, how often each occurs, the texts of all occurrences, the bigrams' codes."""
    n = int(np.frombuffer(body, np.uint64, 1)[0])
    end = len(body) - 3 * n
    codes = np.zeros((n, 4), np.uint8)
    codes[:, :3] = np.frombuffer(body, np.uint8, 3 * n, end).reshape(n, 3)
    return np.frombuffer(body, np.uint64, n, 8), np.frombuffer(body, np.uint32, n, 8 + 8 * n), np.frombuffer(body, np.uint16, (end - 8 - 12 * n) // 2, 8 + 12 * n), codes.reshape(-1).view(np.uint32)


def scored(table: pa.Table) -> pa.Table:
    """One shard: counts, trie, sums of log10 P per text of each piece. Rows of kind 0 pass through."""
    rows = table.to_pylist()
    mine = [r for r in rows if r["kind"] == 1]
    train = [_parts(r["other"]) for r in mine]
    everything, times, codes = (np.concatenate([t[k] for t in train]) if train else np.zeros(0, d) for k, d in ((0, np.uint64), (1, np.uint32), (3, np.uint32)))
    order = np.argsort(everything, kind="stable")
    everything, times = everything[order], times[order].astype(np.int64)
    fresh = np.ones(len(everything), bool)
    fresh[1:] = everything[1:] != everything[:-1]
    at = np.flatnonzero(fresh)
    counts = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
    keys, codes = everything[at], codes[order[at]]
    del everything, times, order, train

    def context_count(coded: np.ndarray) -> np.ndarray:
        coded = (coded & np.uint32(4095)).astype(np.int64)
        return np.where(coded > 0, 10.0 ** ((coded - 1) / STEPS), 0.0)

    seen = np.maximum(context_count(codes), 1)
    trie = Trie(keys, np.log10((1 - backoff(seen)) * counts / seen)) if len(keys) else None
    out = [(r["shard"], r["piece"], 0, r["doc_ids"], r["body"], r["other"]) for r in rows if r["kind"] == 0]
    for r in mine:
        sums: dict[int, float] = {}
        for key, runs, doc, own in (_parts(r["body"]), _parts(r["other"])):
            if not len(key):
                continue
            unigram = 10.0 ** ((own >> np.uint32(12)).astype(np.float64) / -STEPS)
            v = context_count(own)
            b = np.where(v > 0, backoff(v), 1.0)
            bigram = np.where(v > 0, 10.0 ** trie.log10(key), 0.0) if trie else 0.0
            value = np.log10(b * unigram + bigram)
            total = np.bincount(doc, weights=np.repeat(value, runs))
            for d in np.unique(doc):
                sums[int(d)] = float(total[d])
        out.append((r["shard"], r["piece"], 1, None, np.fromiter(sums, np.uint16, len(sums)).tobytes(), np.fromiter(sums.values(), np.float32, len(sums)).tobytes()))
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(table.schema.types)], names=table.schema.names)


def summed(table: pa.Table) -> pa.Table:
    """One piece: its texts' figures and the sums of all shards."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["shard"]))
    own = rows[0]
    ids = np.frombuffer(own["doc_ids"], np.int64).reshape(2, -1)
    figures, base = np.frombuffer(own["body"], np.int64).reshape(2, -1), np.frombuffer(own["other"], np.float64)
    score = np.zeros(len(base))
    for r in rows[1:]:
        score[np.frombuffer(r["body"], np.uint16)] += np.frombuffer(r["other"], np.float32)
    return pa.table([pa.array(ids[0], mask=ids[1] > 0), pa.array(figures[0]), pa.array(figures[1]), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, train: Column, *, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`docs` (doc_id, text), `train` (a condition on doc_id) -> doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end token only. Repeated rows count as often as they occur and get repeated results; a
    null doc_id is no training row and stays null. Other columns are ignored. Without training rows all counts are 0.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    train = F.coalesce(train, F.lit(False))
    counts = stored(word_counts(docs.where(train)), "word-counts")
    start = counts.where(F.col("word") == int(START.view(np.int64)))
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = start.agg(F.sum("n").alias("n")).first().n or 0
    total, distinct = (row.n or 0) - texts, row.v - bool(texts)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    flagged = docs.select("doc_id", "text", train.alias("train"))
    if row.v <= broadcast_words:
        shared = spark.sparkContext.broadcast(sorted_counts(counts, total))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 32
            for i, piece in enumerate(gathered(batches, "text", PIECE, ROWS)):
                yield dealt(first + i, piece["text"], piece["doc_id"], piece["train"].to_numpy(zero_copy_only=False).astype(np.int64), lambda t: looked_up(t, *shared.value), total, distinct, shards)

        bigrams = arrow(flagged).mapInArrow(deal, PAYLOAD)
    else:
        blocks = max(1, -(-size // PIECE))
        blocked = flagged.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

        def own_words(table: pa.Table) -> pa.Table:
            found = tokens(pa.concat_arrays(table["text"].chunks))[3]
            return pa.table([pa.array(np.full(len(found), table["block"][0].as_py())), pa.array(found.view(np.int64))], names=["block", "word"])

        def deal_block(left: pa.Table, right: pa.Table) -> pa.Table:
            known = right["word"].to_numpy().view(np.uint64)
            order = np.argsort(known)
            out = [dealt((int(left["block"][0].as_py()) << 24) + i, piece["text"], piece["doc_id"], piece["train"].to_numpy(zero_copy_only=False).astype(np.int64), lambda t: looked_up(t, known[order], right["n"].to_numpy()[order]), total, distinct, shards) for i, piece in enumerate(pieces(left.combine_chunks().to_batches(), limit=4 * PIECE, rows=ROWS))]
            return pa.Table.from_batches(out)

        answers = blocked.groupBy("block").applyInArrow(own_words, "block long, word long").join(counts, "word").select("block", "word", "n")
        bigrams = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(deal_block, PAYLOAD)
    sums = bigrams.groupBy("shard").applyInArrow(scored, PAYLOAD)
    final = sums.groupBy("piece").applyInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return final.withColumn("train_tokens", F.lit(total).cast("long"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: its row isn't learned from, isn't held out, and is scored like any other."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    return score(read(spark, sf_dir, "documents"), fold != 0).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
