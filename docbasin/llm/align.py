"""Alignment of two tokenizers' tokens over the same bytes: groups between common token ends, and links of overlapping tokens.

Python tokenises with a byte-level BPE (A) over a blank and the text and a sentence-piece model (B) over the text, to which
it adds the blank itself. Neither has a token that reaches over a blank between two visible characters, so a text is cut
there (`apart` looks whether the two models allow that), and each different word of a piece of the table is tokenised and
aligned once: both sides' tokens end where a word ends, so a text's groups and links are its words', one after the other.

* offsets where both sides' tokens end cut the tokens into groups;
* the union of the ends cuts the bytes into segments that belong to one A and one B token each, and two tokens that
  overlap share exactly one segment, so the segments are the links, each once.

From there on links are rows. An id pair's count is the number of texts that hold it linked. Pairs with a count of at least
1 / HOT_SHARE of all counts are at most HOT_SHARE, so they are broadcast and the frequent keys never meet in one task; the
links of rarer pairs are shuffled by pair. The largest count of each A id is a row for each entry of A's vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, gathered, read, stored

#: The least share of all counts, as its inverse, from which a pair is looked up in a broadcast table (24 bytes a pair).
HOT_SHARE = 100_000
#: Bytes of text whose different words are aligned at once, words that a tokenizer takes at once, and rows of a batch of results.
PIECE_BYTES, AT_ONCE, OUT_ROWS = 1 << 22, 2000, 300
ROW = "row number of the alignment"
ALIGNED = f"`{ROW}` long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<bigint>"


def byte_values() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: visible Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """The tokenizer of a tokenizers JSON, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    values = byte_values()
    table = {i: bytes(values[c] for c in entry) if all(c in values for c in entry) else entry.encode() for entry, i in model.get_vocab().items()}
    return model, [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=2)
def sentence_piece(path: str):
    """The processor of a sentence-piece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def own(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    return model, [own(model.id_to_piece(i)) for i in range(model.get_piece_size())]


def vocabulary_size(path_b: str) -> int:
    return len(sentence_piece(path_b)[1])


@lru_cache(maxsize=2)
def apart(path_a: str, path_b: str) -> bool:
    """Whether texts may be cut before a blank between visible characters: A splits words by its usual pattern, and B takes texts
    as they are and has no piece with a blank behind another character."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path_a) as file:
        a = json.load(file)
    b = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as file:
        b.ParseFromString(file.read())
    split = a["pre_tokenizer"] or {}
    plain_a = a["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and all(t["special"] for t in a["added_tokens"])
    rules = b.normalizer_spec
    plain_b = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces and b.trainer_spec.model_type == b.trainer_spec.BPE
    return plain_a and plain_b and not any(x.type == x.USER_DEFINED or re.search("[^▁]▁", x.piece) for x in b.pieces)


def words(texts: pa.Array, cut: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A blank and each text, cut into words: words per text (0 of a null or empty text), each word's index in the dictionary, the dictionary."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    some = pc.greater(pc.binary_length(texts), 0)
    whole = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(some), pa.scalar("", pa.large_string()))])
    if not len(whole):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), whole
    _, offsets, data = whole.buffers()
    own = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    letters = np.frombuffer(data, np.uint8)[: own[-1]]
    begins = np.zeros(len(letters), bool)
    if cut:  # a blank after a visible ASCII character and before what is no blank or control character
        begins[1:-1] = (letters[1:-1] == 32) & (letters[:-2] > 32) & (letters[:-2] < 127) & (letters[2:] > 32)
    begins[own[:-1]] = True
    at = np.flatnonzero(begins)
    coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, own[-1])), data).dictionary_encode()
    per_text = np.zeros(len(texts), np.int64)
    per_text[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(at, own))
    return per_text, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(_before(sizes)), values)


def _before(sizes: np.ndarray) -> np.ndarray:
    """How many there are before each, and in all."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _joined(sizes: np.ndarray, values: pa.Array, by: str) -> pa.Array:
    """The next `sizes` of the strings, joined."""
    return pc.binary_join(_lists(sizes, values), pa.scalar(by, pa.large_string()))


def _encoded(dictionary: pa.Array, encode: Callable[[list[str]], Iterable[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per word, and all ids."""
    counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for i in range(0, len(dictionary), AT_ONCE):
        own = list(encode(dictionary.slice(i, AT_ONCE).to_pylist()))
        counts.append(np.fromiter(map(len, own), np.int64, len(own)))
        ids.append(np.fromiter(chain.from_iterable(own), np.int32, int(counts[-1].sum())))
    return np.concatenate(counts), np.concatenate(ids)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each begin on, as many as its size."""
    return np.repeat(begin - _before(size)[:-1], size) + np.arange(size.sum())


def _given_back(dictionary: pa.Array, counts: np.ndarray, ids: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Whether each word's tokens are joined to its bytes."""
    size, begin = np.array([len(x) for x in table], np.int64), _before([len(x) for x in table])
    letters, own = np.frombuffer(dictionary.buffers()[2] or b"", np.uint8), pc.binary_length(dictionary).to_numpy()
    good = np.diff(_before(size[ids])[_before(counts)]) == own
    mine = ids[np.repeat(good, counts)]
    written = np.frombuffer(b"".join(table), np.uint8)[_spread(begin[mine], size[mine])]
    word = np.repeat(np.flatnonzero(good), own[good])
    good[word[written != letters[: own.sum()][np.repeat(good, own)]]] = False
    return good


def _word_by_word(dictionary: pa.Array, path_a: str, path_b: str) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array, np.ndarray]:
    """Words -> whether both sides give them back, what they have of n_a, n_b, n_groups and n_links, their groups as text, and all their links in turn."""
    (a, a_bytes), (b, b_bytes) = byte_level(path_a), sentence_piece(path_b)
    dictionary = pa.concat_arrays([dictionary])
    found = {
        "a": _encoded(dictionary, lambda some: (e.ids for e in a.encode_batch_fast(some, add_special_tokens=False))),
        "b": _encoded(dictionary, lambda some: b.encode([w[1:] for w in some], num_threads=1)),
    }
    good = _given_back(dictionary, *found["a"], a_bytes) & _given_back(dictionary, *found["b"], b_bytes)
    size = np.where(good, pc.binary_length(dictionary).to_numpy(), 0)
    ids, ends, marks, counts = {}, {}, {}, {}
    for side, table in (("a", a_bytes), ("b", b_bytes)):
        n, of = found[side]
        counts[f"n_{side}"], ids[side] = np.where(good, n, 0), of[np.repeat(good, n)]
        ends[side] = np.cumsum(np.array([len(x) for x in table], np.int64)[ids[side]])
        marks[side] = np.zeros(int(size.sum()) + 1, bool)
        marks[side][ends[side]] = True
    cuts, segments = np.flatnonzero(marks["a"] & marks["b"]), np.flatnonzero(marks["a"] | marks["b"])
    token = {s: ids[s][np.searchsorted(ends[s], segments)].astype(np.int64) for s in "ab"}
    last = _before(size)  # where words end: a word's cuts and segments end after its first byte, up to its last
    counts |= {n: np.diff(np.searchsorted(x, last, "right")) for n, x in (("n_groups", cuts), ("n_links", segments))}
    sides = [_joined(np.diff(np.searchsorted(ends[s], cuts, "right"), prepend=0), pa.array(ids[s]).cast(pa.large_string()), ",") for s in "ab"]
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    return good, counts, _joined(counts["n_groups"], groups, ";"), token["a"] * len(b_bytes) + token["b"]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (ROW, text) -> ROW, n_a, n_b, n_groups, groups_sha256, links: pairs as a * b_size + b, one for each overlapping pair of tokens.

    A null or empty text, and one that either side's tokens don't give back byte by byte, has no tokens: zeros, '' and no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", PIECE_BYTES, 1 << 30):
            per_text, codes, dictionary = words(batch["text"], apart(path_a, path_b))
            good, counts, groups, links = _word_by_word(dictionary, path_a, path_b)
            first = _before(per_text)
            whole = np.diff(_before(~good[codes])[first]) == 0  # all of a text's words are given back
            codes, per_text = codes[np.repeat(whole, per_text)], np.where(whole, per_text, 0)
            first = _before(per_text)
            n = {name: x[codes] for name, x in counts.items()}
            sums = [pa.array(np.diff(_before(n[name])[first])) for name in ("n_a", "n_b", "n_groups")]
            begin, place = _before(counts["n_links"])[:-1][codes], _before(n["n_links"])
            for i in range(0, len(batch), OUT_ROWS):
                j = min(i + OUT_ROWS, len(batch))
                here = slice(first[i], first[j])
                own = n["n_links"][here]
                each = links[_spread(begin[here], own)]
                held = pa.ListArray.from_arrays(pa.array((place[first[i : j + 1]] - place[first[i]]).astype(np.int32)), pa.array(each))
                written = _joined(per_text[i:j], groups.take(pa.array(codes[here])), ";").to_pylist()
                digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in written], pa.string())
                yield pa.RecordBatch.from_arrays([batch[ROW][i:j], *(x[i:j] for x in sums), digests, held], names=[ROW, "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return arrow(docs.select(ROW, "text")).mapInArrow(run, ALIGNED)


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """links (links) -> pair, count (texts that hold it), best (whether no pair of its A id has a larger count)."""
    counts = stored(links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    own = F.floor(F.col("pair") / b_size).cast("int")
    largest = counts.groupBy(own.alias("a_id")).agg(F.max("count").alias("largest"))  # a row for each entry of A's vocabulary at most
    return counts.withColumn("a_id", own).join(F.broadcast(largest), "a_id").select("pair", "count", (F.col("count") == F.col("largest")).cast("long").alias("best"))


def link_sums(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links (ROW, links), pairs -> ROW, n_best, count_sum, for rows with links."""
    total = pairs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).first().total
    hot = F.col("count") * HOT_SHARE >= total
    each = links.select(ROW, F.explode("links").alias("pair"))
    often = each.join(F.broadcast(pairs.where(hot)), "pair")  # at most HOT_SHARE rows
    rare = each.join(F.broadcast(pairs.where(hot).select("pair")), "pair", "left_anti").join(pairs.where(~hot), "pair")
    return often.unionByName(rare).groupBy(ROW).agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row of `docs`.

    Texts that are null, empty or not given back by either tokenizer have zeros and ''. Rows are counted by themselves:
    repeated rows and rows with a null doc_id each count as a text. Other columns are ignored.
    """
    b_size = vocabulary_size(path_b)
    placed = docs.select("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id())
    ids = stored(placed.select(ROW, "doc_id"), "alignment-ids")
    found = stored(aligned(placed, path_a, path_b), "alignment").withColumn("n_links", F.size("links").cast("long"))
    sums = link_sums(found, stored(pair_counts(found, b_size), "alignment-pairs"))
    out = ids.join(found.drop("links"), ROW).join(sums, ROW, "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
