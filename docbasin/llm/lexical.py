"""Ranked lexical search: a stored inverted index in shards, posting blocks of variable size, exact block-skipping search.

A shard holds some megabytes of texts: a row for each of its terms with the postings (document ordinals and frequencies),
and one row with the documents' ids and lengths. Shards are written where the texts are read, so indexing shuffles nothing.
Figures of the corpus (documents, words, document frequencies) are sums over the rows of the shards.

A search brings together what one shard holds of one block of queries: the posting lists of their terms, each with its
weight and the queries that ask for it. There

* dynamic programming cuts every posting list into blocks: of all ways to cut, the one with the least sum, over postings,
  of the block's largest score less the posting's own, where each block costs as much as BLOCK_COST top scores;
* a document's bound for a query is the sum of the largest scores of the blocks that reach over it. The documents of
  highest bound are scored first, and set the threshold: the k-th best score so far. Blocks that hold no document with a
  bound at or above it are skipped; the search ends when no such document is left, so the result is exact.

Scores are whole numbers, so ranks don't depend on the order in which shards are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbasin.llm.common import arrow, gathered, pieces, read, stored

#: Texts of a shard: bytes and documents at most (one longer text is a shard of its own).
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Most postings of a block, and what a block costs in top scores of its list.
BLOCK_POSTINGS, BLOCK_COST = 64, 4
#: Queries that are searched together in a shard.
BLOCK_QUERIES = 1000
#: Bytes of the queries' terms up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Documents that are scored first, for each document asked for; each further round takes ROUND times as many.
FIRST, ROUND = 8, 4
INDEX = "shard long, term string, n long, known long, total long, docs binary, tfs binary"
#: Bytes of terms as they are, A-Z lower-cased; all other ASCII ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def split_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of texts: how many each text has, each one's index in the dictionary, the dictionary. Null has none."""
    whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    _, offsets, data = whole.buffers()
    data = (data.to_pybytes() if data else b"").translate(_TERM_BYTES)
    split = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, pa.py_buffer(data)], offset=whole.offset), " ")
    flat, ends = split.flatten(), split.offsets.to_numpy()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    ends = ends - ends[0]
    return before[ends[1:]] - before[ends[:-1]], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _cut(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of numbers as binary values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The rows of a shard; documents are ordered by id (null last), those without terms are left out."""
    per_doc, codes, terms = split_terms(texts)
    nulls = np.asarray(pc.is_null(ids))
    numbers = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy()
    order = np.lexsort((numbers, nulls))
    order = order[per_doc[order] > 0]
    place = np.zeros(len(per_doc), np.int64)
    place[order] = np.arange(len(order))
    n = max(len(order), 1)
    keys, tfs = np.unique(codes * n + np.repeat(place, per_doc), return_counts=True)
    lists, per_list = np.unique(keys // n, return_counts=True)
    rows = len(lists) + 1
    known = int((~nulls[order]).sum())
    docs = pa.concat_arrays([_cut(numbers[order].astype(np.int64), np.array([len(order)])), _cut((keys % n).astype(np.int32), per_list)])
    counts = pa.concat_arrays([_cut(per_doc[order].astype(np.int64), np.array([len(order)])), _cut(tfs.astype(np.int32), per_list)])
    names = pa.concat_arrays([pa.array([None], pa.string()), terms.take(pa.array(lists)).cast(pa.string())])
    figures = [[len(order), *per_list.tolist()], [known] + [0] * len(lists), [int(per_doc.sum())] + [0] * len(lists)]
    return pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int64()), names, *(pa.array(x, pa.int64()) for x in figures), docs, counts], names=["shard", "term", "n", "known", "total", "docs", "tfs"])


def index(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text) -> the stored index, rows of INDEX. A row whose term is null has a shard's ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(gathered(batches, "text", SHARD_BYTES, SHARD_DOCS)):
            rows = shard_rows(first + k, batch["doc_id"], batch["text"])
            for at in range(0, rows.num_rows, 5000):
                yield rows.slice(at, 5000)

    return stored(arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, INDEX), "lexical-index")


def asked_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) -> item_id, term, each once; the texts of one item_id (null too) are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            per_item, codes, terms = split_terms(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(np.repeat(np.arange(len(per_item)), per_item))), terms.take(pa.array(codes)).cast(pa.string())], names=["item_id", "term"])

    return arrow(items.select(F.col("item_id").cast("long").alias("item_id"), "text")).mapInArrow(run, "item_id long, term string").distinct()


def _small(rows: DataFrame, size) -> bool:
    """Whether the sum of a size in bytes is within what may be broadcast."""
    return (rows.agg(F.sum(size).alias("bytes")).first().bytes or 0) <= BROADCAST_BYTES


def cut_blocks(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting lists' scores, one after the other, and their lengths -> last posting of each block, list of each block.

    best[j] = min over s of best[j - s] + cost + s * (largest of the last s scores): the sum of the postings' own scores is the
    same for every cut. All lists take their j-th step together.
    """
    order = np.argsort(-counts, kind="stable")
    sizes, begins = counts[order], (np.cumsum(counts) - counts)[order]
    top = np.maximum.reduceat(scores, np.cumsum(counts) - counts)[order] if len(scores) else np.zeros(0, np.int64)
    cost, span = BLOCK_COST * top, np.arange(1, BLOCK_POSTINGS + 1)
    never = np.int64(1) << 61
    largest = np.zeros((len(sizes), BLOCK_POSTINGS), np.int64)
    before = np.full((len(sizes), BLOCK_POSTINGS), never)
    before[:, 0] = 0
    chosen = np.zeros(len(scores), np.int64)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j, "left"))  # lists with more than j postings
        x = scores[begins[:live] + j]
        largest[:live, 1:] = largest[:live, :-1]
        largest[:live, 0] = 0
        np.maximum(largest[:live], x[:, None], out=largest[:live])
        total = before[:live] + largest[:live] * span
        pick = total.argmin(1)
        chosen[begins[:live] + j] = pick + 1
        before[:live, 1:] = before[:live, :-1]
        before[:live, 0] = total[np.arange(live), pick] + cost[:live]
    ends, at, which = [], begins + sizes - 1, np.arange(len(sizes))
    while len(at):
        ends.append((at, which))
        at = at - chosen[at]
        more = at >= begins[which]
        at, which = at[more], which[more]
    last, owner = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by_place = np.argsort(last)
    return last[by_place], order[owner][by_place]


def best_of(k: int, n: int, docs: np.ndarray, scores: np.ndarray, begin: np.ndarray, last: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of one query and their scores, from its blocks (first and last posting, largest score).

    docs and scores are the postings; documents are ordinals under n. Ties go to the lower ordinal.
    """
    first_doc, last_doc = docs[begin], docs[last]
    edges = np.bincount(first_doc, top, n + 1) - np.bincount(last_doc + 1, top, n + 1)
    bound = np.rint(np.cumsum(edges)[:n]).astype(np.int64)
    total, open_ = np.zeros(n, np.int64), bound > 0
    take, least = FIRST * k, 1
    while True:
        left = np.flatnonzero(open_ & (bound >= least))
        if not len(left):
            break
        now = left if len(left) <= take else left[np.argpartition(-bound[left], take)[:take]]
        mask = np.zeros(n, bool)
        mask[now] = True
        open_[now] = False
        reach = np.concatenate([[0], np.cumsum(mask)])
        hit = reach[last_doc + 1] > reach[first_doc]  # the other blocks are skipped
        sizes = last[hit] - begin[hit] + 1
        at = np.arange(int(sizes.sum())) + np.repeat(begin[hit] - (np.cumsum(sizes) - sizes), sizes)
        at = at[mask[docs[at]]]
        total += np.rint(np.bincount(docs[at], scores[at], n)).astype(np.int64)
        if np.count_nonzero(total) >= k:
            least = max(1, int(np.partition(total, n - k)[n - k]))
        take *= ROUND
    found = np.flatnonzero(total >= least)
    found = found[np.lexsort((found, -total[found]))][:k]
    return found, total[found]


def search_shard(rows: pa.Table, k: int, documents: int, words: int) -> pa.Table:
    """What a shard holds of a block of queries -> item_id, doc_id, score: the k best of each query in the shard."""
    rows = rows.combine_chunks()
    terms = rows["term"]
    head = rows.filter(pc.is_null(terms))
    lists = rows.filter(pc.and_(pc.is_valid(terms), pc.greater(rows["w"], 0)))
    out = ([], [], [])
    if lists.num_rows and head.num_rows:
        ids, lengths = (np.frombuffer(head[c][0].as_py(), np.int64) for c in ("docs", "tfs"))
        known, n = head["known"][0].as_py(), len(ids)
        m = 10 + (90 * lengths * documents) // words
        counts = lists["n"].to_numpy().astype(np.int64)
        docs = np.frombuffer(b"".join(lists["docs"].to_pylist()), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(lists["tfs"].to_pylist()), np.int32).astype(np.int64)
        scores = np.repeat(lists["w"].to_numpy(), counts) * ((10**9 * tf) // (1000 * tf + 8 * m[docs]))
        last, owner = cut_blocks(scores, counts)
        begin = np.concatenate([[0], last[:-1] + 1])
        top = np.maximum.reduceat(scores, begin)
        blocks = np.searchsorted(owner, np.arange(len(counts) + 1))
        asked = lists["items"].combine_chunks()
        items = asked.flatten().field("item_id")
        of_list = np.repeat(np.arange(len(counts)), np.asarray(pc.list_value_length(asked)))
        codes = items.dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy(zero_copy_only=False)
        by_item = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by_item], np.arange(len(codes.dictionary) + 1))
        for i, item in enumerate(codes.dictionary.to_pylist()):
            own = of_list[by_item[cuts[i] : cuts[i + 1]]]
            mine = np.concatenate([np.arange(blocks[x], blocks[x + 1]) for x in own])
            found, total = best_of(k, n, docs, scores, begin[mine], last[mine], top[mine])
            out[0].extend([item] * len(found))
            out[1].extend(int(ids[d]) if d < known else None for d in found)
            out[2].extend(total.tolist())
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("item_id", "doc_id", "score"), out, strict=True)})


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """index(), items (item_id, text) -> item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0.

    A document without terms (null, empty, punctuation) is not counted. Each row is a document: repeated rows are ranked
    beside each other, and a null doc_id comes last among equal scores. An item without terms finds nothing. Other columns
    of the tables are ignored.
    """
    spark = index.sparkSession
    figures = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("total"), F.lit(0)).alias("words")).first()
    documents, words = int(figures.documents), int(figures.words)
    schema = "item_id long, doc_id long, score long"
    asked = stored(asked_terms(items), "lexical-terms")
    if not words:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    terms = asked.select("term").distinct()
    few = _small(terms, F.octet_length("term") + 64)
    frequency = index.where("term is not null").select("term", "n").join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    n_items = asked.select("item_id").distinct().count()
    blocks = -(-max(n_items, 1) // BLOCK_QUERIES)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    lists = asked.join(frequency.select("term", weight.alias("w")), "term").groupBy(block.alias("block"), "term", "w").agg(F.collect_list(F.struct("item_id")).alias("items"))
    lists = stored(lists, "lexical-lists")  # an array holds a block's items at most
    near = F.broadcast(lists) if _small(lists, F.octet_length("term") + 32 * F.size("items") + 64) else lists
    met = index.where("term is not null").join(near, "term")
    heads = index.where("term is null").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select("*", F.lit(0).cast("long").alias("w"), F.array().cast("array<struct<item_id:bigint>>").alias("items"))
    both = met.unionByName(heads)
    found = both.groupBy("shard", "block").applyInArrow(lambda t: search_shard(t, k, documents, words), schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with q as (select distinct item_id, unnest({_SPLIT}) as term from benchmark),
d as (select row_number() over () as r, doc_id, {_SPLIT} as ts from documents),
st as (select count(*)::bigint as nn, sum(len(ts))::bigint as ll from d where len(ts) > 0),
p as (select r, doc_id, len(ts)::bigint as n, unnest(ts) as term from d where len(ts) > 0),
tf as (select r, doc_id, n, term, count(*)::bigint as tf from p where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf cross join st group by term, nn),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score from tf join w using (term) join q using (term) cross join st group by item_id, r, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify rank <= 10
"""
