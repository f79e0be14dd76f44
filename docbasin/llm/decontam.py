"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A test item is contained in a document if at least `percent` of its distinct word shingles occur there. Both sides have
MinHash signatures. An item's is a bottom-k sketch: its k shingles of least hash, k = n - needed + 1 + EXTRA. Items are
partitioned by size, the power of two of what they need; each partition has a threshold, the largest hash in its sketches.
A document's signature holds its shingles with hashes up to the largest threshold of the partitions that a set of its
size can contain, so it grows with the document, and a short item in a long document weighs as much as in a short one
(a signature of fixed size would lose it). A containing document lacks at most n - needed of an item's shingles, so of
the k in the sketch it has EXTRA + 1 or more, all of them in its signature: pairs with fewer collisions are dropped
and no containing document is lost. Candidates are confirmed by exact containment of the shingles themselves.

An item of fewer words than a shingle has one shingle, all its words, and is looked for among the documents' shingles of
that many words. The largest hash of many sketches prunes little, so a document's hashes are also held against a bitmap of
all sketches' low bits before they become rows: what no sketch holds goes there, and no collision does. The sketches are few
next to the documents. They are broadcast while their count is below a bound, else joined by a shuffle on the hash (adaptive
execution splits a frequent one); candidate ids likewise. Items' shingles are broadcast by a bound on their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import read, stored

#: Rows (of a few bytes each) up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of items' shingles up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Low bits of a hash by which documents' shingles are held against all sketches at once before they become rows.
MAX_BITS = 18
#: Shingles in an item's sketch beyond those of which a containing document has one at least.
EXTRA = 1


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def worded(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, text) -> key, words, for texts with words.

    The words pass through a generator, which the optimiser doesn't fold into what reads them: else a lambda over
    positions would split the text anew for each of them.
    """
    return rows.select(key, F.explode(F.array(normal_words(F.col("text")))).alias("words")).where(F.size("words") > 0)


def _starts(words: Column, size: int) -> Column:
    """Positions of shingles in a list of words; none if it is shorter than `size`."""
    n = F.size(words)
    return F.when(n < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - size))


def shingle_texts(words: Column, size: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, size), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " ")))


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each shingle, in the order of the text; the words are hashed one after the other."""
    return F.transform(_starts(words, size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def _part(shingles: Column) -> Column:
    return F.floor(F.log2(shingles)).cast("int")


def _few(df: DataFrame, size: Column | None = None) -> bool:
    """Whether a side may be broadcast: few rows of ids and hashes, or, with the size of each row, few bytes."""
    if size is None:
        return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (df.agg(F.sum(size).alias("bytes")).first().bytes or 0) <= BROADCAST_BYTES


def seen_bits(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """A bitmap of the low bits of `n` hashes, as a constant array of longs, and how many low bits it tells apart; MAX_BITS at most."""
    bits = min(max(12, (32 * n - 1).bit_length()), MAX_BITS)
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("held")).collect()  # 2 ** (MAX_BITS - 6) at most
    held = dict.fromkeys(range(1 << (bits - 6)), 0) | {r.word: r.held for r in words}
    return F.expr("array(" + ", ".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for _, v in sorted(held.items())) + ")"), bits


def sketches(items: DataFrame, size: int, percent: int) -> DataFrame:
    """items (item_id, words), of `size` words or more -> item_id, part, least, hash: a row for each value of each item's sketch."""
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), size))).alias("all"))
    needed = F.ceil(F.size("all") * percent / 100).cast("int")
    extra = F.least(needed - 1, F.lit(EXTRA))
    return hashed.select("item_id", _part(needed).alias("part"), (extra + 1).alias("least"), F.explode(F.slice("all", F.lit(1), F.size("all") - needed + 1 + extra)).alias("hash"))


def candidates(docs: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """docs (doc_id, words), items (item_id, words), of `size` words or more -> doc_id, item_id that collide often enough."""
    sketch = sketches(items, size, percent).distinct()
    most = {r.part: r.most for r in sketch.groupBy("part").agg(F.max("hash").alias("most")).collect()}  # 32 parts at most
    if not most:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id")
    parts = range(max(most) + 1)
    limits = [max((h for q, h in most.items() if q <= p), default=-(1 << 63)) for p in parts]
    part = _part(F.size("words") - (size - 1))
    limit = F.element_at(F.array(*map(F.lit, limits)), F.least(part, F.lit(max(parts))) + 1)
    bitmap, bits = seen_bits(sketch.select("hash").distinct(), sketch.select("hash").distinct().count())

    def may_meet(h: Column) -> Column:
        """Under the limit, and no sketch lacks its low bits."""
        word = F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
        return (h <= limit) & (F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1)

    signed = docs.where(F.size("words") >= size).select("doc_id", part.alias("size_part"), F.array_distinct(F.filter(shingle_hashes(F.col("words"), size), may_meet)).alias("signature"))
    probes = signed.select("doc_id", "size_part", F.explode("signature").alias("hash"))
    near = F.broadcast(sketch) if _few(sketch) else sketch
    met = probes.join(near, (probes.hash == near.hash) & (probes.size_part >= near.part))
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("collisions"), F.first("least").alias("least")).where("collisions >= least").select("doc_id", "item_id")


def contained(docs: DataFrame, items: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, n_shingles, n_shared: items contained in documents.

    Words are lower-cased runs of letters and digits. An item of fewer than `size` words has one shingle, all its words,
    and is found wherever these follow each other. Null and empty texts, and rows with a null id, are in no result.
    Repeated rows change nothing; of several texts with one id the best match counts. Other columns are ignored.
    """
    known = stored(worded(items.where("item_id is not null"), "item_id").distinct().withColumn("length", F.least(F.size("words"), F.lit(size))), "items")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # `size` at most
    out = None
    for length in lengths:
        mine = known.where(F.col("length") == length).select("item_id", "words")
        pairs = stored(candidates(worded(docs.where("doc_id is not null"), "doc_id"), mine, length, percent), "candidates")
        ids = pairs.select("doc_id").distinct()
        again = docs.select("doc_id", "text").join(F.broadcast(ids) if _few(pairs) else ids, "doc_id", "left_semi")
        shingled = worded(again, "doc_id").select("doc_id", shingle_texts(F.col("words"), length).alias("there"))
        wanted = mine.select("item_id", shingle_texts(F.col("words"), length).alias("all"))
        counts = [F.size("all").cast("long").alias("n_shingles"), F.size(F.array_intersect("all", "there")).cast("long").alias("n_shared")]
        few = _few(wanted, F.octet_length(F.array_join("all", "")) + 16 * F.size("all") + 64)
        checked = shingled.join(pairs, "doc_id").join(F.broadcast(wanted) if few else wanted, "item_id").select("doc_id", "item_id", *counts)
        held = checked.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
        out = held if out is None else out.unionByName(held)
    if out is None:
        return docs.join(known, F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return out.groupBy("doc_id", "item_id").agg(F.max_by("n_shingles", share).alias("n_shingles"), F.max_by("n_shared", share).alias("n_shared"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
bm as (select item_id, ws, least(len(ws), 5) as m from b where len(ws) > 0),
ds as (select doc_id, unnest(list_distinct(list_transform(range(0, len(ws) - m + 1), lambda i: array_to_string(ws[i+1:i+m], ' ')))) as g from d, (select distinct m from bm) where len(ws) >= m),
bs as (select item_id, unnest(list_distinct(list_transform(range(0, len(ws) - m + 1), lambda i: array_to_string(ws[i+1:i+m], ' ')))) as g from bm),
n as (select item_id, count(*)::bigint as n_shingles from bs group by 1)
select doc_id, item_id, n_shingles, count(*)::bigint as n_shared
from ds join bs using (g) join n using (item_id) group by 1, 2, 3 having count(*) * 100 >= n_shingles * 80
"""
