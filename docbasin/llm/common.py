"""Helpers that several operators of this subpackage share: Arrow batches in bounded pieces, and vectorised word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one piece of a batch may hold; a single longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and Python: its buffers stay allocated on both sides, so few rows of long texts.
BATCH_ROWS = 300


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow(df: DataFrame) -> DataFrame:
    """`df`, about to go to Python: from here on its session's Arrow batches have at most BATCH_ROWS rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` again, in batches of at most `limit` bytes of the column `text` and at most `rows` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.nan_to_num(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        begin, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > limit or i - begin >= rows:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)
    trim()


def trim() -> None:
    """Gives memory that nothing uses back to the system: workers wait idle between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int, rows: int) -> Iterator[pa.RecordBatch]:
    """`pieces`, but small batches are put together up to the limits."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for piece in pieces(batches, text, limit, rows):
        own = pc.sum(pc.binary_length(piece[text])).as_py() or 0
        if held and (size + own > limit or n + piece.num_rows > rows):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, n = [], 0, 0
        held, size, n = [*held, piece], size + own, n + piece.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Bytes as they are, but for white space (9 to 13), which becomes a blank; and with A-Z lower-cased too.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_BLANKS_LOWER = bytes(b + 32 if 65 <= b <= 90 else _BLANKS[b] for b in range(256))


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    r"""Words `[^\x20\x09-\x0D]+` of texts, with A-Z lower-cased if `lower`: words per text, each word's index in the dictionary, the dictionary.

    None of these bytes is part of a longer character in UTF-8, so the bytes of all texts are translated at once.
    """
    whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    _, offsets, data = whole.buffers()
    data = (data.to_pybytes() if data else b"").translate(_BLANKS_LOWER if lower else _BLANKS)
    split = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, pa.py_buffer(data)], offset=whole.offset), " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return (before[offsets[1:]] - before[offsets[:-1]]).astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """split_words, lower-cased."""
    return split_words(texts, True)


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same on every machine: of each byte with its place, summed by string, and of the length."""
    whole = pa.concat_arrays([dictionary.cast(pa.large_string())])
    if not len(whole):
        return np.zeros(0, np.uint64)
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    size = np.diff(ends)
    letters = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    begin = ends[:-1] - ends[0]
    place = (np.arange(len(letters)) - np.repeat(begin, size)).astype(np.uint64)
    sums, some = np.zeros(len(whole), np.uint64), size > 0
    if len(letters):
        sums[some] = np.add.reduceat(mix((place << np.uint64(8) | letters) + np.uint64(1)), begin[some])
    return mix(sums + mix(size.astype(np.uint64) + np.uint64(1 << 40)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the cluster's spark.checkpoint.dir. Only a local master does without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage is cut, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name`, a number for each row. The table is written once, so a row keeps its number however often it is read."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def bitmap(ids: DataFrame) -> DataFrame:
    """ids (one column, whole numbers) -> word, held: a bit for each id in words of 64. Ids that lie close, as row numbers do, share words."""
    at = F.col(ids.columns[0]).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return ids.where(at.isNotNull()).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("held"))


def among(rows: DataFrame, column: str, ids: DataFrame, most: int, *, others: bool = False) -> DataFrame:
    """Rows whose `column` is among `ids` (one column, whole numbers); with `others` those whose `column` isn't.

    Up to `most` words of the ids' bitmap are broadcast, so the driver holds a few words for many ids; else the ids are joined by a shuffle.
    """
    words = bitmap(ids)
    if words.limit(most + 1).count() > most:
        return rows.join(ids.toDF(column), column, "left_anti" if others else "left_semi")
    words = words.toDF("word of the ids", "ids of the word")  # names that no table of texts has
    at = F.col(column).cast("long")
    met = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("word of the ids"), "left" if others else "inner")
    bit = F.coalesce(F.getbit("ids of the word", at.bitwiseAND(F.lit(63)).cast("int")), F.lit(0))
    return met.where(bit == F.lit(0 if others else 1)).drop("word of the ids", "ids of the word")
