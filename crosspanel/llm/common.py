"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the control characters tab to carriage return.
WORD_GAP = rb"\x20\x09-\x0D"

#: Least and largest size of a membership bitmap, as powers of two of bits (8 KB and 16 MB).
BITMAP_BITS = (16, 27)

#: Bytes of an Arrow batch of texts, of which the JVM and the Python worker hold several copies at once.
BATCH_BYTES = 2 << 20
#: Bytes of a row group of written tables: what a task's writer holds in memory.
ROW_GROUP_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ``BATCH_BYTES``, unless the session sets a size of its own:
    by default a batch has up to 64 MB, which long texts fill."""
    if spark.conf.get(_BATCH_SETTING) == "67108864b":
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]

#: What a Python worker keeps between its tasks (tables of a tokenizer and words it has seen).
_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in a worker and kept until another operator runs there."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what a worker kept. A function of the module, so that tasks reach the worker's own
    ``_KEPT``: a closure that names it is sent with a copy."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # tokenizers refer to themselves
        give_back()


def trimming(run: Callable[[Batches], Batches], keeps: bool = False) -> Callable[[Batches], Batches]:
    """``run``, after which a task gives freed memory back to the system: Python workers stay alive
    between tasks, and beside the next stages would hold on to the most that any task needed.
    Operators that have nothing to keep (:func:`kept`) drop what earlier ones kept."""

    def trimmed(batches: Batches) -> Batches:
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    return trimmed


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where it names none, a temporary
    folder serves in local mode; a cluster without one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read instead of a re-run."""
    path = f"{shared_dir(df.sparkSession)}/crosspanel/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bit_position(key: Column | str, bits: int) -> Column:
    """Where a key stands in a membership bitmap of ``2**bits`` bits."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def membership_bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap in which each key of ``keys`` has set its bit, as bytes on the driver.

    There are eight bits or more for each key, but 16 MB at most whatever the data, so that it is
    safe to broadcast. A set bit may be shared by other keys: the bitmap only thins out rows ahead
    of an exact join.
    """
    bits = min(max(math.ceil(math.log2(8 * keys.count() + 1)), BITMAP_BITS[0]), BITMAP_BITS[1])
    return bitmap_at(keys.select(bit_position(key, bits).alias("at")), bits)


def bitmap_at(positions: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``2**bits`` bits in which the positions ``at`` are set."""
    block = 1 << 15
    # one task builds a block of 32768 bits, so that blocks are not shuffled in parts
    at = positions.select((F.col("at") / block).cast("int").alias("block"), F.pmod("at", F.lit(block)).cast("int").alias("bit"))
    parts = at.repartition("block").groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.collect():  # 2**bits / 8 bytes at most
        piece = np.frombuffer(bytes(row.bitmap), dtype=np.uint8)
        out[row.block * (block // 8) : row.block * (block // 8) + len(piece)] = piece
    return out


def bit_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the positions ``at`` are set."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marked(df: DataFrame, key: str, bitmap: np.ndarray) -> DataFrame:
    """Two columns: ``kept``, a struct of all columns of ``df``, whatever their names, and
    ``maybe``, which tells whether the key's bit is set; false for a null key."""
    bits, block = int(len(bitmap) * 8).bit_length() - 1, 1 << 15
    step = block // 8
    blocks = [(i, bytearray(bitmap[i * step : (i + 1) * step].tobytes())) for i in range(max(1, len(bitmap) // step))]
    table = df.sparkSession.createDataFrame(blocks, "block int, bytes binary")  # 16 MB at most
    at = bit_position(F.col("key"), bits)
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("kept"), F.col(f"`{key}`").alias("key")).withColumn("at", at).withColumn("block", (F.col("at") / block).cast("int"))
    byte = F.conv(F.hex(F.substring("bytes", (F.pmod(F.col("at"), F.lit(block)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("at"), F.lit(8)))), F.lit(2)) == 1
    return held.join(F.broadcast(table), "block").select("kept", (hit & F.col("key").isNotNull()).alias("maybe"))


def may_contain(df: DataFrame, key: str, bitmap: np.ndarray) -> DataFrame:
    """Rows of ``df`` whose key may be among the keys of the bitmap (never loses one that is)."""
    return marked(df, key, bitmap).where("maybe").select("kept.*")


def as_strings(column) -> list:  # noqa: ANN001
    """An Arrow column of texts as Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def gathered(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``blob[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return blob[:0]
    return blob[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
