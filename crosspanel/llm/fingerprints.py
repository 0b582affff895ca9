"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white space folded to one
space. Its fingerprint is the 128-bit xxhash of that form; texts whose hashes agree are compared
byte by byte, and should their bytes differ, all but the first get a number after the hash.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import bit_position, bit_set, in_small_batches, membership_bitmap, written

Digest = Callable[[bytes], str]


def canonical(text: str | None) -> bytes:
    """The canonical bytes of a text; null counts as empty."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFKC", text.casefold())
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def xxh128(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def compared(docs: DataFrame, digested: DataFrame, digest: Digest = xxh128) -> DataFrame:
    """Compare bytes inside equal buckets. ``digested``: doc_id and digest of every row of
    ``docs``. Returns doc_id, digest, fingerprint of the rows whose digest is shared by texts
    that differ: none, unless the hash collides.

    Only texts of buckets with two rows or more are grouped; a bitmap of fixed size sorts out the
    rest ahead of the shuffle, and copies meet in the partial aggregate already.
    """
    shared = digested.groupBy("digest").count().where("count > 1").select("digest")
    bitmap = docs.sparkSession.sparkContext.broadcast(membership_bitmap(shared, "digest"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(m) for m in made], pa.string()), pa.array(made, pa.binary())], names=["doc_id", "digest", "form"])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy(zero_copy_only=False)
            yield batch.select([0, 1, 2]).filter(pa.array(bit_set(bitmap.value, at)))

    formed = docs.select("doc_id", "text").mapInArrow(forms, f"doc_id {id_type}, digest string, form binary")
    bits = int(len(bitmap.value) * 8).bit_length() - 1
    held = formed.withColumn("at", bit_position("digest", bits)).mapInArrow(suspects, f"doc_id {id_type}, digest string, form binary")
    variants = held.groupBy("digest", "form").agg(F.count("*").alias("copies"))
    several = written(variants.groupBy("digest").count().where("count > 1").select("digest"), "collisions")
    numbered = variants.join(several, "digest", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    if several.isEmpty():
        return digested.sparkSession.createDataFrame([], f"doc_id {id_type}, digest string, fingerprint string")
    told = held.join(several, "digest", "left_semi").join(numbered, ["digest", "form"])
    return told.select("doc_id", "digest", F.when(F.col("nth") > 0, F.concat_ws("-", "digest", "nth")).otherwise(F.col("digest")).alias("fingerprint")).distinct()


def _fingerprinted(docs: DataFrame, rows: DataFrame, digest: Digest) -> DataFrame:
    apart = compared(docs, rows.select("doc_id", "digest"), digest)
    if apart.isEmpty():
        return rows.withColumn("fingerprint", F.col("digest"))
    return rows.join(apart, ["doc_id", "digest"], "left").withColumn("fingerprint", F.coalesce("fingerprint", "digest"))


def fingerprint_documents(docs: DataFrame, digest: Digest = xxh128) -> DataFrame:
    """doc_id, fingerprint and copies (rows with that fingerprint) of every whole text.

    Null and empty texts share the fingerprint of the empty string; repeated rows each get a row;
    an empty table gives none; other columns are not read.
    """
    in_small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "digest"])

    rows = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, digest string"), "digests")
    made = _fingerprinted(docs, rows, digest)
    copies = made.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    return made.join(copies, "fingerprint").select("doc_id", "fingerprint", "copies")


_ROW = "n_chars bigint, edited_sha256 string, digest string, edited_fingerprint string, near_edited double, near_next double"


def _judged(text: str, following: str, form: bytes, next_form: bytes, digest: Digest) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + following[: n // 2]
    edited_form = canonical(edited)
    return n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), digest(form), digest(edited_form), float(form == edited_form), float(form == next_form)


def edited_fingerprints(docs: DataFrame, digest: Digest = xxh128) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last half is replaced by
    the start of the next document's text (by ascending doc_id; after the last, the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null texts count as empty; repeated rows each get a row and follow each other, in
    no set order; an empty table gives no rows; a single document follows itself. Texts of any length
    are read whole; columns other than doc_id and text, whatever their names, are not read.

    Documents are dealt by ranges of doc_id, one shuffle of the texts; a task walks its range in
    order and holds two texts at a time. The last document of a range meets the first of the next
    in a join of as many rows as there are ranges.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # the row number splits a doc_id that very many rows share over several ranges
    ranged = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    names = ["kind", "part", "doc_id", "text", "n_chars", "edited_sha256", "digest", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int32(), pa.int32(), None, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple | None = None
        for batch in batches:
            types[2] = batch.schema.field(0).type
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""  # noqa: PLW2901
                form = canonical(text)
                if held is None:
                    out.append((1, part, doc_id, text, *[None] * 6))  # the first of the range
                else:
                    out.append((0, part, held[0], None, *_judged(held[1], text, held[2], form, digest)))
                held = doc_id, text, form
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((2, part, held[0], held[1], *[None] * 6), types, strict=True)], names=names)

    walked = written(ranged.mapInArrow(walk, f"kind int, part int, doc_id {id_type}, text string, {_ROW}"), "walked")
    # part numbers follow the order of the ranges; there are as many as shuffle partitions at most
    parts = sorted(r.part for r in walked.where("kind = 1").select("part").collect())
    turn = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    heads = walked.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    borders = walked.where("kind = 2").select("part", "doc_id", "text").join(turn, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_judged(a, b, canonical(a), canonical(b), digest) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[4:], strict=True)] if out else [pa.array([], t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names[4:]])

    rows = walked.where("kind = 0").select("doc_id", *names[4:]).unionByName(borders.mapInArrow(close, f"doc_id {id_type}, {_ROW}"))
    return _fingerprinted(docs, rows, digest).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
