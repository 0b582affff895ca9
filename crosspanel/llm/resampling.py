"""Importance resampling towards a target distribution, in DataFrame functions only.

Every text is exploded into its runs of one to ``n`` words, each run falls into a bucket by its
crc32, and grouped counts of the corpus and of the target give each bucket a gain, the logarithm of
how much likelier it is in the target. A document's weight is the sum of its runs' gains; Gumbel
noise drawn from its id turns the highest sums into a sample without replacement. Ranks come from a
distributed sort: ranges of scores are numbered within, and shifted by what the ranges before hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import written

#: Runs of digits, letters a to z and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sort key that sets apart the ranges of the distributed sort.
_RANGE = "range"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def bucketed(texts: DataFrame, words: str, n: int, buckets: int, *keys: str) -> DataFrame:
    """A row (``keys``, bucket) for each run of one to ``n`` words of the array column ``words``; one
    with a null bucket for runs that would pass the end, and for a text without words."""
    shifted = [F.slice(F.col(words), i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(n)]
    runs = texts.select(*keys, F.inline_outer(F.arrays_zip(*shifted)))
    bucket = lambda i: F.pmod(F.crc32(F.concat_ws(" ", *[F.col(f"w{j}") for j in range(i + 1)])), F.lit(buckets))
    return runs.select(*keys, F.explode(F.array(*[F.when(F.col(f"w{i}").isNotNull(), bucket(i)) for i in range(n)])).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", n: int = 3, buckets: int = 10_000) -> DataFrame:
    """The ``buckets`` rows (bucket, gain), in thousandths of a natural logarithm, add-one smoothed."""
    counted = [
        bucketed(df.select(words(F.col(f"`{text}`")).alias("words")), "words", n, buckets).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))
        for df, name in ((docs, "corpus"), (target, "wanted"))
    ]
    table = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counted[0], "bucket", "left").join(counted[1], "bucket", "left").fillna(0)
    everything = Window.partitionBy()  # ``buckets`` rows, whatever the data
    share = lambda c: F.col(c).cast("double") + 1
    total = lambda c: F.sum(c).over(everything).cast("double") + buckets
    return table.select("bucket", F.floor(1000 * F.ln(share("wanted") * total("corpus") / (share("corpus") * total("wanted")))).alias("gain"))


def gumbel(id_column: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, drawn from the id by SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, table: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """A row for each of ``docs``: its id, n_words, n_features, weight under the gain ``table``, score."""
    # the row's number keeps rows apart that repeat an id; the runs of a row are neighbours in one
    # task, so that the partial sum shuffles one row a document
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias(id_column), words(F.col(f"`{text}`")).alias("words")).withColumn("n_words", F.size("words").cast("bigint"))
    keys = ("row", id_column, "n_words")
    held = bucketed(rows, "words", n, buckets, *keys).join(F.broadcast(table), "bucket", "left")  # a row for each bucket
    summed = held.groupBy(*keys).agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.select(id_column, "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col(id_column), seed)).alias("score"))


def ranked(scored: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``scored`` with a column rank, from 1 in the given order, by a distributed sort.

    Rows are dealt into ranges of the order and written; each range is numbered within, and shifted
    by the rows of the ranges before it. The driver sees one count for each range.
    """
    spark = scored.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(scored.repartitionByRange(ranges, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy(_RANGE).count().collect(), key=lambda r: r[_RANGE]):
        offsets.append((r[_RANGE], before))
        before += r["count"]
    shifts = F.broadcast(spark.createDataFrame(offsets, f"{_RANGE} int, before bigint"))  # a row for each range
    within = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*order))
    return dealt.join(shifts, _RANGE).withColumn("rank", F.col("before") + within).drop(_RANGE, "before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_column: str = "doc_id", text: str = "text", n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` or more, those likeliest in ``target``.

    Returns id, n_features, weight, score and rank of every document; rank is null where a document
    was not drawn, and runs from 1 by falling score, ties to the smaller id. A null or empty text has
    no features and weight 0; null ids draw their noise as the empty id and come last among ties.
    Repeated rows each count and each get a row; among rows that repeat an id and score, and at the
    end of the draw, fewer features come first. Texts are read whole; a text's words must fit into a
    task's memory. An empty target gives every feature the gain of absence; an empty table of documents
    gives no rows. Further columns, whatever their names, are not read.
    """
    table = written(gains(docs, target, text, n, buckets), "gains")
    scored = weighted(docs, table, id_column, text, n, buckets, seed).withColumn("may", F.col("n_words") >= least_words)
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last(id_column), F.asc("n_features")]
    placed = ranked(scored, order)
    eligible = placed.agg(F.count_if("may").alias("n")).first()["n"]
    drawn = F.col("may") & (F.col("rank") <= percent * eligible // 100)
    return placed.select(id_column, "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
