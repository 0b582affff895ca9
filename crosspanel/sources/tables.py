"""Scans and sinks: tables, ranged and fresh-universe scans, documents, upserts, verified files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(bars: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """One row: the last ts, over some entities or all."""
    return (bars.where(F.col("entity").isin(entities)) if entities else bars).agg(F.max("ts").alias("latest"))


def ranged(bars: DataFrame, days: int, entities: list[str] | None = None, against: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days before the latest ts (of ``against``, if given)."""
    bound = latest(bars if against is None else against)
    rows = bars.where(F.col("entity").isin(entities)) if entities else bars
    return rows.join(F.broadcast(bound), F.col("ts") >= F.col("latest") - F.make_interval(days=F.lit(days))).drop("latest")


def until(bars: DataFrame, asof: Column, days: int) -> DataFrame:
    """Point-in-time scan: the ``days`` days up to ``asof``, and nothing later."""
    return bars.where((F.col("ts") <= asof) & (F.col("ts") >= asof - F.make_interval(days=F.lit(days))))


def fresh_entities(bars: DataFrame, days: int, exclude: str | None = None, prefix: str | None = None) -> DataFrame:
    """Entities whose last row is at most ``days`` days before the last row of all."""
    rows = bars.where(F.col("entity").startswith(prefix)) if prefix else bars
    rows = rows.where(~F.col("entity").contains(exclude)) if exclude else rows
    per = rows.groupBy("entity").agg(F.max("ts").alias("last_ts"))
    return per.join(F.broadcast(per.agg(F.max("last_ts").alias("latest"))), F.col("last_ts") >= F.col("latest") - F.make_interval(days=F.lit(days))).select("entity", "last_ts")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert-or-ignore: of rows with equal keys the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "new") -> DataFrame:
    """Upsert: ``keep`` says whose row stays where keys meet. Columns that one side lacks are null."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.desc("_side") if keep == "new" else F.asc("_side")]).drop("_side")


def merge_largest(old: DataFrame, new: DataFrame, keys: list[str], largest: list[str]) -> DataFrame:
    """Upsert in which the columns ``largest`` never fall: of rows whose keys meet they keep the greater
    value that is there, and the new row gives the rest."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, *largest, "_side")]
    last = F.max_by(F.struct(*rest), "_side") if rest else None
    out = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in largest], *([last.alias("_rest")] if rest else []))
    return out.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in both.columns if c != "_side"])


def append_missing(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent append: the rows whose keys the ledger lacks (and, of each key, one)."""
    return rows.join(ledger.select(*keys), keys, "left_anti").dropDuplicates(keys)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files of one schema with the file they came from; rows that do not fit it are dropped."""
    return spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED").withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row (file, header, n_lines) for each CSV file that is not empty: its first line."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("header"), F.count("*").alias("n_lines"))


def read_csv_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the CSV files that have all columns of ``schema``, in whatever order and beside whatever
    others, and a report (file, status, missing) on every file that is not empty: read or short.

    A short file is left out whole. Values that do not fit their column's type are null. Files of equal
    headers are read together: there are as many scans as different headers, which the driver lists as
    it lists the files.
    """
    wanted = StructType.fromDDL(schema)
    names = [f.name for f in wanted]
    columns = F.transform(F.split(F.coalesce("header", F.lit("")), ","), lambda c: F.regexp_replace(F.trim(c), r'^\uFEFF?"?|"$', ""))
    files = csv_headers(spark, path).withColumn("missing", F.array_except(F.array(*[F.lit(n) for n in names]), columns))
    status = F.when(F.size("missing") > 0, "short").otherwise("read")
    report = files.select("file", status.alias("status"), "missing", "header")
    groups = report.where("status = 'read'").groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out = spark.createDataFrame([], f"{schema}, source_file string")
    for g in groups:
        rows = spark.read.csv(sorted(g.files), header=True, enforceSchema=True).withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
        out = out.unionByName(rows.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in wanted], "source_file"))
    return out, report.select(F.element_at(F.split("file", "/"), -1).alias("file"), "status", "missing")


def write_result(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Result sink in parquet, csv or json."""
    w = df.write.mode(mode).format(form)
    (w.partitionBy(*by) if by else w).options(**({"header": "true"} if form == "csv" else {})).save(path)


def enveloped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as canonical JSON with a SHA-256 of it: keys, payload, sha256. Field order is fixed by name."""
    fields = sorted(c for c in df.columns if c not in keys)
    payload = F.to_json(F.struct(*fields))
    return df.select(*keys, payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))


def broken_envelopes(df: DataFrame) -> DataFrame:
    """Rows whose payload does not have the checksum it came with, or came with none."""
    return df.where(~F.sha2("payload", 256).eqNullSafe(F.col("sha256")))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints, in the one the session shares. Where none is set, a temporary
    one serves in local mode; a cluster without one is an error."""
    import re
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="crosspanel-")
    return f"{root}/crosspanel/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read again, for plans that use it more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
