"""Deliveries: route files to datasets, stage rows as JSON payloads by half-year."""

from __future__ import annotations

import logging
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.sources.delimited import read_csv_text

log = logging.getLogger(__name__)


def dataset_of(name: str) -> str | None:
    """Dataset a file name belongs to: first pattern that occurs in it, any case."""
    for pattern, dataset in K.DELIVERY_ROUTES:
        if re.search(pattern, name, re.IGNORECASE):
            return dataset
    return None


def route(name: Column) -> Column:
    """``dataset_of`` as a column expression."""
    return F.coalesce(*[F.when(F.lower(name).contains(p), F.lit(dataset)) for p, dataset in K.DELIVERY_ROUTES])


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """CSV entries (files, or folders of part files) directly under a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"Period path does not exist: {folder}")
    names = [s.getPath().toString() for s in fs.listStatus(path)]
    return sorted(n for n in names if n.lower().endswith(".csv"))


def by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Paths with the same first line together; one job reads the first lines of all.

    Files are read splittably: the first line is the first row of a file's first block.
    """
    if len(paths) == 1:
        return [paths]
    lines = spark.read.text(paths).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("row"))
    headers = lines.groupBy("path").agg(F.min_by("value", "row").alias("header"))
    groups = headers.groupBy("header").agg(F.sort_array(F.collect_set("path")).alias("paths")).orderBy("header").collect()
    return [[unquote(path) for path in row["paths"]] for row in groups] or [paths]


def load_delivery(spark: SparkSession, root: str, period: str) -> dict[str, DataFrame]:
    """Dataset -> staged rows of one delivery; one read per file layout."""
    found: dict[str, list[str]] = {}
    for path in list_csv(spark, f"{root}/{period}"):
        name = path.rsplit("/", 1)[-1]
        dataset = dataset_of(name)
        if dataset is None:
            log.warning("Ignored file: %s", name)
        else:
            found.setdefault(dataset, []).append(path)
    staged: dict[str, DataFrame] = {}
    for dataset, paths in found.items():
        for same in by_header(spark, paths):
            rows = stage(read_csv_text(spark, same), period)
            staged[dataset] = staged[dataset].unionByName(rows) if dataset in staged else rows
    return staged


def stage_payload(df: DataFrame, period: str | Column) -> DataFrame:
    """Rows as (delivery, JSON payload); missing cells are kept as empty text."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    tag = F.lit(period) if isinstance(period, str) else period
    return df.select(tag.alias("academic_period"), F.to_json(F.struct(*cells)).alias("payload"))


def stage(df: DataFrame, period: str) -> DataFrame:
    return stage_payload(df, period).withColumn("ingested_at", F.current_timestamp())


def append_staged(staged: DataFrame, path: str, replace_period: bool = False) -> None:
    """Append to the delivery's partition, or replace it so a re-load adds nothing."""
    writer = staged.write.partitionBy("academic_period")
    if replace_period:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def deliveries(spark: SparkSession, path: str, tag: str = "academic_period") -> list[str]:
    """Partition folders of a stored table, the lexicographically last delivery last; no file is opened."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted((n for n in names if n.startswith(f"{tag}=")), key=lambda n: unquote(n.split("=", 1)[1]))


def latest_partition(spark: SparkSession, path: str, schema, tag: str = "academic_period") -> DataFrame:
    """The last delivery of a stored table: its tag comes from the folder names, and only its files are listed and read."""
    found = deliveries(spark, path, tag)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path.rstrip('/')}/{found[-1]}")


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("payload STRING, ingested_at TIMESTAMP, academic_period STRING").parquet(path)
