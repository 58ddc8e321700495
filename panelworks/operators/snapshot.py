"""Staged payloads to canonical tables: flatten, latest delivery, ids, digest, dedup, archive."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.text import clean_id, decimal_point, row_digest


@dataclass(frozen=True)
class CanonicalSpec:
    """How one staged dataset becomes its canonical table."""

    keys: tuple[str, ...]
    programme: str
    normalise: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [k.lower() for k in self.keys]


HISTORY = CanonicalSpec(K.HISTORY_KEYS, "cod_carrera")
STUDENTS = CanonicalSpec(K.STUDENT_KEYS, "codigo_carrera")
PROGRESS = CanonicalSpec(K.PROGRESS_KEYS, "cod_carrera", {"porcentaje_avance": decimal_point})


def flatten(staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JSON payload to one text column per key; an absent key gives NULL.

    A generator reads all keys in one pass over the payload, and filters on the
    keys stay above it instead of parsing the payload again.
    """
    names = [k.lower() for k in keys]
    return staged.select("academic_period", F.json_tuple("payload", *keys).alias(*names))


def latest_delivery(df: DataFrame, tag: str = "academic_period") -> DataFrame:
    """Rows of the lexicographically last delivery; prunes partitions at run time."""
    return df.where(F.col(tag) == df.agg(F.max(tag)).scalar())


def in_whitelist(df: DataFrame, column: str, codes: Sequence[str] = K.PROGRAMME_WHITELIST) -> DataFrame:
    return df.where(F.col(column).isin(*codes))


def canonical_rows(
    flat: DataFrame, spec: CanonicalSpec, whitelist: Sequence[str] = K.PROGRAMME_WHITELIST, several: bool = True
) -> DataFrame:
    """Latest delivery, cleaned ids, whitelist, digest, exact dedup — without load time.

    ``several`` is off when ``flat`` holds the latest delivery only, as read from its partition.
    """
    rules = {"legajo": clean_id, **spec.normalise}
    cleaned = (latest_delivery(flat) if several else flat).select(
        "academic_period",
        *[rules.get(c, lambda x: x)(F.col(c)).alias(c) for c in spec.columns],
    )
    kept = in_whitelist(cleaned.where(F.col("legajo").isNotNull()), spec.programme, whitelist)
    return kept.select(row_digest(spec.columns).alias("row_hash"), "*").distinct()


def canonicalise(
    flat: DataFrame, spec: CanonicalSpec, whitelist: Sequence[str] = K.PROGRAMME_WHITELIST
) -> DataFrame:
    """Canonical table: ``canonical_rows`` plus the load time."""
    return canonical_rows(flat, spec, whitelist).withColumn("inserted_at", F.current_timestamp())


def unarchived(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``current`` whose (digest, delivery) is not in ``history`` yet."""
    keys = ["row_hash", "academic_period"]
    return current.join(history.select(*keys), keys, "left_anti").select(*current.columns)


def archived(current: DataFrame, history: DataFrame) -> DataFrame:
    """History after archiving ``current``."""
    return history.unionByName(unarchived(current, history))


ARCHIVE_KEYS = ("row_hash", "academic_period")


def append_archive(current: DataFrame, table: str, path: str, buckets: int = 32) -> None:
    """Add the rows of ``current`` that the stored archive does not hold yet.

    The archive is a table bucketed by (digest, delivery) under ``path``: to find
    what is new only the new delivery is shuffled, into the archive's buckets, and
    the archive is read where it lies. A first call creates it.
    """
    spark = current.sparkSession
    new = unarchived(current, spark.table(table)) if spark.catalog.tableExists(table) else current
    placed = new.repartition(buckets, *ARCHIVE_KEYS)
    placed.write.bucketBy(buckets, *ARCHIVE_KEYS).mode("append").option("path", path).saveAsTable(table)
