"""Readers for delivered text files. Every column is text; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.functions.arrow import in_batches

# ISO-8859-15 differs from ISO-8859-1 in these eight characters only.
_LATIN9_FROM, _LATIN9_TO = "¤¦¨´¸¼½¾", "€ŠšŽžŒœŸ"


def decoded(raw: Column, encoding: str) -> Column:
    """Text of a raw line in one of the delivered encodings."""
    name = encoding.upper().replace("_", "-")
    if name in ("UTF-8", "UTF8"):
        return raw
    latin1 = F.decode(raw.cast("binary"), "ISO-8859-1")
    if name in ("ISO-8859-1", "LATIN-1", "LATIN1"):
        return latin1
    if name in ("ISO-8859-15", "LATIN-9", "LATIN9"):
        return F.translate(latin1, _LATIN9_FROM, _LATIN9_TO)
    raise ValueError(f"unsupported encoding: {encoding}")


def utf8_or_latin1(raw: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, ISO-8859-1 otherwise."""
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8", header: bool = False) -> DataFrame:
    """One column ``value``; splittable, any line end, blank lines included.

    With ``header`` the first line of every file is left out, whatever it holds.
    """
    raw = spark.read.text(path)
    if header:
        placed = raw.select(
            F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"))
        raw = in_batches(placed, _without_first_lines, "value binary").select(F.col("value").cast("string").alias("value"))
    return raw.select(decoded(F.col("value"), encoding).alias("value"))


def _without_first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines but the first one of each file's first block; the blocks of a task come one after the other."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block").to_numpy()
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        new[0] = last != (file[0].as_py(), int(block[0]))
        last = (file[-1].as_py(), int(block[-1]))
        yield batch.select(["value"]).filter(pa.array(~(new & (block == 0))))


def header_fields(spark: SparkSession, path: str, delimiter: str = "|") -> list[str]:
    first = spark.read.text(path).head()
    return first[0].split(delimiter) if first else []


def _fields(delimiter: str) -> Column:
    return F.split("value", r"\Q" + delimiter + r"\E", -1)


def read_delimited_strict(
    spark: SparkSession, path: str, names: Sequence[str], delimiter: str = "|",
    encoding: str = "utf-8", header: bool = False, expected: int | None = None,
) -> DataFrame:
    """Unquoted fields named from the layout; lines of another width are dropped."""
    parts = read_lines(spark, path, encoding, header).select(_fields(delimiter).alias("f"))
    if expected is not None:
        parts = parts.where(F.size("f") == expected)
    return parts.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def read_delimited_repair(
    spark: SparkSession, path: str, delimiter: str = "|", names: Sequence[str] | None = None
) -> DataFrame:
    """Ragged lines repaired: short ones padded, surplus fields merged into the last column.

    Names come from the header line unless given; ``NULL`` becomes the empty
    text and unnamed columns are left out.
    """
    names = list(names or header_fields(spark, path, delimiter))
    n = len(names)
    fields = read_lines(spark, path, header=True).select(_fields(delimiter).alias("f"))
    padded = F.concat("f", F.array_repeat(F.lit(""), F.greatest(F.lit(n) - F.size("f"), F.lit(0))))
    rest = F.array_join(F.slice("f", n, F.greatest(F.size("f") - n + 1, F.lit(0))), delimiter)
    merged = F.when(F.size("f") > n, F.concat(F.slice("f", 1, n - 1), F.array(rest))).otherwise(padded)
    rows = fields.select(merged.alias("f"))
    kept = [(i, name) for i, name in enumerate(names) if not name.startswith("Unnamed:")]
    return rows.select(*[
        F.when(F.col("f")[i] == "NULL", "").otherwise(F.col("f")[i]).alias(name) for i, name in kept
    ])


def read_csv_text(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None,
    delimiter: str = ",", encoding: str = "utf-8", header: bool = True,
    expected: int | None = None, multiline: bool = False, empty_text: bool = True,
) -> DataFrame:
    """Quoted CSV with every column as text; names from the file header or the layout.

    A blank header cell ``i`` is named ``Unnamed: i``. Empty cells stay empty
    text unless ``empty_text`` is off, which leaves them NULL.

    ``expected`` checks the file width and raises before any data is read.
    ``multiline`` allows line breaks inside quotes; such files are not split.
    """
    reader = (
        spark.read.option("sep", delimiter).option("encoding", "UTF-8" if encoding.lower() == "utf-8" else encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .option("mode", "PERMISSIVE").option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    first = reader.option("header", header).option("inferSchema", False).csv(path)
    found = first.columns
    if expected is not None and len(found) != expected:
        raise ValueError(f"Expected {expected} columns, but got {len(found)} in {path}")
    if header:
        columns = [f"Unnamed: {i}" if c == f"_c{i}" else c for i, c in enumerate(found)]
    else:
        columns = list(names or found)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = reader.option("header", header).schema(schema).csv(path)
    return rows.na.fill("") if empty_text else rows


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows where at least one cell is more than white space."""
    content = F.concat_ws("", *[F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", "") for c in df.columns])
    return df.where(content != "")


def read_csv_without_empty_rows(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """CSV rows that are not blank, UTF-8 with ISO-8859-1 as the fallback for the whole file.

    One pass checks the bytes, so a file is decoded in one encoding throughout.
    """
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    encoding = "ISO-8859-1" if broken else "utf-8"
    return drop_empty_rows(read_csv_text(spark, path, delimiter=delimiter, encoding=encoding))


def read_layout(spark: SparkSession, path: str, layout) -> DataFrame:
    """A delivered file as its layout describes it; ``.txt`` history files are unquoted."""
    if path.rstrip("/").lower().endswith(".txt") and layout.delimiter == "|":
        return read_delimited_strict(
            spark, path, layout.source, layout.delimiter, layout.encoding,
            layout.header_in_file, layout.expected_columns,
        )
    return read_csv_text(
        spark, path, layout.source, layout.delimiter, layout.encoding, layout.header_in_file,
        layout.expected_columns,
    )
