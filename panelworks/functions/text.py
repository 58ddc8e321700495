"""Column expressions for identifiers, codes, numbers and dates that arrive as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelworks import constants as K


def blank(column: Column) -> Column:
    """True for NULL and the empty text."""
    return column.isNull() | (column == "")


def clean_id(column: Column) -> Column:
    """Digits of the part before the first dot; NULL when there are none."""
    head = F.split_part(F.trim(column), F.lit("."), F.lit(1))
    return F.nullif(F.regexp_replace(head, "[^0-9]", ""), F.lit(""))


# what a text must look like to be read as a double; a cast of any other text fails through an exception, which is slow
_NUMBER = (r"^[\x00-\x20]*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?[dDfF]?|(?i:inf|infinity|nan)|0[xX].*)[\x00-\x20]*$")


# the code points such a text can begin with: blanks, digits, + - . and i I n N
_FIRST = tuple(map(ord, "+-.0123456789iInN"))


def number(column: Column) -> Column:
    """The text as a double, NULL when it is none: ``try_cast`` without an exception for every other text.

    The shape is not matched where the first sign already rules a number out.
    """
    first = F.ascii(column)
    return F.when(((first <= 32) | first.isin(*_FIRST)) & column.rlike(_NUMBER), column.try_cast("double"))


def decimal_point(column: Column) -> Column:
    """Trimmed text, with a decimal comma written as a point."""
    text = F.trim(column)
    return F.when(text.rlike(r"^\d+,\d+$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)


def strict_number(column: Column) -> Column:
    """Plain unsigned decimal with point or comma; anything else is NULL."""
    text = F.trim(column)
    return F.when(text.rlike(r"^\d+([.,]\d+)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def loose_number(column: Column) -> Column:
    """Digits, commas and points only; shapes that are no number give NULL."""
    return F.when(column.rlike(r"^[0-9,\.]+$"), number(F.replace(column, F.lit(","), F.lit("."))))


def drop_tokens(column: Column, tokens: Iterable[str] = K.NULL_TOKENS) -> Column:
    """NULL for an exact null token, the value itself otherwise."""
    return F.when(~column.isin(*tokens), column)


def map_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """Look a value up in a small fixed mapping; unmapped values stay as they are."""
    if not mapping:
        return column
    pairs = [F.lit(str(x)) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def day_text(column: Column) -> Column:
    """``d/M/yyyy`` or ``yyyy-M-d`` text as ``yyyy-MM-dd``; NULL for anything else."""
    # each text meets the one format its sign allows: a parse that fails costs an exception
    parsed = F.when(column.contains("/"), F.try_to_timestamp(column, F.lit("d/M/yyyy"))).when(
        column.contains("-"), F.try_to_timestamp(column, F.lit("yyyy-M-d")))
    return F.date_format(parsed, "yyyy-MM-dd")


def iso_day(column: Column) -> Column:
    """Date of an ISO-shaped text; NULL for other shapes and impossible days."""
    text = F.trim(column)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def row_digest(columns: Iterable[str]) -> Column:
    """Hash of the business columns, NULL kept apart from the empty text."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c), F.lit("<null>")) for c in columns]))
