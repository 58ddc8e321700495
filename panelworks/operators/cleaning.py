"""Config-driven cleaning of raw deliveries.

Each step is a narrow projection or filter; the whole chain collapses into one
scan stage. Three datasets share the steps and differ in their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.text import day_text, drop_tokens, map_values, number


@dataclass(frozen=True)
class Layout:
    """How one delivered file is read and cleaned."""

    source: tuple[str, ...]
    rename: Mapping[str, str] = field(default_factory=dict)
    drop: Sequence[str] = ()
    target: tuple[str, ...] = ()
    value_mappings: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    types: Mapping[str, str] = field(default_factory=dict)
    null_values: tuple[str, ...] = K.NULL_TOKENS
    delimiter: str = ","
    encoding: str = "utf-8"
    expected_columns: int | None = None
    header_in_file: bool = True

    @classmethod
    def from_mapping(cls, config: Mapping) -> Layout:
        """From the nested mapping of a delivery's YAML file."""
        inp, cols = config.get("input", {}), config["columns"]
        return cls(
            source=tuple(cols.get("source", ())),
            rename=cols.get("rename") or {},
            drop=cols.get("drop") if cols.get("drop") is not None else [],
            target=tuple(cols.get("target", ())),
            value_mappings={c: {k: str(v) for k, v in m.items()}
                            for c, m in (config.get("value_mappings") or {}).items()},
            types=config.get("types") or {},
            null_values=tuple(config.get("null_values", K.NULL_TOKENS)),
            delimiter=inp.get("delimiter", ","),
            encoding=inp.get("encoding", "utf-8"),
            expected_columns=inp.get("expected_columns"),
            header_in_file=bool(inp.get("header_in_file", False)),
        )


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_listed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if not isinstance(names, (list, tuple)):
        raise ValueError(f"columns.drop must be a list, got {type(names).__name__}")
    return df.drop(*names)


def drop_personal(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop personal columns whatever the case of their name."""
    hidden = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in hidden])


def map_columns(df: DataFrame, mappings: Mapping[str, Mapping[str, str]]) -> DataFrame:
    known = {c: m for c, m in mappings.items() if c in df.columns}
    return df.withColumns({c: map_values(F.col(f"`{c}`"), m) for c, m in known.items()}) if known else df


def null_tokens(df: DataFrame, tokens: Sequence[str] = K.NULL_TOKENS) -> DataFrame:
    return df.select(*[drop_tokens(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns])


def cast_columns(df: DataFrame, types: Mapping[str, str], whole: bool = False) -> DataFrame:
    """``float`` and ``int`` turn bad values into NULL; other types cast strictly.

    ``int`` stays a double unless ``whole``, which cuts off the fraction.
    """
    exprs = {}
    for name, kind in types.items():
        if name not in df.columns:
            continue
        column = F.col(f"`{name}`")
        value = number(F.trim(column))
        if kind == "float" or (kind == "int" and not whole):
            exprs[name] = value
        elif kind == "int":
            exprs[name] = value.try_cast("long")
        else:
            exprs[name] = column.cast({"str": "string"}.get(kind, kind))
    return df.withColumns(exprs) if exprs else df


def normalise_days(df: DataFrame, names: Sequence[str] = K.DATE_COLUMNS) -> DataFrame:
    found = [n for n in names if n in df.columns]
    return df.withColumns({n: day_text(F.col(n)) for n in found}) if found else df


def conform(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """Exactly the target columns in order; missing ones are NULL text."""
    return df.select(*[
        F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in target
    ])


def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()) if key in df.columns else df


def clean_history(df: DataFrame, layout: Layout) -> DataFrame:
    return (
        df.transform(rename_columns, layout.rename)
        .transform(drop_listed, layout.drop)
        .transform(map_columns, layout.value_mappings)
        .transform(null_tokens, layout.null_values)
        .transform(cast_columns, layout.types)
        .transform(normalise_days)
        .transform(require_key, "ID")
    )


def clean_students(df: DataFrame, layout: Layout) -> DataFrame:
    return (
        df.transform(drop_listed, layout.drop)
        .transform(drop_personal, K.STUDENT_PII)
        .transform(rename_columns, layout.rename)
        .transform(map_columns, layout.value_mappings)
        .transform(null_tokens, layout.null_values)
        .transform(cast_columns, layout.types)
        .transform(conform, layout.target)
        .transform(require_key, "legajo")
        .transform(normalise_days)
    )


def clean_progress(df: DataFrame, layout: Layout) -> DataFrame:
    return (
        df.transform(drop_listed, layout.drop)
        .transform(drop_personal, K.PROGRESS_PII)
        .transform(rename_columns, layout.rename)
        .transform(map_columns, layout.value_mappings)
        .transform(null_tokens, layout.null_values)
        .transform(cast_columns, layout.types, True)
        .transform(conform, layout.target)
        .transform(require_key, "registro_id")
    )


CLEANERS = {"history": clean_history, "students": clean_students, "progress": clean_progress}


def clean(df: DataFrame, layout: Layout, kind: str) -> DataFrame:
    return CLEANERS[kind](df, layout)
