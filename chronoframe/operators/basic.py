"""Small row-level operators: filters, suffix drops, constants, output order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.config import GAME, ORD, TS
from chronoframe.operators.numbering import dense_row_number


def session_filter(df: DataFrame, **equals: Any) -> DataFrame:
    """F1: rows of one session, e.g. ``session_filter(log, Participant=0.0, Condition="C1")``.

    Plain equality on columns, so Catalyst pushes it into the Parquet scan
    (and through windows partitioned by those columns).
    """
    cond = F.lit(True)
    for col, value in equals.items():
        cond = cond & (F.col(col) == F.lit(value))
    return df.where(cond)


def phase_filter(df: DataFrame, phase: str = GAME) -> DataFrame:
    """rows of one play phase."""
    return df.where(F.col("PlayPeriod") == phase)


def drop_suffixed(df: DataFrame, suffixes: Sequence[str] = (".x", ".y")) -> DataFrame:
    """Drop the columns a coalescing join left behind (names ending in a suffix)."""
    return df.drop(*[c for c in df.columns if any(c.endswith(s) for s in suffixes)])


def with_constants(df: DataFrame, values: dict[str, Any], types: dict[str, str] | None = None) -> DataFrame:
    """Constant columns; ``None`` values need a type in ``types`` (typed NULL)."""
    types = types or {}
    cols = {}
    for name, value in values.items():
        lit = F.lit(value)
        cols[name] = lit.cast(types[name]) if name in types else lit
    return df.withColumns(cols)


def sort_log(
    df: DataFrame,
    keys: Sequence[str] = (),
    time_col: str = TS,
    ord_col: str | None = ORD,
    number: str | None = None,
) -> DataFrame:
    """O1/O2: output order (keys, time NULLS LAST, file order).

    Only for presenting results: computations use window orders, never a
    global sort.  With ``number`` the rows keep the order as a dense row number
    in that column instead (two passes over ranges, no sort in one task).
    """
    order = [F.col(k).asc_nulls_last() for k in keys] + [F.col(time_col).asc_nulls_last()]
    if ord_col and ord_col in df.columns:
        order.append(F.col(ord_col).asc_nulls_last())
    return dense_row_number(df, order, number) if number else df.orderBy(*order)
