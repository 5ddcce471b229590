"""Plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoframe.sources.tables import drop_staged, load, stage_table  # noqa: F401 - drop_staged is re-exported

MASK64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage on shared storage, so a lost executor costs the tasks that
    were running, never what was already written.  The shuffle files behind
    ``df`` are deleted as the write ends, the copy by ``drop_staged`` once its
    last reader is done.
    """
    return stage_table(df, f"llm-{name}")


def whole_text(col: str = "text") -> Column:
    """The text of a row; NULL counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name close to ``wanted`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: StructType | str,
) -> DataFrame:
    """``mapInArrow``: ``fn`` sees one task's rows as a stream of record batches."""
    return df.mapInArrow(fn, schema)


def utf8(value: str | None) -> bytes:
    """UTF-8 bytes of a text (NULL: none)."""
    return (value or "").encode("utf-8", "surrogatepass")
