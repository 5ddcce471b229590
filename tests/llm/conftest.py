"""Fixtures of the training-data operator tests."""

import pytest
from cases import COLUMNS, ODD_ROWS, make_rows


@pytest.fixture(scope="session")
def rows():
    return make_rows() + ODD_ROWS


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "shard slot size key fp uid bucket place d o t tie line token words id _fp _uid _d _tie _numbers _score"
    names += " _text_key _hit_id _hit_key n_lines n_removed kept_text score held_out item start grp part payload"
    return docs.select("*", *(F.lit(None).cast("int").alias(n) for n in names.split()))
