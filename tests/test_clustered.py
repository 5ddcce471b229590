"""Logs bucketed by session and time chunk: same values, no row shuffled."""

import uuid

import pytest
from pyspark.sql import functions as F

from chronoframe.config import EventVocab
from chronoframe.operators.derive import derive_session_log
from chronoframe.operators.scan import Stored
from chronoframe.operators.summary import session_summary
from chronoframe.sources.clustered import write_clustered

VOCAB = EventVocab(start=("on",), end=("off",), sample="s", spawn="x", expire="y", hit="h")
KEYS = ["Participant", "Condition"]
GRAINS = ("hour", "day")


def _log(spark, n=4000):
    """A session with half of all rows, NULL keys, rows of one instant and rows without a time."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 2 == 0, 1.0).when(i % 11 == 0, None).otherwise((i % 5).cast("double")).alias("Participant"),
        F.when(i % 13 != 0, F.concat(F.lit("C"), i % 3)).alias("Condition"),
        F.when(i % 17 != 0, F.timestamp_micros(F.pmod(F.xxhash64(i), F.lit(200_000)) * 700_000).cast("timestamp_ntz")).alias("Timestamp"),
        F.element_at(F.array(*map(F.lit, ("on", "off", "s", "s", "s", "h"))), (F.pmod(F.xxhash64(i, i), F.lit(6)) + 1).cast("int")).alias("Event"),
        F.lit("0.5").alias("GazeConfidence"),
        i.alias("_ord"),
    )


def _table(df, spark, tmp_path, **kw):
    return write_clustered(df, f"clustered_{uuid.uuid4().hex}", str(tmp_path / "log"), KEYS, **kw)


def _row_path(df):
    """Node names from the top down the streamed side to the scan of the rows."""
    node, names = df._jdf.queryExecution().executedPlan(), []
    while True:
        names.append(node.nodeName())
        if node.children().isEmpty():
            return names
        node = node.children().apply(0)


def test_derived_log_equals_the_unclustered_one(spark, tmp_path):
    df = _log(spark)
    want = derive_session_log(df, KEYS, VOCAB, grains=GRAINS, clean=False)
    got = derive_session_log(_table(df, spark, tmp_path), KEYS, VOCAB, grains=(Stored("hour"), "day"), clean=False)
    assert got.columns == want.columns
    rows = lambda d: sorted(d.collect(), key=lambda r: r["_ord"])
    assert rows(got) == rows(want)
    assert session_summary(got, KEYS, VOCAB).count() == session_summary(want, KEYS, VOCAB).count()


def test_no_row_is_shuffled(spark, tmp_path):
    table = _table(_log(spark), spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = derive_session_log(table, KEYS, VOCAB, grains=(Stored("hour"), "day"), clean=False)
        path = _row_path(log)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in path and "Window" in path
    assert not [n for n in path if "Exchange" in n], path


def test_a_long_session_lies_in_many_buckets(spark, tmp_path):
    table = _table(_log(spark), spark, tmp_path, buckets=8)
    hot = table.where("Participant = 1.0 and Condition = 'C1'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) == 8 and max(r["count"] for r in hot) < 3 * sum(r["count"] for r in hot) / 8


@pytest.mark.parametrize("rate", ["second", "day"])
def test_empty_log_and_long_rate_buckets(spark, tmp_path, rate):
    df = _log(spark) if rate == "day" else _log(spark).where("false")
    want = derive_session_log(df, KEYS, VOCAB, grains=GRAINS, clean=False, rate_bucket=rate)
    got = derive_session_log(
        _table(df, spark, tmp_path), KEYS, VOCAB, grains=(Stored("hour"), "day"), clean=False, rate_bucket=rate
    )
    assert sorted(r["Hz"] for r in got.collect()) == sorted(r["Hz"] for r in want.collect())
