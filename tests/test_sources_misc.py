"""Explicit-file loader, meta from paths, persistence and the small row operators."""

import os
import tempfile

from pyspark.sql import functions as F

from chronoframe.operators.basic import drop_suffixed, phase_filter, session_filter, sort_log, with_constants
from chronoframe.sources.csv_sessions import read_session_dir, read_session_files
from chronoframe.sources.tables import read_table, stage_table, write_table
from test_csv_sources import _fixture


def test_read_session_files(spark, tmp_path):
    root = _fixture(str(tmp_path))
    a = os.path.join(root, "Test Condition 2", "P0")
    log = read_session_files(
        spark, os.path.join(a, "s0_x_Meta.csv"), os.path.join(a, "s0_x_Event.csv"), os.path.join(a, "s0_x_Sample.csv")
    )
    assert log.count() == 4
    assert {r["MetaEmail"] for r in log.collect()} == {"a@b"}


def test_meta_from_paths(spark, tmp_path):
    root = _fixture(str(tmp_path))
    log = read_session_dir(spark, root, meta=None)
    assert log.count() == 5
    row = log.where(F.col("MoleId") == "m2").first()
    assert row["i1"] == "Cond+B" and row["SessionID"] == "S1"


def test_write_read_stage(spark):
    df = spark.range(5).withColumn("Condition", F.when(F.col("id") < 2, "A").otherwise("B"))
    path = tempfile.mkdtemp(prefix="tbl-", dir="/tmp") + "/t"
    write_table(df, path, partition_by=["Condition"])
    back = read_table(spark, path)
    assert sorted(r["id"] for r in back.where(F.col("Condition") == "B").collect()) == [2, 3, 4]
    staged = stage_table(df, "unit")
    assert staged.count() == 5
    assert "chronoframe-stage" in staged.inputFiles()[0]


def test_basic_ops(spark):
    df = spark.createDataFrame(
        [(0.0, "C1", "Game", 2, "a", "b"), (0.0, "C2", "PreGame", 1, "c", "d"), (1.0, "C1", "Game", 3, "e", "f")],
        "Participant double, Condition string, PlayPeriod string, _ord long, `x.x` string, `x.y` string",
    ).withColumn("Timestamp", F.lit(None).cast("timestamp_ntz"))
    assert session_filter(df, Participant=0.0, Condition="C1").count() == 1
    assert phase_filter(df).count() == 2
    assert "x.x" not in drop_suffixed(df).columns
    c = with_constants(df, {"id": "laser", "size": None}, {"size": "double"})
    assert dict(c.dtypes)["size"] == "double"
    assert [r["_ord"] for r in sort_log(df).collect()] == [1, 2, 3]
