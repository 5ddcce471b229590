"""Remaining fixture variants: fraction digits, NA / quoted-empty cells, path segment counts."""

import datetime as dt
import os

from pyspark.sql import functions as F

from chronoframe.functions.scalars import parse_log_ts, to_numeric
from chronoframe.sources.csv_sessions import path_fields, read_kind


def test_timestamp_fraction_digits(spark):
    texts = [
        "2022-01-01 10:00:00",
        "2022-01-01 10:00:00.5",
        "2022-01-01 10:00:00.1234",
        "2022-01-01 10:00:00.123456",
        "2022-01-01 10:00:00.1234567",
        "2022-01-01 10:00:00.25 trailing text",
        "2022-01-01",
        "garbage",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_log_ts("t")).collect()]
    base = dt.datetime(2022, 1, 1, 10, 0, 0)
    assert got[:6] == [
        base,
        base.replace(microsecond=500000),
        base.replace(microsecond=123400),
        base.replace(microsecond=123456),
        base.replace(microsecond=123456),  # 7th digit truncated to microseconds
        base.replace(microsecond=250000),
    ]
    assert got[6:] == [None, None, None]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("1e3",), ("NA",), ("",), ("x1",), (None,)], "v string")
    assert [r[0] for r in df.select(to_numeric("v")).collect()] == [1.5, 2.0, 1000.0, None, None, None, None]


def test_na_and_quoted_empty_cells(spark, tmp_path):
    root = str(tmp_path / "d")
    os.makedirs(os.path.join(root, "C"))
    with open(os.path.join(root, "C", "a_Event.csv"), "w") as f:
        f.write('Timestamp;Event;MoleId;MoleSize\n2022-01-01 10:00:00;Sample;NA;""\n2022-01-01 10:00:01;Sample;NULL;\n')
    rows = sorted(read_kind(spark, root, "Event").collect(), key=lambda r: r["Timestamp"])
    assert rows[0]["MoleId"] == "NA" and rows[0]["MoleSize"] == ""  # text, not missing
    assert rows[1]["MoleId"] is None and rows[1]["MoleSize"] == ""


def test_path_segment_counts(spark):
    df = spark.createDataFrame([("data/C1/p/a_b_Meta.csv",), ("data/C2/x/y/z/w/v_1_2_3_4_5_6_7_8_9_10.csv",)], "filename string")
    rows = path_fields(df).collect()
    short, long = rows[0], rows[1]
    assert (short["i0"], short["i1"], short["i2"], short["i3"], short["i4"]) == ("data", "C1", "p", "a_b_Meta.csv", None)
    assert short["i5"] == "data/C1/p/a" and short["i7"] == "Meta.csv" and short["i8"] is None
    assert long["i4"] == "z" and long["i13"] == "8"  # surplus segments dropped
    assert "filename" not in path_fields(df).columns
