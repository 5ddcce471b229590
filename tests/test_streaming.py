"""Streaming ingest and live sample rate equal their batch forms."""

import os
import tempfile

from pyspark.sql import functions as F

from chronoframe.operators.derive import sample_rate
from chronoframe.streaming import ingest_stream, live_sample_rate, read_log_stream

COLS = ["Timestamp", "Event", "SessionID"]


def _files(root):
    os.makedirs(root, exist_ok=True)
    rows = [
        ("a_Sample.csv", ["2022-01-01 10:00:00.1;Sample;S", "2022-01-01 10:00:00.6;Sample;S", "2022-01-01 10:00:01.2;Sample;S"]),
        ("a_Event.csv", ["2022-01-01 10:00:00.3;Game Started;S", "2022-01-01 10:00:01.5;Mole Hit;NULL"]),
    ]
    for name, lines in rows:
        with open(os.path.join(root, name), "w") as f:
            f.write(";".join(COLS) + "\n" + "\n".join(lines) + "\n")


def test_ingest_and_rate(spark):
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src = os.path.join(base, "in")
    _files(src)
    stream = read_log_stream(spark, src + "/*.csv", COLS)
    q = ingest_stream(stream, os.path.join(base, "table"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    table = spark.read.parquet(os.path.join(base, "table"))
    assert table.count() == 5
    assert table.where(F.col("SessionID").isNull()).count() == 1

    rate_q = (
        live_sample_rate(read_log_stream(spark, src + "/*.csv", COLS))
        .writeStream.format("memory").queryName("live_rate").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    rate_q.awaitTermination(120)
    live = {r["second"].second: r["Hz"] for r in spark.sql("select * from live_rate").collect()}
    batch = {
        r["Timestamp"].replace(microsecond=0).second: r["Hz"]
        for r in sample_rate(table).collect()
    }
    assert live == batch == {0: 2, 1: 1}


def test_rate_where_the_zone_changes_its_clock(spark):
    """02:30 does not exist on that day in the session's zone; the log's wall clock is kept."""
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    os.makedirs(os.path.join(base, "in"))
    with open(os.path.join(base, "in", "a_Sample.csv"), "w") as f:
        f.write(";".join(COLS) + "\n2022-03-27 02:30:00.1;Sample;S\n2022-03-27 03:30:00.1;Sample;S\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        q = (
            live_sample_rate(read_log_stream(spark, base + "/in/*.csv", COLS))
            .writeStream.format("memory").queryName("live_zone").outputMode("complete")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        got = sorted((r["second"].hour, r["Hz"]) for r in spark.sql("select * from live_zone").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(2, 1), (3, 1)]
