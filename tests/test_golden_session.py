"""The golden session through derive, summary, span, pointer track and frames."""

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import derive, frames, summary
from golden import golden_df

PERIODS = ["PreGame"] + ["Game"] * 9 + ["PostGame"]
DELTAS = [0, 0.5, 0.25, 0.25, 0.25, 0.25, 0.5, 0.5, 1, 0.75, 0.25]
HZ = [2, 2, 2, 1, 1, 1, 1, 1, 0, 1, 1]
SPENT = [-0.5, 0, 0.25, 0.5, 0.75, 1, 1.5, 2, 3, 3.75, 4]
LEFT = [4.25, 3.75, 3.5, 3.25, 3, 2.75, 2.25, 1.75, 0.75, 0, -0.25]


@pytest.fixture(scope="module")
def dlog(spark):
    return derive.derive_session_log(golden_df(spark)).cache()


@pytest.mark.parametrize("grains", [(), ("minute", "day"), (1, 2, 60)])
def test_derived_columns(spark, grains):
    d = derive.derive_session_log(golden_df(spark), grains=grains)
    rows = sorted(d.collect(), key=lambda r: r["_ord"])
    assert [r["PlayPeriod"] for r in rows] == PERIODS
    assert [r["Time_delta"] for r in rows] == DELTAS
    assert [r["Hz"] for r in rows] == HZ
    assert [r["GameTimeSpent"] for r in rows] == SPENT
    assert [r["GameTimeLeft"] for r in rows] == LEFT
    assert rows[0]["Participant"] == 0.0


def test_summary(dlog):
    (r,) = summary.session_summary(dlog).collect()
    assert r["MoleHitCount"] == 1
    assert r["PlayTime"] == 3.75
    assert r["PlayTime_delta"] == pytest.approx(4.25)
    assert r["MeanHz"] == pytest.approx(10 / 9)
    assert r["MeanGaze_y"] is None  # all text 'bad' -> no numbers
    assert r["MeanGazeConf"] == 0.5


def test_span_and_spine(dlog):
    (sp,) = summary.session_span(dlog).collect()
    assert str(sp["time_start"]) == "2022-01-01 10:00:00" and sp["total_time"] == 3
    spine = frames.time_spine(summary.session_span(dlog))
    assert spine.count() == 4


def test_pointer_track(dlog):
    rows = {r["second"].second: r for r in summary.pointer_track(dlog).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert [s for s, r in rows.items() if r["has_hit"]] == [1]
    assert rows[1]["x"] == 6.0  # the hit row
    assert rows[0]["x"] == 3.0 and rows[2]["x"] == 8.0 and rows[4]["x"] == 10.0  # last Game row


def test_animation_frames(dlog):
    out = frames.animation_frames(dlog)
    rows = out.collect()
    assert len(rows) == 13
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["second"], r["Event"] or "")):
        sizes.setdefault(r["id"], []).append((int(r["second"]), r["size"]))
    assert sorted(sizes["m1"]) == [(0, 0.0), (1, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    assert sizes["m2"] == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 0.0)]
    assert sizes["laser"] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]


def test_animation_frames_v2_and_pointer(dlog):
    v2 = frames.animation_frames_v2(dlog)
    got = {}
    for r in v2.collect():
        got.setdefault((r["id"], int(r["second"])), set()).add((r["Event"], r["size"]))
    assert got[("m1", 0)] == {(None, 0.0)}
    assert got[("m1", 1)] == {("Mole Spawned", 1.0), ("Mole Hit", 0.0)}
    assert got[("m1", 2)] == {("Mole Hit", 0.0)}  # carried forward
    assert got[("m2", 2)] == {("Mole Spawned", 1.0)} and got[("m2", 3)] == {("Mole Expired", 0.0)}
    p = frames.pointer_frames_v2(dlog)
    assert p.where(F.col("laser_x").isNotNull()).count() > 0


def test_spawn_points_and_series(dlog):
    pts = {r["MoleId"]: r for r in frames.spawn_points(dlog).collect()}
    assert pts["m1"]["label"] == "m1 1.5 0.5"
    assert pts["m2"]["label"] == "m2 -2 3"
    assert pts[None]["label"] == "NA NA NA"
    series = frames.sample_rate_series(dlog).select("series").distinct().collect()
    assert [r[0] for r in series] == ["0 Test Condition 2"]


def test_summary_first_marker_and_per_session_rate(spark):
    # two end markers: "all" gives one row per end marker, "first" one row
    rows = golden_df(spark).collect()
    extra = spark.createDataFrame(
        [("2022-01-01 10:00:05.000", "Game Stopped", None, "0", "Test Condition 2", None, None, "12", "120", "1", "bad", None, "0.5", 12)],
        golden_df(spark).schema,
    )
    d = derive.derive_session_log(golden_df(spark).unionByName(extra))
    assert summary.session_summary(d, markers="all").count() == 2
    (first,) = summary.session_summary(d, markers="first").collect()
    assert first["PlayTime"] == 3.75
    # sample rate per session equals the global one when only one session exists
    per = derive.sample_rate(d, keys=["Participant", "Condition"]).select("_ord", "Hz").collect()
    glob = derive.sample_rate(d).select("_ord", "Hz").collect()
    assert sorted(per) == sorted(glob)
    assert len(rows) == 11


def test_window_operators_replace_existing_columns(dlog):
    again = derive.game_clock(derive.sample_rate(dlog))
    assert again.columns.count("Hz") == 1 and again.columns.count("GameStarted") == 1
    a = sorted((r["_ord"], r["Hz"], r["GameTimeLeft"]) for r in again.collect())
    b = sorted((r["_ord"], r["Hz"], r["GameTimeLeft"]) for r in dlog.collect())
    assert a == b


def test_rederive_is_stable(spark, dlog):
    twice = derive.derive_session_log(dlog)
    assert sorted(twice.columns) == sorted(dlog.columns)
    key = lambda df: sorted(tuple(r) for r in df.select(sorted(dlog.columns)).collect())
    assert key(twice) == key(dlog)


def test_an_unread_sample_rate_costs_nothing(spark):
    log = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS Timestamp, 'Sample' AS Event FROM range(9)")
    plan = derive.sample_rate(log).drop("Hz")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_rows_without_a_time_share_one_rate(spark):
    rows = [("2024-01-01 00:00:00", "Sample"), ("2024-01-01 00:00:00.5", "x"), (None, "Sample"), (None, "Sample"), (None, None)]
    log = spark.createDataFrame(rows, "Timestamp string, Event string")
    log = log.withColumns({"Timestamp": log["Timestamp"].cast("timestamp_ntz")})
    assert sorted(r["Hz"] for r in derive.sample_rate(log).collect()) == [1, 1, 2, 2, 2]
