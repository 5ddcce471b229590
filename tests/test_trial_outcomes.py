"""Trial outcome counts on a hand-built log."""

import pytest

from chronoframe.operators.summary import trial_outcome_rates

ROWS = [
    # t, Event, TrialResult, TrialFeedback, Condition
    (1, "GameDecision", "AccInput", None, "AS"),
    (2, "FishEvent", None, "FishCaught", "AS"),  # decision 1 followed by a fish event
    (3, "GameDecision", "RejInput", None, "AS"),
    (4, "Sample", None, None, "AS"),  # decision 3 not followed by a fish event -> escape
    (5, "GameDecision", "AssistSuccess", None, "AS"),
    (6, "Sample", None, "Reel", "AS"),  # decision 5 not followed -> reel
    (7, "GameDecision", "MitigateFail", None, "AS"),  # last row: no next row, not counted
]


def test_trial_outcomes(spark):
    df = spark.createDataFrame(
        [(f"2022-01-01 10:00:{t:02d}", e, r, f, c, 1.0, t, 1.0) for t, e, r, f, c in ROWS],
        "ts string, Event string, TrialResult string, TrialFeedback string, Condition string, "
        "Participant double, _ord long, Time_delta double",
    ).selectExpr("cast(ts as timestamp_ntz) as Timestamp", "*").drop("ts")
    (r,) = trial_outcome_rates(df, grains=("minute",)).collect()
    assert (r["accInput"], r["rejInput"], r["assistInput"], r["mitigateFail"]) == (1, 1, 1, 1)
    assert r["totalTrials"] == 4 and r["totalTrials2"] == 4
    assert (r["fishCaught"], r["fishReel"]) == (1, 1)
    assert r["notFishCaught"] == 2  # decisions 3 and 5
    assert r["escape"] == 1 and r["reel"] == 1  # by the decision row's own result
    assert r["trial_rate_accept"] == pytest.approx(0.5)
    assert r["trial_rate_positive"] == pytest.approx(2 / 3)
    assert r["pam_rate"] == pytest.approx(r["trial_rate_assist"]) == pytest.approx(0.25)
    assert r["time_total"] == 7.0


def test_carried_columns_and_other_keys(spark):
    df = spark.createDataFrame(
        [(1.0, "AS", 31.0, f"2022-01-01 10:00:0{t}", "GameDecision", "AssistSuccess", None, t, 1.0) for t in range(3)]
        + [(2.0, "MF", None, "2022-01-01 10:00:00", "GameDecision", "MitigateFail", None, 9, 1.0)],
        "who double, arm string, Age double, ts string, Event string, TrialResult string, TrialFeedback string, "
        "_ord long, Time_delta double",
    ).selectExpr("cast(ts as timestamp_ntz) as Timestamp", "*").drop("ts")
    out = trial_outcome_rates(df, keys=("who",), grains=("minute",), carry=["Age", "arm"], condition_col="arm")
    got = {r["who"]: (r["Age"], r["arm"], r["pam_rate"]) for r in out.collect()}
    assert got == {1.0: (31.0, "AS", 1.0), 2.0: (None, "MF", 1.0)}
