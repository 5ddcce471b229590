"""Play-period state machine on odd marker orders (FIXTURES.md section 4)."""

import pytest

from chronoframe.operators import derive, summary

S, E, X = "Game Started", "Game Finished", "Sample"
CASES = [
    ([X, X], ["PreGame", "PreGame"], 0),
    ([X, S, X], ["PreGame", "Game", "Game"], 0),
    ([X, S, X, E, X], ["PreGame", "Game", "Game", "Game", "PostGame"], 1),
    ([X, S, X, E, X, E, X], ["PreGame", "Game", "Game", "Game", "PostGame", "Game", "PostGame"], 2),
    ([X, S, X, S, X, E, X], ["PreGame", "Game", "Game", "PostGame", "PostGame", "Game", "PostGame"], 1),
    ([X, E, X, S, X, E], ["PreGame", "Game", "Game", "PostGame", "PostGame", "Game"], 0),
]


def _log(spark, events, participant):
    rows = [
        (f"2022-01-01 10:00:{i:02d}", ev, float(participant), "C", i) for i, ev in enumerate(events)
    ]
    return spark.createDataFrame(rows, "Timestamp string, Event string, Participant double, Condition string, _ord long")


@pytest.mark.parametrize("grains", [(), ("second", "minute")])
def test_marker_cases(spark, grains):
    df = None
    for p, (events, _, _) in enumerate(CASES):
        one = _log(spark, events, p)
        df = one if df is None else df.unionByName(one)
    d = derive.derive_session_log(df, grains=grains)
    got = {}
    for r in d.collect():
        got.setdefault(int(r["Participant"]), []).append((r["_ord"], r["PlayPeriod"]))
    counts = dict(summary.session_summary(d).groupBy("Participant").count().collect())
    for p, (_, periods, n_rows) in enumerate(CASES):
        assert [x for _, x in sorted(got[p])] == periods
        assert counts.get(float(p), 0) == n_rows


def test_ties_and_null_times(spark):
    rows = [
        ("2022-01-01 10:00:00", S, 0.0, "C", 2),
        ("2022-01-01 10:00:00", X, 0.0, "C", 1),  # same instant, earlier in file order
        (None, X, 0.0, "C", 3),  # no time: sorts last
        ("garbage", E, 0.0, "C", 4),  # unparsable time -> NULL
    ]
    df = spark.createDataFrame(rows, "Timestamp string, Event string, Participant double, Condition string, _ord long")
    d = sorted(derive.derive_session_log(df).collect(), key=lambda r: r["_ord"])
    assert [r["PlayPeriod"] for r in d] == ["PreGame", "Game", "Game", "Game"]
    assert [r["Time_delta"] for r in d] == [0.0, 0.0, 0.0, 0.0]
