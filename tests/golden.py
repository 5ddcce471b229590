"""The hand-computed golden session (FIXTURES.md section 3) as raw text rows."""

GOLDEN = [
    ("2022-01-01 10:00:00.000", "Sample", None),
    ("2022-01-01 10:00:00.500", "Game Started", None),
    ("2022-01-01 10:00:00.750", "Sample", None),
    ("2022-01-01 10:00:01.000", "Mole Spawned", "m1"),
    ("2022-01-01 10:00:01.250", "Sample", None),
    ("2022-01-01 10:00:01.500", "Mole Hit", "m1"),
    ("2022-01-01 10:00:02.000", "Sample", None),
    ("2022-01-01 10:00:02.500", "Mole Spawned", "m2"),
    ("2022-01-01 10:00:03.500", "Mole Expired", "m2"),
    ("2022-01-01 10:00:04.250", "Game Finished", None),
    ("2022-01-01 10:00:04.500", "Sample", None),
]

SCHEMA = (
    "Timestamp string, Event string, MoleId string, Participant string, Condition string, "
    "MolePositionWorldX string, MolePositionWorldY string, RightControllerLaserPosWorldX string, "
    "RightControllerLaserPosWorldY string, WorldGazeHitPositionX string, WorldGazeHitPositionY string, "
    "WorldGazeHitPositionZ string, GazeConfidence string, _ord long"
)


def golden_rows(participant="0", condition="Test Condition 2", rows=GOLDEN):
    out = []
    for i, (ts, ev, mid) in enumerate(rows, start=1):
        mx = {"m1": "1.5", "m2": "-2"}.get(mid)
        my = {"m1": "0.5", "m2": "3"}.get(mid)
        out.append(
            (ts, ev, mid, participant, condition, mx, my, str(i), str(10 * i), str(i), "bad", None, "0.5", i)
        )
    return out


def golden_df(spark, **kw):
    return spark.createDataFrame(golden_rows(**kw), SCHEMA)
