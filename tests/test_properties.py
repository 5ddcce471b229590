"""Properties from the test strategy, on random multi-session logs."""

import math

from pyspark.sql import functions as F

from chronoframe.config import GAME_VOCAB, ORD, SESSION_KEYS
from chronoframe.functions.scalars import clip_values, secs
from chronoframe.operators import derive, frames, summary
from test_frames_property import _random_log


def test_time_delta_sums_to_span(spark):
    d = derive.derive_session_log(_random_log(spark, 11))
    per = d.where(F.col("Timestamp").isNotNull()).groupBy(*SESSION_KEYS).agg(
        F.sum("Time_delta").alias("s"), secs(F.max("Timestamp"), F.min("Timestamp")).alias("span")
    )
    for r in per.collect():
        assert math.isclose(r["s"], r["span"], abs_tol=1e-6)


def test_spine_row_count(spark):
    d = derive.derive_session_log(_random_log(spark, 12))
    for bucket, b in (("second", 1), ("minute", 60)):
        spans = summary.session_span(d, SESSION_KEYS, GAME_VOCAB, bucket)
        expected = sum(r["total_time"] // b + 1 for r in spans.collect() if r["total_time"] >= 0)
        assert frames.time_spine(spans, SESSION_KEYS, bucket).count() == expected


def test_fill_is_idempotent(spark):
    d = derive.derive_session_log(_random_log(spark, 13))
    once = frames.fill_down(d, ["MoleId"], list(SESSION_KEYS), "Timestamp", ORD, ("minute",))
    twice = frames.fill_down(once, ["MoleId"], list(SESSION_KEYS), "Timestamp", ORD, ("minute",))
    key = lambda df: sorted((r[ORD], r["MoleId"]) for r in df.select(ORD, "MoleId").collect())
    assert key(once) == key(twice)


def test_overlay_leaves_no_template_row_for_observed_key(spark):
    d = derive.derive_session_log(_random_log(spark, 14))
    spans = summary.session_span(d, SESSION_KEYS, GAME_VOCAB, "second")
    dense = frames.dense_frames(frames.object_template(d), spans)
    act = frames.object_activity(d)
    left = frames.overlay_anti(dense, act)
    clash = left.join(act.select(*SESSION_KEYS, "second", "id"), [*SESSION_KEYS, "second", "id"])
    assert clash.count() == 0
    assert left.count() + dense.join(act.select(*SESSION_KEYS, "second", "id").distinct(), [*SESSION_KEYS, "second", "id"]).count() == dense.count()


def test_clip_is_idempotent(spark):
    df = spark.range(200).select(((F.col("id") - 100) / 37.0).alias("x"))
    once = df.select(clip_values("x", -1.0, 1.5).alias("x"))
    twice = once.select(clip_values("x", -1.0, 1.5).alias("x"))
    assert sorted(r[0] for r in once.collect()) == sorted(r[0] for r in twice.collect())


def test_fused_rate_equals_joined_rate(spark):
    raw = _random_log(spark, 15)
    cols = ["_ord", "PlayPeriod", "Time_delta", "Hz", "GameStarted", "GameFinished", "GameTimeSpent", "GameTimeLeft"]
    a = derive.derive_session_log(raw, fuse_rate=True).select(*cols).collect()
    b = derive.derive_session_log(raw, fuse_rate=False).select(*cols).collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
