"""The fused animation frames equal the literal composition J3 -> J4 -> W5 -> J5."""

import random

import pytest
from pyspark.sql import functions as F

from chronoframe.config import GAME_VOCAB, ORD, SESSION_KEYS
from chronoframe.operators import derive, frames, summary

EVENTS = ["Sample", "Sample", "Sample", "Mole Spawned", "Mole Hit", "Mole Expired", "Game Started", "Game Finished"]


def _random_log(spark, seed, sessions=6, rows=120):
    rnd = random.Random(seed)
    out = []
    o = 0
    for s in range(sessions):
        t0 = 1_600_000_000 + rnd.randint(0, 100)
        for _ in range(rows):
            o += 1
            t = t0 + rnd.uniform(0, 90)
            ev = rnd.choice(EVENTS)
            mid = rnd.choice(["m1", "m2", "m3"]) if ev.startswith("Mole") else None
            ts = None if rnd.random() < 0.02 else f"{t:.6f}"
            lx = None if rnd.random() < 0.2 else f"{rnd.uniform(-1, 1):.3f}"
            out.append((ts, ev, mid, str(s % 3), f"C{s % 2}", f"{rnd.uniform(-3, 3):.2f}", "1", lx, "0.5", o))
    df = spark.createDataFrame(
        out,
        "t string, Event string, MoleId string, Participant string, Condition string, "
        "MolePositionWorldX string, MolePositionWorldY string, RightControllerLaserPosWorldX string, "
        "RightControllerLaserPosWorldY string, _ord long",
    )
    ts = F.timestamp_micros((F.col("t").cast("double") * 1e6).cast("long")).cast("timestamp_ntz").cast("string")
    return df.withColumn("Timestamp", ts).drop("t")


def _literal_frames(dlog, keys, vocab, bucket):
    spans = summary.session_span(dlog, keys, vocab, bucket).where(F.col("total_time") >= 0)
    template = frames.object_template(dlog, keys).unionByName(frames.pointer_template(dlog, keys))
    dense = frames.dense_frames(template, spans, keys, bucket)
    act = frames._attach_spans(frames.object_activity(dlog, keys, vocab, bucket), spans, keys)
    out = frames.overlay_anti(dense, act, keys).unionByName(act, allowMissingColumns=True)
    out = frames.fill_down(out, ["size"], [*keys, "id"], "second", ORD, (), default=0.0)
    track = frames._attach_spans(summary.pointer_track(dlog, keys, vocab, bucket), spans, keys)
    out = frames.overlay_anti(out, track, keys).unionByName(track, allowMissingColumns=True)
    b = frames._bucket_seconds(bucket)
    out = frames._relative_seconds(out).where(F.col("second") <= F.floor(F.col("total_time") / b) * b)
    return out.select(*keys, "x", "y", "id", "size", "name", "second", "Event", "has_hit")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,bucket", [(1, "second"), (2, "second"), (3, "minute")])
def test_fused_frames_equal_literal_plan(spark, seed, bucket):
    dlog = derive.derive_session_log(_random_log(spark, seed)).cache()
    fused = frames.animation_frames(dlog, SESSION_KEYS, GAME_VOCAB, bucket)
    literal = _literal_frames(dlog, SESSION_KEYS, GAME_VOCAB, bucket)
    assert fused.where("marker_size <> size * 32 or marker_size is null").isEmpty()
    a, b = _rows(fused.drop("marker_size")), _rows(literal)
    assert len(a) > 0
    assert a == b


def _literal_frames_v2(dlog, keys, vocab, bucket):
    spans = summary.session_span(dlog, keys, vocab, bucket).where(F.col("total_time") >= 0)
    dense = frames.dense_frames(frames.object_template(dlog, keys, size=0.0), spans, keys, bucket)
    sk = F.struct(*[F.col(k) for k in keys])
    act = frames.object_activity(dlog, keys, vocab, bucket).select(
        sk.alias("_j"), "second", "id", "Event", F.col("x").alias("_ax"), F.col("y").alias("_ay"), ORD
    )
    j = dense.withColumn("_j", sk).join(act, ["_j", "second", "id"], "left").drop("_j")
    j = frames.fill_down(j, ["Event"], [*keys, "id"], "second", ORD, ())
    out = j.select(
        *keys, "id", "second", "time_start",
        F.coalesce("x", "_ax").alias("x"), F.coalesce("y", "_ay").alias("y"), "Event",
        F.when(F.col("Event") == vocab.spawn, 1.0).otherwise(0.0).alias("size"),
    )
    return frames._relative_seconds(out).drop("time_start")


@pytest.mark.parametrize("seed,bucket", [(4, "second"), (5, "minute")])
def test_fused_frames_v2_equal_literal_plan(spark, seed, bucket):
    dlog = derive.derive_session_log(_random_log(spark, seed)).cache()
    fused = frames.animation_frames_v2(dlog, SESSION_KEYS, GAME_VOCAB, bucket)
    literal = _literal_frames_v2(dlog, SESSION_KEYS, GAME_VOCAB, bucket)
    assert fused.where("marker_size <> size * 32 or marker_size is null").isEmpty()
    cols = sorted(set(fused.columns) - {"marker_size"})
    a, b = _rows(fused.select(*cols)), _rows(literal.select(*cols))
    assert len(a) > 0
    assert a == b


def _rows_per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _gaps(spark, n):
    """n short ranges of one object of one session."""
    return spark.range(n).select(
        F.struct(F.lit(1.0).alias("Participant"), F.lit("C").alias("Condition")).alias("_fr_sk"),
        F.lit("m1").alias("id"), (F.col("id") * 100).alias("_lo"), (F.col("id") * 100 + 98).alias("_hi"),
        F.lit(None).cast("double").alias("state"),
    )


def test_one_busy_object_uses_every_task(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        per = _rows_per_task(frames._explode_gaps(_gaps(spark, 20_000)))
        assert len(per) == 8 and sum(per) == 1_980_000
        assert max(per) <= 2 * sum(per) / len(per)
        spans = spark.sql(
            "select 1.0D Participant, 'C' Condition, timestamp_ntz'2024-01-01' time_start, 1000 total_time"
        )
        template = spark.range(1000).selectExpr("1.0D Participant", "'C' Condition", "concat('m', id) id")
        per = _rows_per_task(frames.dense_frames(template, spans))
        assert len(per) == 8 and sum(per) == 1_001_000
        assert max(per) <= 2 * sum(per) / len(per)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed,block", [(6, 4096), (7, 16)])
def test_pointer_means_meet_ranges(spark, seed, block, monkeypatch):
    """C7 looks the means up in block arrays: the rows of C6 joined with the means, short blocks included."""
    monkeypatch.setattr(frames, "_SPINE_BLOCK", block)
    dlog = derive.derive_session_log(_random_log(spark, seed)).cache()
    fused = frames.pointer_frames_v2(dlog)
    rows = frames._frames_v2_absolute(dlog, SESSION_KEYS, GAME_VOCAB, "second")
    means = summary.pointer_mean(dlog).select(frames._sk(SESSION_KEYS).alias("_p"), "second", "laser_x", "laser_y")
    joined = rows.withColumn("_p", frames._sk(SESSION_KEYS)).join(means, ["_p", "second"], "left").drop("_p")
    plain = frames._relative_seconds(joined).drop("time_start")
    cols = sorted(fused.columns)
    a, b = _rows(fused.select(*cols)), _rows(plain.select(*cols))
    assert a == b and any(r[cols.index("laser_x")] is not None for r in a)


def test_unobserved_frames_equal_the_anti_join(spark, monkeypatch):
    monkeypatch.setattr(frames, "_SPINE_BLOCK", 16)
    dlog = derive.derive_session_log(_random_log(spark, 8)).cache()
    spans = summary.session_span(dlog)
    template = frames.object_template(dlog).unionByName(frames.pointer_template(dlog))
    template = template.unionByName(template.limit(2).withColumn("id", F.lit(None).cast("string")))
    seen = frames.object_activity(dlog).select(*SESSION_KEYS, "id", "second")
    half = F.timestamp_add("MICROSECOND", F.lit(500_000), F.col("second"))
    seen = seen.unionByName(seen.withColumn("second", half).limit(50))  # between buckets: meets nothing
    seen = seen.unionByName(seen.limit(3).withColumn("id", F.lit(None).cast("string")))
    plain = frames.overlay_anti(frames.dense_frames(template, spans), seen)
    fused = frames.unobserved_frames(template, spans, seen)
    cols = sorted(plain.columns)
    a, b = _rows(fused.select(*cols)), _rows(plain.select(*cols))
    assert a == b and 0 < len(a) < frames.dense_frames(template, spans).count()


def _above_last_generate(df):
    """The physical plan above the Generate that makes dense rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(lines[: next(i for i, x in enumerate(lines) if "Generate explode" in x)])


def test_dense_rows_are_not_shuffled(spark):
    dlog = derive.derive_session_log(_random_log(spark, 9))
    spans = summary.session_span(dlog)
    fused = frames.unobserved_frames(frames.object_template(dlog), spans, frames.object_activity(dlog))
    for df in (fused, frames.pointer_frames_v2(dlog)):
        assert "Exchange" not in _above_last_generate(df) and "Join" not in _above_last_generate(df)


def test_sparse_rows_are_written_once_and_the_log_is_left_behind(spark):
    rows = [("A", "X", "2024-01-01 00:00:00", "Game Started", None, 1), ("A", "X", "2024-01-01 00:00:02", "Mole Spawned", "m1", 2),
            ("A", "X", "2024-01-01 00:00:05", "Game Finished", None, 3)]
    names = ["Participant", "Condition", "Timestamp", "Event", "MoleId", "_ord"]
    log = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == '_ord' else 'string'}" for n in names))
    zeros = {c: F.lit(0.5) for c in ("MolePositionWorldX", "MolePositionWorldY", *(f"RightControllerLaserPosWorld{c}" for c in "XY"))}
    log = log.withColumns({"Timestamp": F.col("Timestamp").cast("timestamp_ntz"), "PlayPeriod": F.lit("Game"), **zeros})
    out = frames.animation_frames(log)
    assert "LocalRelation" not in plan_text(out) and "LogicalRDD" not in plan_text(out)
    got = sorted((r["id"], r["second"], r["size"]) for r in out.collect())
    mole = [("m1", float(s), 1.0 if s >= 2 else 0.0) for s in range(6)]
    pointer = [("laser", float(s), 1.0 if s in (0, 2, 5) else 0.0) for s in range(6)]
    assert got == sorted(mole + pointer)


def plan_text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
