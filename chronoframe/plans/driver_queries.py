"""Registered queries: each callable takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; none runs on a fixed sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators import derive, summary
from chronoframe.plans.common import GRAINS, KEYS, VOCAB, cleaned, derived, rounded
from chronoframe.sources.tables import events_log

Query = Callable[[SparkSession, str], DataFrame]


# what session_summary, and the pointer and frame operators, read of the derived log
SUMMARY_COLUMNS = (
    "Timestamp", "Event", "PlayPeriod", "Time_delta", "Hz",
    "WorldGazeHitPositionX", "WorldGazeHitPositionY", "WorldGazeHitPositionZ", "GazeConfidence",
)
FRAME_COLUMNS = (
    "Timestamp", "Event", "_ord", "PlayPeriod", "MoleId", "MolePositionWorldX", "MolePositionWorldY",
    "RightControllerLaserPosWorldX", "RightControllerLaserPosWorldY",
)


def q_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.session_summary(derived(spark, sf_dir, stage=SUMMARY_COLUMNS), KEYS, VOCAB)
    return rounded(
        out, ["PlayTime_delta", "MeanGaze_x", "MeanGaze_y", "MeanGaze_z", "MeanGazeConf", "MeanHz"]
    )


def q_derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)


def q_play_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derive.clean_log(events_log(spark, sf_dir))
    out = derive.play_period(log, KEYS, VOCAB, grains=GRAINS)
    return out.select("_ord", *KEYS, "Timestamp", "Event", "PlayPeriod")


def q_time_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derive.clean_log(events_log(spark, sf_dir))
    return derive.time_delta(log, KEYS, grains=GRAINS).select("_ord", *KEYS, "Timestamp", "Time_delta")


def q_sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derive.clean_log(events_log(spark, sf_dir))
    return derive.sample_rate(log, VOCAB).select("_ord", "Timestamp", "Event", "Hz")


def q_game_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derive.clean_log(events_log(spark, sf_dir))
    out = derive.game_clock(log, KEYS, VOCAB)
    return out.select("_ord", *KEYS, "GameStarted", "GameFinished", "GameTimeSpent", "GameTimeLeft")


QUERIES: dict[str, Query] = {
    "session_summary": q_session_summary,
    "derived_log": q_derived_log,
    "play_period": q_play_period,
    "time_delta": q_time_delta,
    "sample_rate": q_sample_rate,
    "game_clock": q_game_clock,
}


# ---- frames (hourly buckets: the events are a few per user-hour) ----------
from chronoframe.operators import frames  # noqa: E402
from chronoframe.plans.common import FRAME_BUCKET as B  # noqa: E402


def q_session_span(spark, sf_dir):
    return summary.session_span(cleaned(spark, sf_dir), KEYS, VOCAB, B)


def q_time_spine(spark, sf_dir):
    spans = summary.session_span(cleaned(spark, sf_dir), KEYS, VOCAB, B)
    return frames.time_spine(spans, KEYS, B).select(*KEYS, "second")


def q_object_template(spark, sf_dir):
    return frames.object_template(cleaned(spark, sf_dir), KEYS)


def q_object_activity(spark, sf_dir):
    return frames.object_activity(cleaned(spark, sf_dir), KEYS, VOCAB, B)


def q_first_per_key(spark, sf_dir):
    log = cleaned(spark, sf_dir)
    return frames.first_per_key(log, [*KEYS, "Event"], cols=["_ord", "Timestamp", "MolePositionWorldX"])


def q_distinct_buckets(spark, sf_dir):
    return frames.distinct_buckets(cleaned(spark, sf_dir), KEYS, B)


def q_pointer_track(spark, sf_dir):
    return summary.pointer_track(derived(spark, sf_dir), KEYS, VOCAB, B)


def q_pointer_mean(spark, sf_dir):
    return rounded(summary.pointer_mean(derived(spark, sf_dir), KEYS, B), ["laser_x", "laser_y"])


def _template(log):
    return frames.object_template(log, KEYS).unionByName(frames.pointer_template(log, KEYS))


def q_dense_frames(spark, sf_dir):
    log = cleaned(spark, sf_dir)
    spans = summary.session_span(log, KEYS, VOCAB, B)
    return frames.dense_frames(_template(log), spans, KEYS, B).select(*KEYS, "id", "x", "y", "size", "second")


def q_overlay_anti(spark, sf_dir):
    log = cleaned(spark, sf_dir)
    spans = summary.session_span(log, KEYS, VOCAB, B)
    act = frames.object_activity(log, KEYS, VOCAB, B)
    return frames.unobserved_frames(_template(log), spans, act, KEYS, B).select(*KEYS, "id", "second")


def q_fill_down(spark, sf_dir):
    log = cleaned(spark, sf_dir)
    out = frames.fill_down(log, ["MoleId"], KEYS, "Timestamp", "_ord", GRAINS)
    return out.select("_ord", *KEYS, F.col("MoleId").alias("last_object"))


def q_animation_frames(spark, sf_dir):
    return frames.animation_frames(derived(spark, sf_dir, stage=FRAME_COLUMNS), KEYS, VOCAB, B)


def q_animation_frames_v2(spark, sf_dir):
    return frames.animation_frames_v2(cleaned(spark, sf_dir), KEYS, VOCAB, B)


def q_pointer_frames_v2(spark, sf_dir):
    out = frames.pointer_frames_v2(derived(spark, sf_dir, stage=FRAME_COLUMNS), KEYS, VOCAB, B)
    return rounded(out, ["laser_x", "laser_y"])


def q_axis_range(spark, sf_dir):
    return summary.axis_range(cleaned(spark, sf_dir))


def q_spawn_points(spark, sf_dir):
    return frames.spawn_points(derived(spark, sf_dir), KEYS)


def q_sample_rate_series(spark, sf_dir):
    return frames.sample_rate_series(derived(spark, sf_dir), KEYS)


def q_trace_union(spark, sf_dir):
    return frames.trace_union(derived(spark, sf_dir, stage=FRAME_COLUMNS), KEYS, VOCAB, B)


QUERIES.update(
    {
        "session_span": q_session_span,
        "time_spine": q_time_spine,
        "object_template": q_object_template,
        "object_activity": q_object_activity,
        "first_per_key": q_first_per_key,
        "distinct_buckets": q_distinct_buckets,
        "pointer_track": q_pointer_track,
        "pointer_mean": q_pointer_mean,
        "dense_frames": q_dense_frames,
        "overlay_anti": q_overlay_anti,
        "fill_down": q_fill_down,
        "animation_frames": q_animation_frames,
        "animation_frames_v2": q_animation_frames_v2,
        "pointer_frames_v2": q_pointer_frames_v2,
        "axis_range": q_axis_range,
        "spawn_points": q_spawn_points,
        "sample_rate_series": q_sample_rate_series,
        "trace_union": q_trace_union,
    }
)


# ---- sources, scalars, curves ----------------------------------------------
from chronoframe.functions import scalars  # noqa: E402
from chronoframe.operators import curves  # noqa: E402
from chronoframe.sources import csv_sessions  # noqa: E402
from chronoframe.sources.tables import _delete_on_exit, events_as_log, load, stage_table  # noqa: E402

THRESHOLD_LEVELS = (0.05, 0.3, 0.5, 0.9)
THRESHOLD_LABELS = ("rare", "some", "half", "most")


def q_merge_logs(spark, sf_dir):
    """Event and sample logs with different columns, unioned, joined to meta."""
    log = events_as_log(load(spark, sf_dir, "events"))
    is_sample = F.col("Event").eqNullSafe("view")  # a row without an Event is no sample
    ev = log.where(~is_sample).select(
        "Timestamp", "Event", "SessionID", "MoleId", "MolePositionWorldX", "MolePositionWorldY", "_ord"
    )
    sa = log.where(is_sample).select(
        "Timestamp", "Event", "SessionID", "RightControllerLaserPosWorldX", "RightControllerLaserPosWorldY",
        "WorldGazeHitPositionX", "GazeConfidence", "_ord",
    )
    meta = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("SessionID"),
        F.col("c_mktsegment").alias("Timestamp"),
        F.col("c_name").alias("Email"),
        F.col("c_nationkey").cast("string").alias("Framecount"),
        F.col("c_custkey").cast("string").alias("ParticipantID"),
    )
    return csv_sessions.merge_sessions(csv_sessions.rename_meta(meta), ev, sa)


def q_path_fields(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return csv_sessions.path_fields(pages, "url")


def q_parse_and_cast(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    ts_text = (
        F.when(F.col("event_type") == "error", F.lit("not a time"))
        .when(F.col("event_type") == "view", F.concat(F.col("ts").cast("string"), F.lit(" +junk")))
        .otherwise(F.col("ts").cast("string"))
    )
    val_text = F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select(
        "event_id",
        scalars.parse_log_ts(ts_text).alias("Timestamp"),
        scalars.to_numeric(val_text).alias("value_num"),
    )


def q_label_text(spark, sf_dir):
    log = cleaned(spark, sf_dir)
    return log.select(
        "_ord", scalars.label_text(log, "Participant", "Condition", "MoleId", "MolePositionWorldX").alias("label")
    )


def q_clip_values(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x"))
    return e.withColumn("clipped", scalars.clip_values("x", 0.0, 1.0))


def q_threshold_label(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x"))
    return e.withColumn("label", scalars.threshold_label("x", THRESHOLD_LEVELS, THRESHOLD_LABELS))


def q_linear_curve(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    out = curves.linear_curve(li, "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


def q_smooth_curve(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    out = curves.smooth_curve(li, "l_extendedprice", "l_quantity", spar=0.5, keys=["l_returnflag"])
    return out.select("l_returnflag", "x", F.round("y", 3).alias("y"))


def q_smooth_curve_line(spark, sf_dir):
    """K2 with so much smoothing that the curve is the least-squares line."""
    li = load(spark, sf_dir, "lineitem")
    out = curves.smooth_curve(li, "l_extendedprice", "l_quantity", spar=3.0, keys=["l_returnflag"])
    return out.select("l_returnflag", "x", F.round("y", 2).alias("y"))


QUERIES.update(
    {
        "merge_logs": q_merge_logs,
        "smooth_curve_line": q_smooth_curve_line,
        "path_fields": q_path_fields,
        "parse_and_cast": q_parse_and_cast,
        "label_text": q_label_text,
        "clip_values": q_clip_values,
        "threshold_label": q_threshold_label,
        "linear_curve": q_linear_curve,
        "smooth_curve": q_smooth_curve,
    }
)


# ---- mixed models -----------------------------------------------------------
from chronoframe.operators import mixed  # noqa: E402
from chronoframe.operators.random_intercept import random_intercept_test  # noqa: E402

# The synthetic TPC-style columns are independent draws, so the models run on
# the per-session summary, where hits and play time are related by design.
LME_SPEC = mixed.LmeSpec(
    responses=["PlayTime_delta", "MoleHitCount"],
    random=["Condition"],
    fixed=["PlayTime", "MeanHz"],
    null="Participant",
)


def q_mixed_model_select(spark, sf_dir):
    sessions = summary.session_summary(derived(spark, sf_dir, stage=SUMMARY_COLUMNS), KEYS, VOCAB)
    return mixed.mixed_model_select(sessions, LME_SPEC)


QUERIES["mixed_model_select"] = q_mixed_model_select


def q_random_intercept_test(spark, sf_dir):
    """Does the discount explain the price beyond quantity and differences between suppliers?"""
    lines = load(spark, sf_dir, "lineitem")
    out = random_intercept_test(lines, "l_extendedprice", ["l_discount"], "l_suppkey", null=["l_quantity"])
    return rounded(out.select("model", "npar", "n", "levels", "ML", "Chisq", "Df"), ["ML", "Chisq"], 2)


QUERIES["random_intercept_test"] = q_random_intercept_test


# ---- trial outcomes (A12, W7) -----------------------------------------------
# Fixed values of the stand-in mapping: click rows carry a trial result chosen
# by k % 8 from AccInput, RejInput, OverrideInput, AugSuccess, ExplicitSham,
# AssistSuccess, AssistFail, MitigateFail; error rows carry feedback chosen by
# k % 5 from FishCaught, Reel, Stay, Unreel, FishLost.  Decisions are clicks,
# fish events are errors; conditions C1, C2, C3 take the assist, sham and
# mitigate rates.
TRIAL_RESULTS = ["AccInput", "RejInput", "OverrideInput", "AugSuccess", "ExplicitSham", "AssistSuccess", "AssistFail", "MitigateFail"]
TRIAL_FEEDBACK = ["FishCaught", "Reel", "Stay", "Unreel", "FishLost"]


def q_trial_outcome_rates(spark, sf_dir):
    log = derived(spark, sf_dir)
    k = F.col("MolePositionWorldY").cast("int")
    results = F.array(*[F.lit(v) for v in TRIAL_RESULTS])
    feedback = F.array(*[F.lit(v) for v in TRIAL_FEEDBACK])
    log = log.withColumn("TrialResult", F.when(F.col("Event") == "click", F.get(results, k % 8))).withColumn(
        "TrialFeedback", F.when(F.col("Event") == "error", F.get(feedback, k % 5))
    )
    out = summary.trial_outcome_rates(
        log, KEYS, decision_event="click", fish_event="error",
        pam_conditions={"C1": "trial_rate_assist", "C2": "trial_rate_sham", "C3": "trial_rate_mitigate"},
        grains=GRAINS,
    )
    rates = [c for c in out.columns if c.startswith("trial_rate") or c in ("pam_rate", "time_total")]
    return rounded(out, rates)


QUERIES["trial_outcome_rates"] = q_trial_outcome_rates


# ---- the CSV session source end to end (S1-S3, P1-P3, P5, P6, J1, U1) ------
import os  # noqa: E402
import uuid  # noqa: E402

from chronoframe.config import checkpoint_dir  # noqa: E402
from chronoframe.operators.derive import derive_session_log  # noqa: E402

_CSV_OPTS = {"header": "true", "sep": ";", "nullValue": "NULL", "quoteAll": "true", "quote": '"', "escape": '"'}


def _note():
    """A free-text cell with a separator, doubled quotes, a backslash and a line break."""
    return F.concat(F.lit('said "'), F.col("Event"), F.lit('"; C:\\log\\\nseen '), F.col("Timestamp").cast("string"))


def export_session_csv(spark, sf_dir) -> str:
    """Write ``events`` as ';' session CSV files under the checkpoint folder; returns the root.

    Layout as logged: ``<root>/<Condition>/<n>_{Event|Sample|Meta}.csv``, text only.
    """
    log = events_as_log(load(spark, sf_dir, "events")).withColumn(
        "SessionID", F.concat_ws("-", F.col("SessionID"), F.col("Condition"))
    )
    log = log.withColumn("Note", _note())
    text = {c: F.col(c).cast("string") for c, t in log.dtypes if t != "string" and c != "_ord"}
    log = log.withColumns(text)
    root = f"{checkpoint_dir(spark).rstrip('/')}/chronoframe-stage/sessions-{uuid.uuid4().hex}"
    ev_cols = [c for c in log.columns if c not in ("Participant", "_ord")]
    # sample files list the same columns in another order: loaded by name, not position
    sa_cols = list(reversed(ev_cols))
    is_sample = F.col("Event").eqNullSafe("view")
    meta = log.select(
        "SessionID", F.lit("2024-01-01").alias("Timestamp"), F.lit("").alias("Email"),
        F.lit("0").alias("Framecount"), F.col("Participant").alias("ParticipantID"), "Condition",
    ).distinct()
    kinds = {"Event": log.where(~is_sample).select(*ev_cols), "Sample": log.where(is_sample).select(*sa_cols), "Meta": meta}
    for kind, rows in kinds.items():
        part = f"{root}-{kind}"
        rows.write.options(**_CSV_OPTS).partitionBy("Condition").csv(part)
        _name_session_files(spark, part, root, kind)
        _delete_on_exit(spark, part)
    _delete_on_exit(spark, root)
    return root


def _name_session_files(spark, part: str, root: str, kind: str) -> None:
    """Move ``<part>/Condition=<c>/part-*.csv`` to ``<root>/<c>/<n>_<kind>.csv`` (one file a task and condition)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(part)):
        name = folder.getPath().getName()
        if name.startswith("Condition="):
            to = f"{root}/{name.partition('=')[2]}"
            fs.mkdirs(path(to))
            for n, file in enumerate(f.getPath() for f in fs.listStatus(folder.getPath())):
                if file.getName().endswith(".csv"):
                    fs.rename(file, path(f"{to}/{n}_{kind}.csv"))


def _relative_root(spark, root: str) -> str:
    """The root as a user in its parent's neighbourhood writes it: relative to the working folder."""
    if not root.startswith("file:"):
        return root
    here = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    return os.path.relpath("/" + root.removeprefix("file:").lstrip("/"), here)


def q_csv_session_summary(spark, sf_dir):
    root = _relative_root(spark, export_session_csv(spark, sf_dir))
    raw = csv_sessions.read_session_dir(spark, root)
    kept = [*KEYS, *SUMMARY_COLUMNS, "Note"]
    log = stage_table(derive_session_log(raw, KEYS, VOCAB, grains=GRAINS).select(*kept), "csv-derived-log")
    notes = log.groupBy(*KEYS).agg(F.min("Note").alias("first_note"), F.count("Note").alias("n_notes"))
    per_session = F.struct(*KEYS)  # NULL keys meet
    notes = notes.select(per_session.alias("_session"), "first_note", "n_notes")
    out = summary.session_summary(log, KEYS, VOCAB).withColumn("_session", per_session)
    out = out.join(notes, "_session").drop("_session")
    return rounded(
        out, ["PlayTime_delta", "MeanGaze_x", "MeanGaze_y", "MeanGaze_z", "MeanGazeConf", "MeanHz"]
    )


QUERIES["csv_session_summary"] = q_csv_session_summary


# ---- persisted log, partition-pruned filters (S6-S8, F1, F2) --------------
from chronoframe.operators import basic  # noqa: E402
from chronoframe.operators.scan import Stored  # noqa: E402
from chronoframe.sources.clustered import write_clustered  # noqa: E402


def q_persisted_game_rows(spark, sf_dir):
    """Derived log persisted by Condition, read back, one condition's Game rows.

    The condition filter prunes to one partition folder; the phase filter is
    pushed into the Parquet scan.
    """
    log = stage_table(derived(spark, sf_dir), "derived-by-condition", partition_by=["Condition"])
    rows = basic.phase_filter(basic.session_filter(log, Condition="C1"))
    return rows.select("_ord", "Participant", "Condition", "Timestamp", "Event", "GameTimeSpent", "Hz")


QUERIES["persisted_game_rows"] = q_persisted_game_rows


def clustered_log(spark, sf_dir):
    """The cleaned log as a table bucketed by session and hour."""
    name = f"clustered_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/chronoframe-stage/{name}"
    table = write_clustered(cleaned(spark, sf_dir), name, path, KEYS, grain="hour")
    _delete_on_exit(spark, path)
    return table


def q_clustered_derived_log(spark, sf_dir):
    """C1 on a log persisted by session and hour: no row is shuffled after the write."""
    log = derive_session_log(
        clustered_log(spark, sf_dir), KEYS, VOCAB, grains=(Stored("hour"), *GRAINS[GRAINS.index("hour") + 1 :]), clean=False
    )
    return log.select("_ord", *KEYS, "Timestamp", "Event", "PlayPeriod", "Time_delta", "Hz", "GameTimeSpent", "GameTimeLeft")


QUERIES["clustered_derived_log"] = q_clustered_derived_log


# ---- operators that the queries above use only in part ----------------------
def q_summary_first_marker(spark, sf_dir):
    """A3 with one row per session: the first end marker."""
    out = summary.session_summary(derived(spark, sf_dir, stage=SUMMARY_COLUMNS), KEYS, VOCAB, markers="first")
    return rounded(
        out, ["PlayTime_delta", "MeanGaze_x", "MeanGaze_y", "MeanGaze_z", "MeanGazeConf", "MeanHz"]
    )


def q_csv_from_paths(spark, sf_dir):
    """A directory without meta contents; Condition comes from the path."""
    root = _relative_root(spark, export_session_csv(spark, sf_dir))
    raw = csv_sessions.read_session_dir(spark, root, meta=None)
    return raw.groupBy("i1", "SessionID", "Event").agg(F.count(F.lit(1)).alias("n"), F.max("Note").alias("last_note"))


def _session_file(kind):
    return F.concat(F.lit("data/"), F.col("Condition"), F.lit("/u"), F.col("SessionID"), F.lit(f"_{kind}.csv"))


def q_merge_by_path(spark, sf_dir):
    """Meta rows without a SessionID meet their log rows on the session's path."""
    log = events_as_log(load(spark, sf_dir, "events"))
    ev = log.select("Timestamp", "Event", "SessionID", "MoleId", "_ord", _session_file("Event").alias("filename"))
    meta = log.where(F.col("Condition") != "C3").select("SessionID", "Condition").distinct()
    meta = meta.select(
        F.lit(None).cast("string").alias("SessionID"),
        F.concat(F.lit("p"), F.col("SessionID")).alias("ParticipantID"),
        F.col("Condition").alias("i1"),
        csv_sessions.session_base(_session_file("Meta")).alias("_session_base"),
    )
    return csv_sessions.merge_sessions(meta, ev, None)


def q_merge_suffix_drop(spark, sf_dir):
    """Columns on both sides of the merge come out with suffixes and are dropped."""
    ev = events_as_log(load(spark, sf_dir, "events")).select("Timestamp", "Event", "SessionID", "MoleId", "_ord")
    meta = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("SessionID"), F.col("c_name").alias("Event"), F.col("c_mktsegment").alias("Segment")
    )
    return basic.drop_suffixed(csv_sessions.merge_sessions(meta, ev, None))


def q_three_valued_if(spark, sf_dir):
    """An unknown condition gives a missing value, not the else branch."""
    log = events_log(spark, sf_dir).withColumn("y", scalars.to_numeric("WorldGazeHitPositionY"))
    far = F.col("y") > 500
    return log.select("_ord", F.when(far, "far").when(~far, "near").alias("side"))


# the header kinds of the split files: all columns, other orders, a column missing
SPLIT_COLUMNS = ("Timestamp", "Event", "SessionID", "MoleId", "WorldGazeHitPositionY", "Note")
SPLIT_HEADERS = {"C0": SPLIT_COLUMNS, "C1": SPLIT_COLUMNS[::-1], "C2": SPLIT_COLUMNS[2:] + SPLIT_COLUMNS[:2]}
SPLIT_OTHER = tuple(c for c in SPLIT_COLUMNS if c != "MoleId")
SPLIT_BYTES = 32 << 10


def q_csv_split_rows(spark, sf_dir):
    """Sample files of four header kinds, cells with line breaks, cut into many splits."""
    log = events_log(spark, sf_dir).withColumn("Note", _note())
    log = log.withColumn("Timestamp", F.col("Timestamp").cast("string"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/chronoframe-stage/splits-{uuid.uuid4().hex}"
    own = F.col("Condition")
    kinds = {c: (own == c, names) for c, names in SPLIT_HEADERS.items()}
    kinds["other"] = (~F.coalesce(own.isin(list(SPLIT_HEADERS)), F.lit(False)), SPLIT_OTHER)
    for kind, (rows, names) in kinds.items():
        part = f"{root}-{kind}"
        log.where(rows).select(F.lit(kind).alias("Condition"), *names).write.options(**_CSV_OPTS).partitionBy(
            "Condition"
        ).csv(part)
        _name_session_files(spark, part, root, "Sample")
        _delete_on_exit(spark, part)
    _delete_on_exit(spark, root)
    return csv_sessions.read_kind(spark, root, "Sample", split_bytes=SPLIT_BYTES).select(*SPLIT_COLUMNS)


def q_csv_explicit_files(spark, sf_dir):
    """The exported files named one by one."""
    root = export_session_csv(spark, sf_dir)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = lambda kind: [f.getPath().toString() for f in fs.globStatus(path(f"{root}/*/*_{kind}.csv"))]
    log = csv_sessions.read_session_files(spark, named("Meta"), named("Event"), named("Sample"))
    return log.groupBy("SessionID", "Event").agg(
        F.count(F.lit(1)).alias("n"), F.min(scalars.to_numeric("ParticipantID")).alias("participant")
    )


def q_sorted_log(spark, sf_dir):
    """O1: dense row numbers in output order (time NULLS LAST, file order)."""
    return basic.sort_log(cleaned(spark, sf_dir), number="row_number").select("_ord", "Timestamp", "row_number")


QUERIES.update(
    {
        "csv_split_rows": q_csv_split_rows,
        "csv_explicit_files": q_csv_explicit_files,
        "sorted_log": q_sorted_log,
        "summary_first_marker": q_summary_first_marker,
        "csv_from_paths": q_csv_from_paths,
        "merge_by_path": q_merge_by_path,
        "merge_suffix_drop": q_merge_suffix_drop,
        "three_valued_if": q_three_valued_if,
    }
)
