"""Per-session aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT_GRAINS, EVENT, GAME, GAME_VOCAB, GAZE_COLUMNS, SESSION_KEYS, TS, EventVocab
from chronoframe.functions.scalars import in_set, nan_to_null, secs, to_numeric, trunc_ts
from chronoframe.operators.scan import running_scan

_SUMMARY_NAMES = ("MeanGaze_x", "MeanGaze_y", "MeanGaze_z", "MeanGazeConf")


def _sk(keys: Sequence[str]) -> F.Column:
    return F.struct(*[F.col(k) for k in keys])


def _expand(df: DataFrame, keys: Sequence[str], sk: str) -> DataFrame:
    return df.select(*[F.col(f"{sk}.{k}").alias(k) for k in keys], *[c for c in df.columns if c != sk])


def session_summary(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    markers: str = "all",
) -> DataFrame:
    """A1-A5 over the Game rows of each session.

    One output row per end marker (``markers="all"``) or one per session
    (``"first"``); sessions whose Game rows hold no start or no end vanish.
    PlayTime is end - start in seconds; means skip missing and NaN values.
    """
    game = dlog.where(F.col("PlayPeriod") == GAME).withColumn("_sum_sk", _sk(keys))
    is_start = in_set(EVENT, vocab.start)
    # optional columns: a log without them gets NULL means
    gaze = [
        nan_to_null(to_numeric(c)) if c in dlog.columns else F.lit(None).cast("double") for c in GAZE_COLUMNS
    ]
    agg = game.groupBy("_sum_sk").agg(
        F.count_if(F.col(EVENT) == vocab.hit).alias("MoleHitCount"),
        F.sum("Time_delta").alias("PlayTime_delta"),
        *[F.avg(g).alias(n) for g, n in zip(gaze, _SUMMARY_NAMES)],
        F.avg("Hz").alias("MeanHz"),
        F.bool_or(is_start).alias("_has_start"),
        F.min(F.when(is_start, F.col(TS))).alias("_start"),
    )
    ends = game.where(in_set(EVENT, vocab.end)).select("_sum_sk", F.col(TS).alias("_end"))
    if markers == "first":
        ends = ends.groupBy("_sum_sk").agg(F.min("_end").alias("_end"))
    elif markers != "all":
        raise ValueError("markers must be 'all' or 'first'")
    out = agg.where("_has_start").join(ends, "_sum_sk")
    out = out.withColumn("PlayTime", secs("_end", "_start"))
    out = _expand(out, keys, "_sum_sk")
    return out.select(
        *keys, "MoleHitCount", "PlayTime", "PlayTime_delta", *_SUMMARY_NAMES, "MeanHz"
    )


def session_span(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
) -> DataFrame:
    """First start and first end per session (all phases).

    ``time_start``/``time_end`` are floored to ``bucket``; ``total_time`` is the
    whole number of seconds between the raw times (truncated toward zero).
    Sessions lacking either marker get no row.
    """
    spans = (
        dlog.withColumn("_span_sk", _sk(keys))
        .groupBy("_span_sk")
        .agg(
            F.min(F.when(in_set(EVENT, vocab.start), F.col(TS))).alias("_s"),
            F.min(F.when(in_set(EVENT, vocab.end), F.col(TS))).alias("_e"),
        )
        .where(F.col("_s").isNotNull() & F.col("_e").isNotNull())
    )
    spans = spans.select(
        "_span_sk",
        trunc_ts("_s", bucket).alias("time_start"),
        trunc_ts("_e", bucket).alias("time_end"),
        secs("_e", "_s").cast("int").alias("total_time"),
    )
    return _expand(spans, keys, "_span_sk")


def pointer_track(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
    x: str = "RightControllerLaserPosWorldX",
    y: str = "RightControllerLaserPosWorldY",
    ord_col: str = "_ord",
) -> DataFrame:
    """Per session and bucket of Game rows, the pointer position.

    If the bucket holds a hit, x/y of its first hit row; else of its last row
    (missing values kept).  Partial aggregates (min_by/max_by) keep a hot
    session splittable.
    """
    order = F.struct(F.col(TS).isNull(), F.col(TS), F.col(ord_col))
    is_hit = F.col(EVENT) == vocab.hit
    g = dlog.where(F.col("PlayPeriod") == GAME).withColumn("_ptr_sk", _sk(keys))
    g = g.withColumn("second", trunc_ts(TS, bucket))
    agg = g.groupBy("_ptr_sk", "second").agg(
        F.coalesce(F.bool_or(is_hit), F.lit(False)).alias("has_hit"),
        F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), F.when(is_hit, order)).alias("_first_hit"),
        F.max_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), order).alias("_last"),
    )
    pick = F.when(F.col("has_hit"), F.col("_first_hit")).otherwise(F.col("_last"))
    out = agg.select(
        "_ptr_sk",
        "second",
        "has_hit",
        pick["x"].alias("x"),
        pick["y"].alias("y"),
        F.lit("laser").alias("id"),
        F.lit("Laser").alias("name"),
        F.lit(1.0).alias("size"),
    )
    return _expand(out, keys, "_ptr_sk")


def pointer_mean(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    bucket: str = "second",
    x: str = "RightControllerLaserPosWorldX",
    y: str = "RightControllerLaserPosWorldY",
) -> DataFrame:
    """Mean pointer x/y per session and bucket over Game rows (NaN/NULL skipped)."""
    g = dlog.where(F.col("PlayPeriod") == GAME).withColumn("second", trunc_ts(TS, bucket))
    return g.groupBy(*keys, "second").agg(
        F.avg(nan_to_null(x)).alias("laser_x"), F.avg(nan_to_null(y)).alias("laser_y")
    )


def axis_range(
    dlog: DataFrame,
    x: str = "MolePositionWorldX",
    y: str = "MolePositionWorldY",
    pad: float = 1.0,
) -> DataFrame:
    """Plot ranges, global min - pad and max + pad of x and y over all rows."""
    return dlog.agg(
        (F.min(nan_to_null(x)) - pad).alias("x_min"),
        (F.max(nan_to_null(x)) + pad).alias("x_max"),
        (F.min(nan_to_null(y)) - pad).alias("y_min"),
        (F.max(nan_to_null(y)) + pad).alias("y_max"),
    )


def trial_outcome_rates(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    result_col: str = "TrialResult",
    feedback_col: str = "TrialFeedback",
    decision_event: str = "GameDecision",
    fish_event: str = "FishEvent",
    ord_col: str = "_ord",
    pam_conditions: dict[str, str] | None = None,
    grains: Sequence[str] = DEFAULT_GRAINS,
    carry: Sequence[str] = (),
    condition_col: str = "Condition",
) -> DataFrame:
    """A12 (+W7): trial-outcome counts and rates per session.

    Counts of result / feedback classes, decisions not followed by a fish
    event (``lead(Event)``), five rates and the positive rate, and the
    condition-dependent rate (``pam_rate``, by ``condition_col``, which is a key or
    carried).  ``carry`` columns are constant within a session and travel along.
    NULL-safe counts throughout.
    """
    # Outcome classes and output column names of the trial log.
    #   accept AccInput; reject RejInput; assist AssistSuccess, AugSuccess;
    #   sham ExplicitSham, OverrideInput; mitigate-fail AssistFail, MitigateFail;
    #   positive OverrideInput, AccInput, AugSuccess, ExplicitSham, AssistSuccess;
    #   feedback FishCaught, Reel, Stay, Unreel, FishLost;
    #   condition rates AS -> assist, IO -> sham, MF -> mitigate.
    pam_conditions = pam_conditions or {"AS": "trial_rate_assist", "IO": "trial_rate_sham", "MF": "trial_rate_mitigate"}
    r = F.col(result_col)
    fb = F.col(feedback_col)
    # "decision whose next row is not a fish event" is counted on the next row:
    # previous Event is the decision and this Event is not a fish event.  The
    # previous row comes from the chunked scan, so a hot session stays split.
    ties = (ord_col,) if ord_col in dlog.columns else ()
    df = running_scan(
        dlog, keys, TS, ties, {"_prev_event": ("prev", EVENT), "_prev_result": ("prev", result_col)}, grains
    )
    decided = (F.col("_prev_event") == decision_event) & (F.col(EVENT) != fish_event)
    df = df.withColumn("_decided", F.coalesce(decided, F.lit(False)))
    # reel / escape look at the decision row's result, i.e. the previous row here
    prev_r = F.col("_prev_result")

    def n(cond):
        return F.count_if(F.coalesce(cond, F.lit(False)))

    agg = df.groupBy(*keys).agg(
        n(r == "RejInput").alias("rejInput"),
        n(r == "AccInput").alias("accInput"),
        n(r.isin("OverrideInput", "AccInput", "AugSuccess", "ExplicitSham", "AssistSuccess")).alias("posTrial"),
        n(r.isin("AssistSuccess", "AugSuccess")).alias("assistInput"),
        n(r.isin("ExplicitSham", "OverrideInput")).alias("explicitSham"),
        n(r.isin("AssistFail", "MitigateFail")).alias("mitigateFail"),
        F.count(r).alias("totalTrials2"),
        n(fb == "FishCaught").alias("fishCaught"),
        n(fb == "Reel").alias("fishReel"),
        n(fb == "Stay").alias("fishStay"),
        n(fb == "Unreel").alias("fishUnreel"),
        n(fb == "FishLost").alias("fishLost"),
        n(F.col("_decided")).alias("notFishCaught"),
        n(F.col("_decided") & ~F.coalesce(prev_r.isin("RejInput", "AssistFail", "MitigateFail"), F.lit(False))).alias("reel"),
        n(F.col("_decided") & F.coalesce(prev_r == "RejInput", F.lit(False))).alias("escape"),
        F.sum("Time_delta").alias("time_total"),
        *[F.min(c).alias(c) for c in carry],
    )
    total = F.col("rejInput") + F.col("accInput") + F.col("assistInput") + F.col("explicitSham") + F.col("mitigateFail")
    out = agg.withColumn("totalTrials", total).withColumns(
        {
            "trial_rate_accept": F.try_divide(F.col("accInput") + F.col("assistInput"), F.col("totalTrials")),
            "trial_rate_reject": F.try_divide(F.col("rejInput"), F.col("totalTrials")),
            "trial_rate_assist": F.try_divide(F.col("assistInput"), F.col("totalTrials")),
            "trial_rate_sham": F.try_divide(F.col("explicitSham"), F.col("totalTrials")),
            "trial_rate_mitigate": F.try_divide(F.col("mitigateFail"), F.col("totalTrials")),
            "trial_rate_positive": F.try_divide(
                F.col("accInput") + F.col("assistInput") + F.col("explicitSham"),
                F.col("totalTrials") - F.col("mitigateFail"),
            ),
        }
    )
    pam = F.lit(0.0)
    for cond, rate_col in pam_conditions.items():
        pam = F.when(F.col(condition_col) == cond, F.col(rate_col)).otherwise(pam)
    return out.withColumn("pam_rate", pam)
