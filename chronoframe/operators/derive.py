"""Derive the typed session log (C1) and its window columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.config import (
    CONDITION,
    DEFAULT_GRAINS,
    EVENT,
    GAME,
    GAME_VOCAB,
    NUMERIC_COLUMNS,
    ORD,
    PARTICIPANT,
    POST_GAME,
    PRE_GAME,
    SESSION_KEYS,
    TS,
    EventVocab,
)
from chronoframe.functions.scalars import in_set, parse_log_ts, secs, to_numeric, trunc_ts, unit_micros
from chronoframe.operators.scan import CHUNK_KEYS, Stored, running_scan

def _ties(df: DataFrame, ord_col: str | None) -> tuple[str, ...]:
    return (ord_col,) if ord_col and ord_col in df.columns else ()


def clean_log(raw: DataFrame, numeric: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Parse Timestamp, put Timestamp/Event first, rename, cast numbers.

    ``i1`` becomes Condition and ``ParticipantID`` becomes Participant when
    present (and the target name is free); the listed numeric columns get a
    lenient cast (bad text -> NULL).
    """
    renames = {
        k: v
        for k, v in {"i1": CONDITION, "ParticipantID": PARTICIPANT}.items()
        if k in raw.columns and v not in raw.columns  # an existing column keeps its name
    }
    df = raw.withColumnsRenamed(renames) if renames else raw
    ts_type = dict(df.dtypes).get(TS, "string")
    df = df.withColumn(TS, parse_log_ts(TS, ts_type))
    casts = {c: to_numeric(c) for c in numeric if c in df.columns}
    df = df.withColumns(casts) if casts else df
    rest = [c for c in df.columns if c not in (TS, EVENT)]
    return df.select(TS, EVENT, *rest)


def play_phase(count_col: str, is_end) -> F.Column:
    """PlayPeriod from the inclusive running marker count; end rows are Game."""
    c = F.col(count_col)
    return (
        F.when(is_end, F.lit(GAME))
        .when(c < 1, F.lit(PRE_GAME))
        .when(c > 1, F.lit(POST_GAME))
        .otherwise(F.lit(GAME))
    )


def play_period(
    df: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    ord_col: str | None = ORD,
    grains: Sequence[str] = DEFAULT_GRAINS,
) -> DataFrame:
    """PreGame / Game / PostGame from the running count of start+end markers."""
    is_end = in_set(EVENT, vocab.end)
    marked = df.withColumn("_mark", in_set(EVENT, vocab.markers).cast("int"))
    out = running_scan(marked, keys, TS, _ties(df, ord_col), {"_c": ("sum", "_mark")}, grains)
    return out.withColumn("PlayPeriod", play_phase("_c", is_end)).drop("_mark", "_c")


def time_delta(
    df: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    ord_col: str | None = ORD,
    grains: Sequence[str] = DEFAULT_GRAINS,
) -> DataFrame:
    """Seconds since the previous row of the group; first row / NULL -> 0."""
    out = running_scan(df, keys, TS, _ties(df, ord_col), {"_prev_ts": ("prev", TS)}, grains)
    return out.withColumn("Time_delta", F.coalesce(secs(TS, "_prev_ts"), F.lit(0.0))).drop("_prev_ts")


def sample_rate(
    df: DataFrame,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Number of sample rows in the row's wall-clock bucket (Hz for 'second').

    Counted across all sessions unless ``keys`` are given.  A grouped count
    (map-side partial aggregation) joined back, not a window: a hot second
    never lands in a single window task.  Rows without a time share one bucket;
    without ``keys`` its count is a single number, and those rows are spread by
    their hash and join nothing.  A left join to unique buckets: where ``Hz`` is not
    read, Spark drops the join and the count with it.
    """
    rows = df.drop("Hz")  # an existing Hz is replaced
    count = F.count_if(F.col(EVENT) == vocab.sample).alias("Hz")
    untimed = F.col(TS).isNull()
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    spread = [] if keys else [F.when(untimed, F.xxhash64(*plain))]
    with_b = rows.withColumn("_rate_bucket", F.struct(trunc_ts(TS, bucket), *keys, *spread))
    counted = with_b if keys else with_b.where(~untimed)
    rated = with_b.join(counted.groupBy("_rate_bucket").agg(count), "_rate_bucket", "left").drop("_rate_bucket")
    if keys:
        return rated
    return rated.withColumn("Hz", F.when(untimed, rows.where(untimed).agg(count).scalar()).otherwise(F.col("Hz")))


def _with_rate_rows(df: DataFrame, keys: Sequence[str], vocab: EventVocab, bucket: str) -> DataFrame:
    """The rows (``_row`` 1) and, per session and bucket, one row at the bucket's start with its count.

    In time order the count row comes right before the bucket's rows, so the
    running scan finds a row's rate by looking back.
    """
    timed = df.where(F.col(TS).isNotNull()).withColumn("_rb", trunc_ts(TS, bucket))
    # one pass over the rows gives a count per session and second; a second's are one row a session
    per = timed.groupBy(*keys, "_rb").agg(F.count_if(F.col(EVENT) == vocab.sample).alias("_n"))
    starts = per.withColumn("_hz", F.sum("_n").over(Window.partitionBy("_rb")))
    starts = starts.select(*keys, F.col("_rb").alias(TS), "_hz", F.lit(0).alias("_row"))
    return df.withColumn("_row", F.lit(1)).unionByName(starts, allowMissingColumns=True)


def _with_stored_rate(df: DataFrame, vocab: EventVocab, bucket: str) -> DataFrame:
    """``_hz`` of the row's bucket on a clustered table: one map of buckets a chunk, so no row moves."""
    timed = df.where(F.col(TS).isNotNull())
    per = timed.groupBy(*CHUNK_KEYS, trunc_ts(TS, bucket).alias("_rb")).agg(
        F.count_if(F.col(EVENT) == vocab.sample).alias("_n")
    )
    rates = per.withColumn("_hz", F.sum("_n").over(Window.partitionBy("_rb")))
    entries = F.map_from_entries(F.collect_list(F.struct("_rb", "_hz"))).alias("_rates")
    joined = df.join(rates.groupBy(*CHUNK_KEYS).agg(entries), list(CHUNK_KEYS), "left")
    return joined.withColumn("_hz", F.try_element_at("_rates", trunc_ts(TS, bucket))).drop("_rates")


def game_clock(
    df: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
) -> DataFrame:
    """First start / first end per group and the time since / until them."""
    sk = F.struct(*keys)
    marks = (
        df.select(sk.alias("_clock_sk"), TS, EVENT)
        .groupBy("_clock_sk")
        .agg(
            F.min(F.when(in_set(EVENT, vocab.start), F.col(TS))).alias("GameStarted"),
            F.min(F.when(in_set(EVENT, vocab.end), F.col(TS))).alias("GameFinished"),
        )
    )
    # existing clock columns are replaced
    out = df.drop("GameStarted", "GameFinished").withColumn("_clock_sk", sk).join(marks, "_clock_sk").drop("_clock_sk")
    return _clock_columns(out)


def _clock_columns(df: DataFrame) -> DataFrame:
    spent = secs(TS, "GameStarted")
    left = secs("GameFinished", TS)
    return df.withColumn("GameTimeSpent", spent).withColumn("GameTimeLeft", left)


def derive_session_log(
    raw: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    ord_col: str | None = ORD,
    grains: Sequence[str] = DEFAULT_GRAINS,
    rate_bucket: str = "second",
    rate_keys: Sequence[str] = (),
    clean: bool = True,
    fuse_rate: bool = True,
) -> DataFrame:
    """Clean, then PlayPeriod, Time_delta, Hz, GameStarted/Finished, clocks.

    W1, W2 and W4 come out of one running scan (one shuffle of the rows).  W3:
    with ``fuse_rate`` (default) one narrow row per session and bucket brings the
    bucket's sample count into the same scan, so the rows are not shuffled
    again; otherwise (or with ``rate_keys``, or a bucket longer than the scan's
    chunks) the counts are joined back by bucket, a second shuffle of the rows.
    With ``Stored`` as first grain and a table bucketed by its chunks
    (``write_clustered``) no row is shuffled at all.
    """
    df = clean_log(raw) if clean else raw
    # re-deriving a derived log replaces its derived columns (GameTimeSpent is
    # a raw column too and is replaced in place)
    df = df.drop("PlayPeriod", "Time_delta", "Hz", "GameStarted", "GameFinished", "GameTimeLeft")
    stored = bool(grains) and isinstance(grains[0], Stored)
    original = [c for c in df.columns if not (stored and c in CHUNK_KEYS)]
    # Hz comes out of the scan when every rate bucket lies inside one chunk
    own_rate = stored and not rate_keys and unit_micros(grains[0].grain) % unit_micros(rate_bucket) == 0
    fuse_rate = (
        fuse_rate
        and not stored
        and not rate_keys
        and bool(grains)
        and grains[0] in ("minute", "hour", "day")
        and unit_micros(grains[0]) % unit_micros(rate_bucket) == 0
    )
    is_end = in_set(EVENT, vocab.end)
    if fuse_rate:
        rows = _with_rate_rows(df, keys, vocab, rate_bucket)
    else:
        rows = (_with_stored_rate(df, vocab, rate_bucket) if own_rate else df).withColumn("_row", F.lit(1))
    marked = rows.withColumns(
        {
            "_mark": in_set(EVENT, vocab.markers).cast("int"),
            "_start_ts": F.when(in_set(EVENT, vocab.start), F.col(TS)),
            "_end_ts": F.when(is_end, F.col(TS)),
            "_real_ts": F.when(F.col("_row") == 1, F.col(TS)),
        }
    )
    ops = {"_c": ("sum", "_mark"), "_prev_ts": ("prev_time", "_real_ts")}
    if fuse_rate:
        ops["_rate"] = ("prev_nonnull_local", "_hz")
    scanned = running_scan(
        marked,
        keys,
        TS,
        ("_row", *_ties(df, ord_col)),
        ops,
        grains,
        session_aggs={"GameStarted": ("min", "_start_ts"), "GameFinished": ("min", "_end_ts")},
    ).where("_row = 1")
    out = scanned.withColumns(
        {
            "PlayPeriod": play_phase("_c", is_end),
            "Time_delta": F.coalesce(secs(TS, "_prev_ts"), F.lit(0.0)),
        }
    )
    if fuse_rate or own_rate:
        rate = F.col("_rate" if fuse_rate else "_hz")
        untimed = df.where(F.col(TS).isNull()).agg(F.count_if(F.col(EVENT) == vocab.sample)).scalar()
        out = out.withColumn("Hz", F.when(F.col(TS).isNull(), untimed).otherwise(rate))
    else:
        out = sample_rate(out, vocab, rate_bucket, rate_keys)
    out = _clock_columns(out)
    tail = ["PlayPeriod", "Time_delta", "Hz", "GameStarted", "GameFinished", "GameTimeLeft"]
    head = list(original)
    if "GameTimeSpent" not in head:
        tail.insert(4, "GameTimeSpent")
    return out.select(*head, *tail)
