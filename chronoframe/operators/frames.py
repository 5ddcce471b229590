"""Dense per-bucket animation frames from the sparse log.

The original analysis builds frames for one session at a time; here every session is
processed at once, keyed by the session columns.  Scale choices:

* first row per key is a ``min_by`` aggregate (partial aggregation), not a
  window, so a hot key is still combined map-side;
* dense frames are generated per template row from its session span (a
  one-row-per-session table joined by key) with a blocked ``explode``, so no
  task ever materialises "all objects x all seconds" of a session by a join;
* forward fill runs through the chunked running scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT_GRAINS, EVENT, GAME, GAME_VOCAB, ORD, SESSION_KEYS, TS, EventVocab
from chronoframe.functions.scalars import label_text, marker_size, secs, trunc_ts, unit_micros
from chronoframe.operators.scan import running_scan
from chronoframe.operators.summary import pointer_mean, pointer_track, session_span
from chronoframe.sources.tables import stage_table

MOLE_NAME = "Active Mole"
LASER_NAME = "Laser"
LASER_ID = "laser"
_SPINE_BLOCK = 4096
_LADDER = ("second", "minute", "hour", "day", "week")


def coarser_grains(bucket: str, levels: int = 1) -> tuple[str, ...]:
    """Chunk grains for scans over data already floored to ``bucket``."""
    i = _LADDER.index(bucket)
    return _LADDER[i + 1 : i + 1 + levels]


def _bucket_seconds(bucket: str) -> int:
    return unit_micros(bucket) // 1_000_000


def _order_key(time_col: str, ord_col: str | None) -> Column:
    parts = [F.col(time_col).isNull(), F.col(time_col)]
    if ord_col:
        parts += [F.col(ord_col).isNull(), F.col(ord_col)]
    return F.struct(*parts)


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str = TS,
    ord_col: str | None = ORD,
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """The first row of each key in (time, ord) order; NULL is a key value."""
    ord_col = ord_col if ord_col and ord_col in df.columns else None
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), _order_key(time_col, ord_col))
    out = df.groupBy(*keys).agg(first.alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(c) for c in cols])


def distinct_buckets(df: DataFrame, keys: Sequence[str] = SESSION_KEYS, bucket: str = "second") -> DataFrame:
    """The distinct (session, bucket) pairs present in a log."""
    return df.select(*keys, trunc_ts(TS, bucket).alias("second")).dropDuplicates([*keys, "second"])


def object_template(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    size: float | None = None,
    id_col: str = "MoleId",
    x: str = "MolePositionWorldX",
    y: str = "MolePositionWorldY",
) -> DataFrame:
    """One row per (session, object): position of the object's first row."""
    rows = dlog.where(F.col(id_col).isNotNull()).select(
        *keys, TS, *([ORD] if ORD in dlog.columns else []),
        F.col(x).alias("x"), F.col(y).alias("y"), F.col(id_col).alias("id"),
    )
    first = first_per_key(rows, [*keys, "id"], cols=["x", "y"])
    return first.select(
        *keys, "x", "y", "id",
        F.lit(size).cast("double").alias("size"),
        F.lit(MOLE_NAME).alias("name"),
    )


def object_activity(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
    id_col: str = "MoleId",
    x: str = "MolePositionWorldX",
    y: str = "MolePositionWorldY",
) -> DataFrame:
    """Object events of all phases; size 1 on spawn else 0; time floored to bucket."""
    return dlog.where(F.col(EVENT).isin(list(vocab.activity))).select(
        *keys,
        EVENT,
        F.col(x).alias("x"),
        F.col(y).alias("y"),
        F.col(id_col).alias("id"),
        F.when(F.col(EVENT) == vocab.spawn, F.lit(1.0)).otherwise(F.lit(0.0)).alias("size"),
        trunc_ts(TS, bucket).alias("second"),
        F.lit(MOLE_NAME).alias("name"),
        F.col(ORD) if ORD in dlog.columns else F.lit(None).cast("long").alias(ORD),
    )


def pointer_template(dlog: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """C4: one pointer row per session, no position, size 0."""
    return dlog.select(*keys).distinct().select(
        *keys,
        F.lit(None).cast("double").alias("x"),
        F.lit(None).cast("double").alias("y"),
        F.lit(LASER_ID).alias("id"),
        F.lit(0.0).alias("size"),
        F.lit(LASER_NAME).alias("name"),
    )


def _blocked_range(
    df: DataFrame, count_col: str, out_col: str, spread: Sequence[str], block: int = _SPINE_BLOCK
) -> DataFrame:
    """Explode ``0 .. count-1`` per row in blocks spread over the cluster.

    A long span becomes ``count / block`` block rows.  Blocks are hash-spread
    before the inner explode by their number and by the ``spread`` columns, which
    must tell apart the rows that one busy session or object contributes.
    """
    n = F.col(count_col)
    blocks = df.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "_blk", *spread)
    lo = F.col("_blk") * block
    hi = F.least(lo + block - 1, n - 1)
    return blocks.withColumn(out_col, F.explode(F.sequence(lo, hi))).drop("_blk")


def _with_frame_count(spans: DataFrame, bucket: str) -> DataFrame:
    b = _bucket_seconds(bucket)
    return spans.where(F.col("total_time") >= 0).withColumn(
        "_n_frames", (F.floor(F.col("total_time") / F.lit(b)) + 1).cast("int")
    )


def time_spine(spans: DataFrame, keys: Sequence[str] = SESSION_KEYS, bucket: str = "second") -> DataFrame:
    """G1: one row per session and bucket from ``time_start`` for ``total_time`` seconds.

    ``second = time_start + k * bucket`` for k = 0 .. floor(total_time / bucket);
    negative or missing spans give no rows.
    """
    b = unit_micros(bucket)
    counted = _with_frame_count(spans, bucket)
    rows = _blocked_range(counted, "_n_frames", "_k", keys)
    second = F.timestamp_add("MICROSECOND", F.col("_k").cast("long") * F.lit(b), F.col("time_start"))
    return rows.select(*keys, second.alias("second"), "time_start", "total_time")


def _sk(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def _attach_spans(df: DataFrame, spans: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-session span columns onto rows (NULL-safe keys)."""
    s = spans.select(_sk(keys).alias("_fr_sk"), "time_start", "total_time")
    return df.withColumn("_fr_sk", _sk(keys)).join(s, "_fr_sk", how).drop("_fr_sk")


def dense_frames(
    template: DataFrame, spans: DataFrame, keys: Sequence[str] = SESSION_KEYS, bucket: str = "second"
) -> DataFrame:
    """Every template row repeated for every bucket of its session's span."""
    b = unit_micros(bucket)
    rows = _with_frame_count(_attach_spans(template, spans, keys), bucket)
    rows = _blocked_range(rows, "_n_frames", "_k", [*keys, "id"])
    second = F.timestamp_add("MICROSECOND", F.col("_k").cast("long") * F.lit(b), F.col("time_start"))
    return rows.withColumn("second", second).drop("_k")


def unobserved_frames(
    template: DataFrame,
    spans: DataFrame,
    observed: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    bucket: str = "second",
) -> DataFrame:
    """J3+J4: ``dense_frames`` without the buckets in which ``observed`` (keys, id, second) has a row.

    The observed buckets of an object are gathered as one set per block of
    ``_SPINE_BLOCK`` buckets and meet the block's row before it is exploded, so no
    dense row is shuffled.  As in ``overlay_anti`` a NULL id meets nothing.
    """
    b = unit_micros(bucket)
    rows = _with_frame_count(_attach_spans(template, spans, keys), bucket).withColumn("_ob_sk", _sk(keys))
    blocks = rows.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n_frames") - 1) / _SPINE_BLOCK).cast("int"))))
    met = _attach_spans(observed.select(*keys, "id", "second"), spans.select(*keys, "time_start", "total_time"), keys)
    gone = F.timestamp_diff("MICROSECOND", F.col("time_start"), F.col("second"))
    met = met.where((gone >= 0) & (F.pmod(gone, F.lit(b)) == 0)).withColumn("_k", F.call_function("div", gone, F.lit(b)))
    sets = met.groupBy(_sk(keys).alias("_ob_sk"), "id", F.floor(F.col("_k") / _SPINE_BLOCK).cast("int").alias("_blk")).agg(
        F.collect_set(F.col("_k").cast("int")).alias("_seen")
    )
    lo = F.col("_blk") * _SPINE_BLOCK
    hi = F.least(lo + _SPINE_BLOCK - 1, F.col("_n_frames") - 1)
    whole = F.sequence(lo, hi)
    free = F.when(F.col("_seen").isNull(), whole).otherwise(F.array_except(whole, F.col("_seen")))
    out = blocks.join(sets, ["_ob_sk", "id", "_blk"], "left").withColumn("_k", F.explode(free))
    second = F.timestamp_add("MICROSECOND", F.col("_k").cast("long") * F.lit(b), F.col("time_start"))
    return out.withColumn("second", second).select(*rows.drop("_ob_sk").columns, "second")


def overlay_anti(
    frames: DataFrame, observed: DataFrame, keys: Sequence[str] = SESSION_KEYS, on: Sequence[str] = ("second", "id")
) -> DataFrame:
    """Drop frame rows for which an observed row exists on (session, *on).

    For frames that are at hand as rows; ``unobserved_frames`` makes and overlays
    them without a shuffle of dense rows.
    """
    obs = observed.select(_sk(keys).alias("_ov_sk"), *on)
    return frames.withColumn("_ov_sk", _sk(keys)).join(obs, ["_ov_sk", *on], "left_anti").drop("_ov_sk")


def fill_down(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    time_col: str,
    ord_col: str | None = None,
    grains: Sequence[str] = DEFAULT_GRAINS,
    default=None,
) -> DataFrame:
    """Last observation carried forward per group in (time, ord) order.

    With ``default`` set, values still missing afterwards become ``default``.
    ``grains`` chunk the scan on the (timestamp) time column, see
    ``operators/scan.py``; ``()`` gives one plain window per group.
    """
    ties = (ord_col,) if ord_col else ()
    ops = {f"_prev_{c}": ("prev_nonnull", c) for c in cols}
    out = running_scan(df, keys, time_col, ties, ops, grains)
    filled = {c: F.coalesce(F.col(c), F.col(f"_prev_{c}")) for c in cols}
    if default is not None:
        filled = {c: F.coalesce(e, F.lit(default)) for c, e in filled.items()}
    return out.withColumns(filled).drop(*ops)


def _relative_seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("second", secs("second", "time_start"))


def _span_grid(spans: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Spans keyed by a NULL-safe struct, with the last bucket index n_last."""
    b = _bucket_seconds(bucket)
    return spans.where(F.col("total_time") >= 0).select(
        _sk(keys).alias("_fr_sk"),
        "time_start",
        "total_time",
        F.floor(F.col("total_time") / F.lit(b)).cast("long").alias("_n_last"),
    )


def _bucket_index(second: Column, bucket: str) -> Column:
    """Whole buckets from the floored span start (negative before it)."""
    return F.floor(
        F.timestamp_diff("MICROSECOND", F.col("time_start"), second) / F.lit(unit_micros(bucket))
    ).cast("long")


def _state_gaps(states: DataFrame, objects: DataFrame, bucket: str, grains) -> DataFrame:
    """Bucket ranges in which an object's carried state is constant.

    ``states``: (_fr_sk, id, _k, second, state) one row per object and observed bucket,
    ``state`` = the object's value after that bucket.  ``objects``: (_fr_sk, id,
    _n_last) every object to densify.  Returns (_fr_sk, id, _lo, _hi, state)
    covering the span's buckets 0.._n_last that hold no observation; before the
    first observation the state is NULL.  Only the sparse observations are
    scanned; the dense rows are generated later by explode.
    """
    scanned = running_scan(
        states, ["_fr_sk", "id"], "second", (), {"_pk": ("prev", "_k"), "_ps": ("prev", "state")}, grains
    )
    inner = scanned.select(
        "_fr_sk", "id",
        (F.coalesce(F.col("_pk"), F.lit(-1).cast("long")) + 1).alias("_lo"),
        (F.col("_k") - 1).alias("_hi"),
        F.col("_ps").alias("state"),
    )
    last = states.groupBy("_fr_sk", "id").agg(
        F.max("_k").alias("_km"), F.max_by("state", "_k").alias("state")
    )
    with_obj = objects.join(last, ["_fr_sk", "id"], "left")
    trailing = with_obj.select(
        "_fr_sk", "id",
        (F.coalesce(F.col("_km"), F.lit(-1).cast("long")) + 1).alias("_lo"),
        F.col("_n_last").alias("_hi"),
        "state",
    )
    if "_n_last" in states.columns:  # span end carried on the state rows: no join needed
        inner = scanned.select(
            "_fr_sk", "id",
            (F.coalesce(F.col("_pk"), F.lit(-1).cast("long")) + 1).alias("_lo"),
            F.least(F.col("_k") - 1, F.col("_n_last")).alias("_hi"),
            F.col("_ps").alias("state"),
        )
    else:
        inner = inner.join(objects, ["_fr_sk", "id"]).select(
            "_fr_sk", "id", "_lo", F.least(F.col("_hi"), F.col("_n_last")).alias("_hi"), "state"
        )
    gaps = inner.unionByName(trailing)
    gaps = gaps.withColumn("_lo", F.greatest(F.col("_lo"), F.lit(0).cast("long")))
    return gaps.where(F.col("_hi") >= F.col("_lo"))


def _explode_gaps(gaps: DataFrame) -> DataFrame:
    """One row per bucket index in [_lo, _hi] (blocked, spread over tasks)."""
    counted = gaps.withColumn("_cnt", (F.col("_hi") - F.col("_lo") + 1).cast("int"))
    rows = _blocked_range(counted, "_cnt", "_j", ["_fr_sk", "id", "_lo"])
    return rows.withColumn("_k", F.col("_lo") + F.col("_j")).drop("_j", "_lo", "_hi")


def _since_start(k: Column, bucket: str) -> Column:
    """Seconds from the floored start to bucket ``k``."""
    return (k * F.lit(_bucket_seconds(bucket))).cast("double")


def _at_bucket(k: Column, bucket: str) -> Column:
    return F.timestamp_add("MICROSECOND", k * F.lit(unit_micros(bucket)), F.col("time_start"))


def animation_frames(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
) -> DataFrame:
    """Object and pointer frames for every session with a start and an end.

    Semantics (per session): template objects (first position, size unknown)
    and one pointer row repeated over the span's buckets (J3); buckets with
    object events take the events instead (J4); size carried forward per
    object in (bucket, row) order, missing -> 0 (W5); buckets with a pointer
    position take it (J5).  ``second`` is seconds since the floored start;
    rows after the last bucket of the span are cut (no lower bound).

    Plan: J3+J4+W5 are fused.  The carried size only depends on the sparse
    object events, so the scan runs over (object, event bucket) rows and
    yields constant-size bucket ranges; dense rows are generated from those
    ranges by explode, never sorted, windowed or anti-joined.  The spans and
    the sparse rows (objects, object events, states, pointer positions) feed
    several branches and are written once each: the log is read once for each.
    """
    grid = stage_table(_span_grid(session_span(dlog, keys, vocab, bucket), keys, bucket), "frame-grid")
    spans = grid.drop("total_time")
    template = object_template(dlog, keys).drop("size").withColumn("_fr_sk", _sk(keys))
    template = stage_table(template.join(grid.select("_fr_sk", "_n_last"), "_fr_sk"), "frame-objects")
    activity = object_activity(dlog, keys, vocab, bucket).withColumn("_fr_sk", _sk(keys)).join(spans, "_fr_sk")
    activity = stage_table(activity.withColumn("_k", _bucket_index(F.col("second"), bucket)), "frame-activity")
    order = F.struct(F.col("_ord").isNull(), F.col("_ord"))
    states = activity.groupBy("_fr_sk", "id", "_k", "second").agg(
        F.max_by("size", order).alias("state"), F.max("_n_last").alias("_n_last")
    )
    states = stage_table(states, "frame-states")
    gaps = _state_gaps(states, template.select("_fr_sk", "id", "_n_last"), bucket, coarser_grains(bucket))
    filled = _explode_gaps(gaps.join(template.drop("_n_last"), ["_fr_sk", "id"])).select(
        *keys, "x", "y", "id", F.coalesce(F.col("state"), F.lit(0.0)).alias("size"), "name",
        _since_start(F.col("_k"), bucket).alias("second"),
    )

    track = pointer_track(dlog, keys, vocab, bucket).withColumn("_fr_sk", _sk(keys)).join(spans, "_fr_sk")
    track = stage_table(track, "frame-track")
    # the pointer's free buckets are the gaps between its observed ones, like an object's
    track_k = track.select(
        "_fr_sk", F.lit(LASER_ID).alias("id"), _bucket_index(F.col("second"), bucket).alias("_k"), "second",
        F.lit(None).cast("double").alias("state"), "_n_last",
    )
    pointers = grid.select("_fr_sk", F.lit(LASER_ID).alias("id"), "_n_last")
    free = _state_gaps(track_k, pointers, bucket, coarser_grains(bucket))
    lasers = _explode_gaps(free).select(
        *[F.col("_fr_sk")[k].alias(k) for k in keys],
        F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
        F.lit(LASER_ID).alias("id"), F.lit(0.0).alias("size"), F.lit(LASER_NAME).alias("name"),
        _since_start(F.col("_k"), bucket).alias("second"),
    )
    # gaps end with the span; observed buckets are cut there
    observed = activity.drop("_fr_sk", "_k", ORD).unionByName(track.drop("_fr_sk"), allowMissingColumns=True)
    last_bucket = F.col("_n_last") * F.lit(_bucket_seconds(bucket))
    observed = _relative_seconds(observed).where(F.col("second") <= last_bucket).drop("time_start", "_n_last")
    frames = filled.unionByName(lasers).unionByName(observed, allowMissingColumns=True)
    return frames.select(
        *keys, "x", "y", "id", "size", marker_size("size").alias("marker_size"), "name", "second", EVENT, "has_hit"
    )


_MEAN_SALTS = 8  # tasks over which the objects of one session and block are spread


def _explode_gaps_with_means(gaps: DataFrame, means: DataFrame) -> DataFrame:
    """As ``_explode_gaps``, with the ``laser_x`` / ``laser_y`` of each bucket.

    ``means``: (_fr_sk, _k, laser_x, laser_y).  A session's means of one block are
    one array with a place for each bucket; it meets the ranges of that block
    before they are exploded.
    """
    block = F.floor(F.col("_k") / _SPINE_BLOCK)
    place = (F.col("_k") - block * _SPINE_BLOCK).cast("int")
    found = F.array_sort(F.collect_list(F.struct(place.alias("i"), "laser_x", "laser_y")))
    arrays = means.groupBy("_fr_sk", block.cast("int").alias("_blk")).agg(found.alias("_found"))
    nothing = F.lit(None).cast("struct<x:double,y:double>")

    def padded(e: Column, n: Column) -> Column:
        skipped = e["i"] - F.coalesce(F.get(F.col("_found"), n - 1)["i"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(nothing, skipped), F.array(F.struct(e["laser_x"].alias("x"), e["laser_y"].alias("y"))))

    arrays = arrays.withColumn("_means", F.flatten(F.transform("_found", padded))).drop("_found")
    arrays = arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_MEAN_SALTS - 1))))
    first, last = (F.floor(F.col(c) / _SPINE_BLOCK).cast("int") for c in ("_lo", "_hi"))
    cut = gaps.withColumn("_blk", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("id", "_lo"), F.lit(_MEAN_SALTS)).cast("int"))
    begin = F.col("_blk").cast("long") * _SPINE_BLOCK
    cut = cut.join(arrays, ["_fr_sk", "_blk", "_salt"], "left")
    ks = F.sequence(F.greatest(F.col("_lo"), begin), F.least(F.col("_hi"), begin + (_SPINE_BLOCK - 1)))
    rows = cut.withColumn("_k", F.explode(ks))
    mean = F.get(F.col("_means"), (F.col("_k") - begin).cast("int"))
    return rows.withColumns({"laser_x": mean["x"], "laser_y": mean["y"]}).drop("_means", "_salt", "_blk", "_lo", "_hi")


def _frames_v2_absolute(dlog, keys, vocab, bucket, means: DataFrame | None = None) -> DataFrame:
    """C6 rows with absolute bucket times (see ``animation_frames_v2``).

    With ``means`` (_fr_sk, second, laser_x, laser_y) also C7's pointer columns.

    Object events are selected by their Event, so it is never NULL on them:
    the Event carried into an unobserved bucket is the last Event of the
    object's previous observed bucket inside the span.  That is one state per
    (object, observed bucket), and the same constant-state ranges as C5.
    """
    grid = _span_grid(session_span(dlog, keys, vocab, bucket), keys, bucket)
    template = object_template(dlog, keys, size=0.0).withColumn("_fr_sk", _sk(keys))
    objects = template.join(grid, "_fr_sk").select("_fr_sk", "id", "_n_last")
    act = object_activity(dlog, keys, vocab, bucket).withColumn("_fr_sk", _sk(keys)).join(grid, "_fr_sk")
    act = act.withColumn("_k", _bucket_index(F.col("second"), bucket))
    # only events inside the span meet a frame row (left join from the spine)
    act = act.where((F.col("_k") >= 0) & (F.col("_k") <= F.col("_n_last"))).join(
        objects.select("_fr_sk", "id"), ["_fr_sk", "id"]
    )
    order = F.struct(F.col(ORD).isNull(), F.col(ORD))
    states = act.groupBy("_fr_sk", "id", "_k", "second").agg(
        F.max_by(EVENT, order).alias("state"), F.max("_n_last").alias("_n_last")
    )
    gaps = _state_gaps(states, objects, bucket, coarser_grains(bucket))
    ranges = gaps.join(template, ["_fr_sk", "id"]).join(grid.drop("_n_last"), "_fr_sk")
    pointer = [] if means is None else ["laser_x", "laser_y"]
    if means is None:
        filled = _explode_gaps(ranges)
    else:
        placed = means.join(grid.select("_fr_sk", "time_start"), "_fr_sk")
        placed = placed.select("_fr_sk", _bucket_index(F.col("second"), bucket).alias("_k"), *pointer).where("_k >= 0")
        filled = _explode_gaps_with_means(ranges, placed)
        act = act.join(means, ["_fr_sk", "second"], "left")  # sparse rows
    filled = filled.select(
        *keys, "id", _at_bucket(F.col("_k"), bucket).alias("second"), "time_start", "x", "y",
        F.col("state").alias(EVENT), *pointer,
    )
    tmpl_xy = template.select("_fr_sk", "id", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    observed = act.join(tmpl_xy, ["_fr_sk", "id"]).select(
        *[F.col("_fr_sk")[k].alias(k) for k in keys], "id", "second", "time_start",
        F.coalesce("_tx", "x").alias("x"), F.coalesce("_ty", "y").alias("y"), EVENT, *pointer,
    )
    out = filled.unionByName(observed)
    out = out.withColumn("size", F.when(F.col(EVENT) == vocab.spawn, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.withColumn("marker_size", marker_size("size"))


def animation_frames_v2(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
) -> DataFrame:
    """Object frames by left join + carried-forward Event (no pre-densified activity).

    Template (size 0) x span buckets LEFT JOIN object events on (bucket, id);
    Event carried forward per object; size 1 while the carried Event is a
    spawn, else 0; several events of one object in one bucket give several
    rows.  Same fused plan as C5: dense rows come from constant-state ranges.
    """
    out = _frames_v2_absolute(dlog, keys, vocab, bucket)
    return _relative_seconds(out).drop("time_start")


def pointer_frames_v2(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
) -> DataFrame:
    """C6 frames with the mean pointer position of their bucket.

    The means come as one array per session and block of buckets and are looked
    up while the frames are made, so no dense row is shuffled.
    """
    means = pointer_mean(dlog, keys, bucket).select(_sk(keys).alias("_fr_sk"), "second", "laser_x", "laser_y")
    out = _frames_v2_absolute(dlog, keys, vocab, bucket, means)
    return _relative_seconds(out).drop("time_start")


def spawn_points(dlog: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """First Game-phase position of each object id (a missing id is one id)."""
    game = dlog.where(F.col("PlayPeriod") == GAME)
    first = first_per_key(game, [*keys, "MoleId"], cols=["MolePositionWorldX", "MolePositionWorldY"])
    return first.withColumn(
        "label", label_text(first, "MoleId", "MolePositionWorldX", "MolePositionWorldY")
    ).withColumn("marker_size", marker_size(F.lit(1.0)))


def sample_rate_series(dlog: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Game-phase (time since start, Hz) points with a series label per session."""
    game = dlog.where(F.col("PlayPeriod") == GAME)
    cols = [*keys, *([ORD] if ORD in dlog.columns else []), "GameTimeSpent", "Hz"]
    return game.select(*cols, label_text(game, *keys).alias("series"))


def trace_union(
    dlog: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    vocab: EventVocab = GAME_VOCAB,
    bucket: str = "second",
) -> DataFrame:
    """Pointer track and object activity stacked as two traces of (second, x)."""
    laser = pointer_track(dlog, keys, vocab, bucket).select(*keys, F.lit("laser").alias("trace"), "second", "x")
    moles = object_activity(dlog, keys, vocab, bucket).select(*keys, F.lit("moles").alias("trace"), "second", "x")
    return laser.unionByName(moles)
