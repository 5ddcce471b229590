"""Skew-safe running scans over time-ordered groups.

A plain ``Window.partitionBy(session).orderBy(ts)`` puts a whole session into
one task; with one session holding a third of the log that task is the job.
``running_scan`` instead computes each running value in two (or more) levels:

1. rows are cut into chunks ``(session, floor(ts, grain))``; a partial+final
   hash aggregate summarises every chunk (sum, last value, last non-null);
2. the chunk table (rows / rows-per-chunk) gets the same scan recursively on
   the next coarser grain, which yields the carry entering each chunk;
3. rows join their chunk's carry on ``(session, chunk)`` and finish with a
   window partitioned by ``(session, chunk)``; the join and that window share
   one hash partitioning, so rows are shuffled once.

Per-task work is bounded by the largest chunk, not the largest session.
Scan kinds (ordered by ``time`` NULLS LAST, then the tie columns):
``sum`` inclusive running sum (NULL counts as 0), ``prev`` value of the
previous row, ``prev_nonnull`` last non-NULL value strictly before the row.
``session_aggs`` (``min``/``max``) are whole-group aggregates delivered with
the carry, so they cost no extra pass over the rows.  ``prev_time`` is
``prev_nonnull`` of a column that equals the time or is NULL (its carry is a
plain maximum); ``prev_nonnull_local`` looks back inside the first grain's chunk
only and has no carry.  Rows without a time are chunked by their tie column
when it is an integer, so they spread over tasks as well.  ``EquiDepth`` in place of
the calendar grains cuts chunks of equal row counts instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import epoch_micros, unit_micros
from chronoframe.sources.tables import stage_table

SCAN_KINDS = ("sum", "prev", "prev_nonnull", "prev_time", "prev_nonnull_local")
_SK = "_scan_sk"
CHUNK_KEYS = (_SK, "_scan_chunk0")
# Chunk keys are longs: time in units of the grain; rows whose time is NULL are numbered from here, in tie order.
_UNTIMED = 1 << 62
_UNTIMED_BITS = 16  # consecutive tie values that share a chunk
_COARSER_BITS = 8  # chunks of rows without a time that share a chunk one level up


class EquiDepth:
    """A grain of chunks of about equal row counts, cut at sampled quantiles of (group, time, ties).

    Unlike calendar grains it splits the rows of one instant and rows without
    a time, whatever their tie column.  It costs one more exchange: the
    rows are range-partitioned and written once, so that both passes see the same chunks.
    """

    def __init__(self, chunks: int | None = None):
        self.chunks = chunks  # default: CHUNKS_PER_PARTITION for each shuffle partition

    CHUNKS_PER_PARTITION = 8


class Stored:
    """The finest grain of a table that ``with_chunks`` keyed: its group and chunk columns are used as they stand.

    On a table bucketed by them the scan moves no row.
    """

    def __init__(self, grain: str | int):
        self.grain = grain


def with_chunks(df: DataFrame, keys: Sequence[str], time_col: str, ties: Sequence[str], grain: str | int) -> DataFrame:
    """``df`` with its group and chunk columns (``CHUNK_KEYS``), for a scan with ``Stored(grain)``.

    The group is text (the keys as JSON, NULL keys left out): Spark shuffles a struct with
    floating-point fields again, since it rewrites them before it compares.
    """
    group, chunk = CHUNK_KEYS
    kinds = dict(df.dtypes)
    plain = lambda k: (F.col(k) + 0.0 if kinds[k] in ("double", "float") else F.col(k)).alias(k)  # noqa: E731 - no -0.0
    return df.withColumns(
        {group: F.to_json(F.struct(*map(plain, keys))), chunk: _chunk(df, time_col, ties, grain, None)}
    )


def _untimed_chunk(df: DataFrame, ties: Sequence[str]) -> Column:
    """Chunk of a row without a time: by its integer tie column, in tie order."""
    kinds = dict(df.dtypes)
    if not ties or kinds[ties[-1]] not in ("bigint", "int"):
        return F.lit(_UNTIMED)
    step = F.shiftright(F.col(ties[-1]).cast("long"), _UNTIMED_BITS) + (1 << (63 - _UNTIMED_BITS))
    return F.coalesce(step, F.lit(1 << (64 - _UNTIMED_BITS))) + F.lit(_UNTIMED)


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _chunk(df: DataFrame, time_col: str, ties: Sequence[str], grain: str | int, finer: str | int | None) -> Column:
    """Chunk key of a row, or of a chunk of the ``finer`` grain."""
    size = unit_micros(grain)
    if finer is None:
        return F.coalesce(_floor_div(epoch_micros(time_col), size), _untimed_chunk(df, ties))
    c = F.col(time_col)
    timed = _floor_div(c * unit_micros(finer), size)
    return F.when(c < _UNTIMED, timed).otherwise(F.shiftright(c - _UNTIMED, _COARSER_BITS) + F.lit(_UNTIMED))


def _order(time_col: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(time_col).asc_nulls_last()] + [F.col(t).asc_nulls_last() for t in ties]


def _order_key(time_col: str, ties: Sequence[str]) -> Column:
    """Comparable struct with the same order as ``_order`` (NULLs last)."""
    parts: list[Column] = []
    for c in (time_col, *ties):
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(*parts)


def _base_scan(df: DataFrame, sk: str, time_col: str, ties: Sequence[str], ops, session_aggs) -> DataFrame:
    w = Window.partitionBy(sk).orderBy(*_order(time_col, ties))
    upto_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols: dict[str, Column] = {}
    for out, (kind, c) in ops.items():
        if kind == "sum":
            cols[out] = F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto_here), F.lit(0))
        elif kind == "prev":
            cols[out] = F.lag(c).over(w)
        else:
            cols[out] = F.last(c, ignorenulls=True).over(before)
    whole = Window.partitionBy(sk)
    for out, (fn, c) in session_aggs.items():
        cols[out] = getattr(F, fn)(c).over(whole)
    return df.withColumns(cols)


def _equi_depth(df: DataFrame, sk: str, time_col: str, ties: Sequence[str], chunk: str, grain: EquiDepth) -> DataFrame:
    """Rows with their chunk, written once."""
    n = grain.chunks or grain.CHUNKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(sk), *_order(time_col, ties))
    return stage_table(ranged.withColumn(chunk, F.spark_partition_id().cast("long")), "scan-ranges")


def _scan(df, sk, time_col, ties, ops, grains, session_aggs, level=0, finer=None):
    if not grains:
        return _base_scan(df, sk, time_col, ties, ops, session_aggs)
    chunk = f"_scan_chunk{level}"
    own = grains[0].grain if isinstance(grains[0], Stored) else grains[0]
    if isinstance(grains[0], Stored):
        rows, above = df, grains[1:]
    elif isinstance(grains[0], EquiDepth):
        rows, above = _equi_depth(df, sk, time_col, ties, chunk, grains[0]), ()
    else:
        rows, above = df.withColumn(chunk, _chunk(df, time_col, ties, grains[0], finer)), grains[1:]
    key = _order_key(time_col, ties)
    summaries = []
    carried_ops = {out: op for out, op in ops.items() if op[0] != "prev_nonnull_local"}
    for out, (kind, c) in carried_ops.items():
        if kind == "sum":
            s = F.sum(F.coalesce(F.col(c), F.lit(0)))
        elif kind == "prev_time" or (kind == "prev" and c == time_col):
            # last row's time = largest time (NULL only in the all-NULL chunk);
            # a plain max keeps the aggregate hash-based
            s = F.max(F.col(c))
        elif kind == "prev":
            s = F.max_by(F.col(c), key)
        else:
            s = F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key))
        summaries.append(s.alias(f"{out}__s"))
    for out, (fn, c) in session_aggs.items():
        summaries.append(getattr(F, fn)(c).alias(f"{out}__s"))
    chunks = rows.groupBy(sk, chunk).agg(*summaries)

    # carry entering each chunk = scan over the chunk table, one level coarser
    coarser = {"prev_time": "prev_nonnull"}
    sub_ops = {f"{out}__c": (coarser.get(kind, kind), f"{out}__s") for out, (kind, _) in carried_ops.items()}
    sub_sess = {out: (fn, f"{out}__s") for out, (fn, _) in session_aggs.items()}
    carried = _scan(chunks, sk, chunk, (), sub_ops, above, sub_sess, level + 1, own)
    carry_cols = [F.col(sk), F.col(chunk)]
    for out, (kind, _) in carried_ops.items():
        c = F.col(f"{out}__c")
        if kind == "sum":  # inclusive prefix over chunks minus this chunk = exclusive
            c = c - F.coalesce(F.col(f"{out}__s"), F.lit(0))
        carry_cols.append(c.alias(f"{out}__carry"))
    carry_cols += [F.col(out) for out in session_aggs]
    carry = carried.select(*carry_cols)

    joined = rows.join(carry, [sk, chunk])
    w = Window.partitionBy(sk, chunk).orderBy(*_order(time_col, ties))
    upto_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols: dict[str, Column] = {}
    for out, (kind, c) in ops.items():
        if kind == "prev_nonnull_local":
            cols[out] = F.last(c, ignorenulls=True).over(before)
            continue
        carry_c = F.col(f"{out}__carry")
        if kind == "sum":
            cols[out] = F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto_here) + carry_c
        elif kind == "prev":
            cols[out] = F.when(F.row_number().over(w) == 1, carry_c).otherwise(F.lag(c).over(w))
        else:
            cols[out] = F.coalesce(F.last(c, ignorenulls=True).over(before), carry_c)
    out_df = joined.withColumns(cols)
    return out_df.drop(chunk, *[f"{o}__carry" for o in carried_ops])


def running_scan(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    ties: Sequence[str] = (),
    ops: Mapping[str, tuple[str, str]] | None = None,
    grains: Sequence[str | int | EquiDepth | Stored] = ("minute",),
    session_aggs: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add running columns ``{out: (kind, input_col)}`` per group ``keys``.

    ``grains`` (finest first) choose the chunking; ``(EquiDepth(),)`` chunks of
    equal row counts; ``Stored`` first takes the chunks of a clustered table; ``()`` gives the plain single-window plan.  Group keys may be NULL (NULL is a group).
    """
    ops = dict(ops or {})
    session_aggs = dict(session_aggs or {})
    for kind, _ in ops.values():
        if kind not in SCAN_KINDS:
            raise ValueError(f"unknown scan kind {kind!r}")
        if kind == "prev_nonnull_local" and grains and isinstance(grains[0], EquiDepth):
            raise ValueError("prev_nonnull_local needs chunks cut by time")
    for fn, _ in session_aggs.values():
        if fn not in ("min", "max"):
            raise ValueError("session_aggs supports min and max")
    # a struct of the keys compares NULL fields as equal, so plain equi-joins
    # and hash partitioning treat a NULL key as one group
    stored = bool(grains) and isinstance(grains[0], Stored)
    with_key = df if stored else df.withColumn(_SK, F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0))
    out = _scan(with_key, _SK, time_col, tuple(ties), ops, tuple(grains), session_aggs)
    return out.drop(_SK)
