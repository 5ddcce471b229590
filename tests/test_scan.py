"""The chunked running scan equals a plain whole-group window, skew and NULLs included."""

import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators.scan import _UNTIMED_BITS, EquiDepth, _untimed_chunk, running_scan

OPS = {"s": ("sum", "flag"), "p": ("prev", "v"), "q": ("prev_nonnull", "v"), "l": ("prev_time", "lt")}


def _df(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        # one hot key holds about half the rows; NULL keys and NULL times present
        k = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        t = None if rnd.random() < 0.05 else rnd.randint(0, 4 * 86400) + rnd.random()
        v = None if rnd.random() < 0.4 else rnd.randint(0, 9)
        rows.append((k, t, i, int(rnd.random() < 0.3), v))
    df = spark.createDataFrame(rows, "k string, t double, o long, flag int, v int")
    df = df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")).cast("timestamp_ntz"))
    return df.withColumn("lt", F.when(F.col("flag") == 0, F.col("ts")))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("grains", [("minute", "day"), ("second", "hour", "day"), (7,), (EquiDepth(9),)])
def test_chunked_equals_plain(spark, seed, grains):
    df = _df(spark, seed)
    plain = {r["o"]: (r["s"], r["p"], r["q"], r["l"]) for r in running_scan(df, ["k"], "ts", ["o"], OPS, ()).collect()}
    chunked = {r["o"]: (r["s"], r["p"], r["q"], r["l"]) for r in running_scan(df, ["k"], "ts", ["o"], OPS, grains).collect()}
    assert chunked == plain


def test_session_aggs(spark):
    df = _df(spark, 3).withColumn("m", F.when(F.col("flag") == 1, F.col("ts")))
    aggs = {"first_m": ("min", "m"), "last_m": ("max", "m")}
    a = {r["o"]: (r["first_m"], r["last_m"]) for r in running_scan(df, ["k"], "ts", ["o"], {}, (), aggs).collect()}
    b = {r["o"]: (r["first_m"], r["last_m"]) for r in running_scan(df, ["k"], "ts", ["o"], {}, ("minute", "day"), aggs).collect()}
    assert a == b


def test_rows_without_a_time_are_spread(spark):
    """Half of one session's rows lack a time: same values, and no chunk holds many of them."""
    n = 400_000
    df = spark.range(n).selectExpr(
        "id o", "'k' k", "cast(id % 3 = 0 as int) flag", "cast(id % 7 as int) v",
        "case when id % 2 = 0 then timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 10) end ts",
    )
    ops = {"s": ("sum", "flag"), "q": ("prev_nonnull", "v")}
    total = F.sum(F.xxhash64("o", "s", "q").cast("decimal(20,0)"))
    chunked = running_scan(df, ["k"], "ts", ["o"], ops, ("minute",))
    assert chunked.agg(total).first() == running_scan(df, ["k"], "ts", ["o"], ops, ()).agg(total).first()
    sizes = df.where("ts is null").groupBy(_untimed_chunk(df, ["o"])).count().collect()
    assert len(sizes) == -(-n // (1 << _UNTIMED_BITS)) and max(r["count"] for r in sizes) <= 1 << _UNTIMED_BITS


def test_untimed_chunks_follow_the_ties(spark):
    """Ties of any sign and size: chunk keys keep their order, NULL ties come last, and never meet timed chunks."""
    ties = [-(1 << 63), -(1 << 40), -1, 0, 1, 1 << 20, (1 << 63) - 1, None]
    df = spark.createDataFrame([(t,) for t in ties], "o long")
    keys = [r["c"] for r in df.select("o", _untimed_chunk(df, ["o"]).alias("c")).orderBy(F.col("o").asc_nulls_last()).collect()]
    assert keys == sorted(keys) and keys[-1] > keys[-2] and min(keys) >= 1 << 62


@pytest.mark.parametrize("timed", [True, False])
def test_one_session_in_one_minute(spark, timed):
    """Calendar grains cannot split it; equi-depth chunks can: equal values, the largest within twice the mean."""
    n, chunks = 60_000, 12
    df = spark.range(n).selectExpr(
        "struct(id) o", "'k' k", "cast(id % 3 = 0 as int) flag", "case when id % 5 = 0 then cast(id % 7 as int) end v",
        f"case when {str(timed).lower()} then timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 50) end ts",
    ).repartition(5)
    ops = {"s": ("sum", "flag"), "q": ("prev_nonnull", "v"), "p": ("prev", "ts")}
    total = F.sum(F.xxhash64("o", "s", "q", "p").cast("decimal(20,0)"))
    scanned = running_scan(df, ["k"], "ts", ["o"], ops, (EquiDepth(chunks),))
    assert scanned.agg(total).first() == running_scan(df, ["k"], "ts", ["o"], ops, ()).agg(total).first()
    sizes = df.repartitionByRange(chunks, "k", F.col("ts").asc_nulls_last(), "o").groupBy(F.spark_partition_id()).count()
    counts = [r["count"] for r in sizes.collect()]
    assert len(counts) == chunks and max(counts) <= 2 * n / chunks
