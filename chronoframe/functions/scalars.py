"""Column expressions (all JVM-side built-ins, no Python UDFs).

Timestamps are ``timestamp_ntz`` (wall-clock, like the logs' local times), so
no expression here depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}
# a log line's time: date, time, optional fraction of any length; trailing text ignored
_LOG_TS_PATTERN = r"^\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def unit_micros(unit: str | int) -> int:
    """Length of a grain in microseconds: 'second'..'week' or a number of seconds."""
    seconds = unit if isinstance(unit, int) else _UNIT_SECONDS[unit]
    return int(seconds) * 1_000_000


def epoch_micros(ts: ColumnOrName) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), _c(ts))


def from_epoch_micros(m: ColumnOrName) -> Column:
    return F.timestamp_add("MICROSECOND", _c(m), epoch_ntz())


def trunc_ts(ts: ColumnOrName, unit: str | int) -> Column:
    """Floor a timestamp to a fixed grain (second/minute/hour/day/week or seconds)."""
    m = epoch_micros(ts)
    u = F.lit(unit_micros(unit))
    return from_epoch_micros(m - F.pmod(m, u))


def secs(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``a - b`` in seconds as double (NULL if either is NULL)."""
    return F.timestamp_diff("MICROSECOND", _c(b), _c(a)) / F.lit(1e6)


def parse_log_ts(c: ColumnOrName, dtype: str | None = None) -> Column:
    """Text -> timestamp_ntz; unparsable text -> NULL (never an error).

    Accepts 'YYYY-MM-DD HH:MM:SS[.fraction]' and ignores trailing text; a bare
    date is rejected.  Columns that already hold timestamps are only cast.
    """
    col = _c(c)
    if dtype is not None and dtype.startswith("timestamp"):
        return col.cast("timestamp_ntz")
    return F.regexp_extract(col.cast("string"), _LOG_TS_PATTERN, 0).try_cast("timestamp_ntz")


def to_numeric(c: ColumnOrName) -> Column:
    """Lenient text -> double: bad text gives NULL instead of an error."""
    return _c(c).try_cast("double")


def nan_to_null(c: ColumnOrName) -> Column:
    col = _c(c)
    return F.when(~F.isnan(col), col)


def in_set(c: ColumnOrName, values: Iterable[str]) -> Column:
    """Membership that is never NULL (NULL input -> False)."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))


def clip_values(x: ColumnOrName, lower: float = 0.0, upper: float = 1.0) -> Column:
    """x <= lower -> lower, x >= upper -> upper, else x; NULL and NaN stay NULL."""
    col = _c(x)
    return (
        F.when(col.isNull() | F.isnan(col), F.lit(None).cast("double"))
        .when(col <= F.lit(lower), F.lit(float(lower)))
        .when(col >= F.lit(upper), F.lit(float(upper)))
        .otherwise(col.cast("double"))
    )


def threshold_label(x: ColumnOrName, levels: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the smallest level >= x; above every level, NULL or NaN -> NULL.

    Levels may be unsorted; on duplicate levels the first label wins.
    """
    if len(levels) != len(labels) or not levels:
        raise ValueError("levels and labels must be non-empty and of equal length")
    col = _c(x)
    first_label: dict[float, str] = {}
    for lvl, lab in zip(levels, labels):
        first_label.setdefault(float(lvl), lab)
    expr = None
    for lvl in sorted(first_label):
        cond = col <= F.lit(lvl)
        expr = F.when(cond, F.lit(first_label[lvl])) if expr is None else expr.when(cond, F.lit(first_label[lvl]))
    return F.when(~F.isnan(col.cast("double")), expr)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _digits_text(s: Column) -> Column:
    """Text of a magnitude from its digits ``d`` (no trailing zeros), exponent ``e`` and value ``x``."""
    digits, e = s["d"], s["e"]
    n = F.length(digits)
    whole = F.rpad(F.left(digits, e + 1), e + 1, "0")
    part = F.when(n > e + 1, F.concat(F.lit("."), F.substring(digits, e + 2, n))).otherwise("")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    large = s["x"].try_cast("decimal(38,0)").cast("string")  # more digits than the 15 kept
    plain = F.when(e >= 15, F.coalesce(large, whole)).when(e >= 0, F.concat(whole, part)).otherwise(small)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    size = F.abs(e).cast("string")
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), "0"))
    short = F.concat(F.left(digits, F.lit(1)), tail, power)
    return _bound(
        F.struct(plain.alias("plain"), short.alias("short")),
        lambda t: F.when(F.length(t["plain"]) <= F.length(t["short"]), t["plain"]).otherwise(t["short"]),
    )


def number_text(c: ColumnOrName) -> Column:
    """Text of a floating-point value: 15 significant digits, no trailing zeros.

    Plain digits unless the exponent form is shorter, as in statistical output
    (``1e+05`` but ``123456``).
    """
    x = _c(c).cast("double")

    def parts(sci: Column) -> Column:
        digits = F.rtrim(F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 14)), F.lit("0"))
        exponent = F.substring_index(sci, "e", -1).try_cast("int")
        return F.struct(F.when(digits == "", "0").otherwise(digits).alias("d"), exponent.alias("e"), F.abs(x).alias("x"))

    text = _bound(_bound(F.format_string("%.14e", F.abs(x)), parts), _digits_text)
    special = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Inf").otherwise("-Inf"))
    return F.when(x.isNotNull(), F.coalesce(special, F.concat(F.when(x < 0, "-").otherwise(""), text)))


def label_text(df: DataFrame, *names: str) -> Column:
    """Space-joined text of columns of ``df``; a missing value prints as 'NA'.

    Float and double columns print as ``number_text``; all others as they are.
    """
    kinds = dict(df.dtypes)
    text = [number_text(c) if kinds[c] in ("float", "double") else F.col(c).cast("string") for c in names]
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("NA")) for t in text])


def marker_size(size: ColumnOrName, k: float = 32) -> Column:
    return _c(size) * F.lit(k)
