"""Session logs persisted by session and time chunk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chronoframe.config import ORD, SESSION_KEYS, TS
from chronoframe.operators.scan import CHUNK_KEYS, with_chunks


def write_clustered(
    df: DataFrame,
    table: str,
    path: str,
    keys: Sequence[str] = SESSION_KEYS,
    time_col: str = TS,
    ties: Sequence[str] = (ORD,),
    grain: str | int = "hour",
    buckets: int | None = None,
) -> DataFrame:
    """Persist a log as the table ``table`` at ``path``, bucketed by (session, time chunk); returns the table.

    Scans with ``Stored(grain)`` as first grain (W1, W2, C1) then read the
    buckets as they lie, without an exchange of rows, and aggregates by session
    exchange one row a session and bucket.  A bucket holds chunks of many sessions and a
    session lies in many buckets, so one long session loads no task more than the others.
    Rows are in time order inside a bucket.  NULL keys are a session; rows
    without a time have chunks of their own.  An empty log gives an empty table.

    ``buckets`` (default: the session's shuffle partitions) should not be below the
    shuffle partitions of the jobs that read the table: Spark then shuffles again for more tasks.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = with_chunks(df, keys, time_col, ties, grain)
    # the exchange of the write: one file a bucket
    rows = chunked.repartition(n, *CHUNK_KEYS)
    writer = rows.write.bucketBy(n, *CHUNK_KEYS).sortBy(*CHUNK_KEYS, time_col, *ties)
    writer.mode("overwrite").option("path", path).option("compression", "snappy").saveAsTable(table)
    return df.sparkSession.table(table)
