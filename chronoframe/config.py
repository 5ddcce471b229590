"""Column names, event vocabulary, session keys and the Spark session factory."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# ---------------------------------------------------------------------------
# Names that must equal those of the game logs being analysed.
# Log columns: Timestamp, Event, Participant, Condition, SessionID, filename,
#   Framecount, GameTimeSpent, MoleId, MoleSize,
#   MolePositionWorldX, MolePositionWorldY, MolePositionWorldZ,
#   RightControllerLaserPosWorldX, RightControllerLaserPosWorldY,
#   RightControllerLaserPosWorldZ,
#   WorldGazeHitPositionX, WorldGazeHitPositionY, WorldGazeHitPositionZ,
#   GazeConfidence, ParticipantID
# Phase labels: PreGame, Game, PostGame
# Events: "Game Started"; "Game Finished", "Game Stopped"; "Sample";
#   "Mole Spawned", "Mole Expired", "Mole Hit"
# Meta renames: Timestamp -> MetaTimestamp, Email -> MetaEmail,
#   Framecount -> MetaFramecount
# Path fields: i0..i4 from "/" segments, i5..i13 from "_" segments; i1 is the
#   condition folder.
# ---------------------------------------------------------------------------
TS = "Timestamp"
EVENT = "Event"
ORD = "_ord"
PARTICIPANT = "Participant"
CONDITION = "Condition"
SESSION_KEYS = (PARTICIPANT, CONDITION)

PRE_GAME, GAME, POST_GAME = "PreGame", "Game", "PostGame"

NUMERIC_COLUMNS = (
    "Participant",
    "Framecount",
    "GameTimeSpent",
    "MolePositionWorldX",
    "MolePositionWorldY",
    "MolePositionWorldZ",
    "RightControllerLaserPosWorldX",
    "RightControllerLaserPosWorldY",
    "RightControllerLaserPosWorldZ",
)
GAZE_COLUMNS = (
    "WorldGazeHitPositionX",
    "WorldGazeHitPositionY",
    "WorldGazeHitPositionZ",
    "GazeConfidence",
)
META_RENAMES = {"Timestamp": "MetaTimestamp", "Email": "MetaEmail", "Framecount": "MetaFramecount"}
SLASH_FIELDS = ("i0", "i1", "i2", "i3", "i4")
UNDERSCORE_FIELDS = ("i5", "i6", "i7", "i8", "i9", "i10", "i11", "i12", "i13")


@dataclass(frozen=True)
class EventVocab:
    """Which ``Event`` values mark start, end, samples and object activity."""

    start: tuple[str, ...] = ("Game Started",)
    end: tuple[str, ...] = ("Game Finished", "Game Stopped")
    sample: str = "Sample"
    spawn: str = "Mole Spawned"
    expire: str = "Mole Expired"
    hit: str = "Mole Hit"

    @property
    def markers(self) -> tuple[str, ...]:
        return tuple(self.start) + tuple(self.end)

    @property
    def activity(self) -> tuple[str, ...]:
        # de-duplicated, order kept: a vocabulary may reuse one event for two roles
        return tuple(dict.fromkeys((self.hit, self.expire, self.spawn)))


GAME_VOCAB = EventVocab()

# Chunk grains for the skew-safe running scans (operators/scan.py): rows are
# scanned inside (session, minute) chunks and the per-minute carries with one
# window per session over its minutes.  Per-task work is bounded by the rows
# of one session-minute and by the minutes of one session (5.3e5 per year);
# add coarser grains, e.g. ("minute", "day"), for sessions spanning decades.
DEFAULT_GRAINS = ("minute",)


def _master_is_configured() -> bool:
    """Whether a cluster or an earlier session already decides master and memory."""
    if SparkContext._active_spark_context is not None:
        return True
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        SparkContext._ensure_initialized()
        return SparkConf().contains("spark.master")
    submit_args = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    return "--master" in submit_args or "spark.master" in submit_args or "MASTER" in os.environ


def build_session(
    master: str | None = None,
    app_name: str = "chronoframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session for a job, the tests or the bench.

    With a master configured elsewhere (spark-submit, an active session) only
    the arguments given here are set.  Otherwise it is a local run: AQE on, UI
    off, UTC, Arrow on, partitions and memory for one machine.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and _master_is_configured():
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = (
            builder.master(master or f"local[{cpus}]")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            # small local inputs: let AQE keep a few post-shuffle partitions busy
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
            # broadcast only what AQE has measured at runtime to be below this size
            .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "16g")
        )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is only read here.
    Where it is unset, a ``local`` master gets a scratch folder; any other
    master raises, since executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {sc.master}")
        current = tempfile.mkdtemp(prefix="chronoframe-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
