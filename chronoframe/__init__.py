"""chronoframe: session-log analytics on Spark DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame``; keys, event
vocabulary and time grain are arguments.  See README.md for the operator map.
"""

from chronoframe.config import (
    EventVocab,
    GAME_VOCAB,
    SESSION_KEYS,
    build_session,
    checkpoint_dir,
)

__all__ = ["EventVocab", "GAME_VOCAB", "SESSION_KEYS", "build_session", "checkpoint_dir"]
