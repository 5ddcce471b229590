"""Quality classifier from compressed sizes under two zstandard dictionaries.

One dictionary is built from good labelled text, one from bad.  A text is
compressed in small blocks with either; the difference of the two sizes per
byte (small blocks keep a long text from becoming its own dictionary) and its
compression ratio go into a logistic curve fitted on other labelled rows, which
gives the calibrated score.

Only the fit looks at a bounded sample: at most ``sample_rows`` labelled rows per
class for the dictionaries and as many others for the curve, chosen by a hash of
their ids, each of at most ``sample_bytes`` bytes.  Class frequencies count all
labelled rows.  Scoring reads every whole text and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from chronoframe.llm.common import free_name, utf8

SAMPLE_ROWS = 1000
SAMPLE_BYTES = 65536
DICT_BYTES = 32768
PIECE_BYTES = 1024  # length of a dictionary training sample
BLOCK_BYTES = 512
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the curve over (size difference per byte, compression ratio)."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    prior: float  # share of good rows; the score if one class has no rows


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the id as text divisible by 5 (NULL id: never labelled)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def build_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; the joined texts themselves when there are too few to train one."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICT_BYTES:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def sizes(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[int, int]:
    """Compressed bytes of a whole text under either dictionary."""
    blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
    return sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Weighted logistic regression (Newton steps on standardised columns)."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(3)
    penalty = np.diag([0.0, ridge, ridge]) + 1e-9 * np.eye(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty @ w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, grad)
    slopes = w[1:] / sd
    return float(w[0] - slopes @ mean), float(slopes[0]), float(slopes[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> QualityModel:
    """Fit on labelled rows outside the held-out fold; see the module for the bounds.

    Labels other than 0 and 1 and NULL ids are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return QualityModel(b"", b"", (0.0, 0.0, 0.0), prior)
    order = F.xxhash64(F.lit("sample"), "id")
    known = known.withColumn("curve", F.pmod(F.xxhash64(F.lit("use"), "id"), F.lit(2)).cast("int"))
    picks = [
        known.where((F.col("y") == y) & (F.col("curve") == use)).orderBy(order, "id").limit(sample_rows)
        for y in (0, 1)
        for use in (0, 1)
    ]
    picked = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])
    text = F.col("text").cast("string")
    eligible = docs.where(F.octet_length(text).between(1, sample_bytes)).select(F.col(id_col).alias("id"), text.alias("text"))
    # at most 4 * sample_rows ids, whatever the data
    rows = eligible.join(F.broadcast(picked), "id").orderBy("id", "y").limit(4 * sample_rows).collect()
    texts: dict[tuple[int, int], list[bytes]] = {(y, use): [] for y in (0, 1) for use in (0, 1)}
    for r in rows:
        texts[r["y"], r["curve"]].append(utf8(r["text"]))
    good, bad = build_dictionary(texts[1, 0]), build_dictionary(texts[0, 0])
    curve = [(t, y) for y in (0, 1) for t in texts[y, 1]]
    if not texts[0, 1] or not texts[1, 1]:
        return QualityModel(good, bad, (0.0, 0.0, 0.0), prior)
    by_good, by_bad = compressor(good), compressor(bad)
    x = np.array([features(len(t), *sizes(t, by_good, by_bad)) for t, _ in curve])
    y = np.array([label for _, label in curve])
    share = {c: counts[c] / total * len(curve) / len(texts[c, 1]) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return QualityModel(good, bad, fit_curve(x, y, weight), prior)


def features(n: int, good: int, bad: int) -> tuple[float, float]:
    """(size difference per byte, compression ratio); zeros for an empty text."""
    return ((bad - good) / n, min(good / n, 1.5)) if n else (0.0, 0.0)


def score_column(model: QualityModel, text_col: str = "text") -> Column:
    """Calibrated score in [0, 1] of a text column (NULL: the empty text)."""
    if not any(model.weights):
        return F.lit(model.prior)
    good, bad, (w0, w1, w2) = model.good, model.bad, model.weights

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        by_good, by_bad = compressor(good), compressor(bad)
        out = []
        for t in texts:
            raw = utf8(t.as_py())
            difference, ratio = features(len(raw), *sizes(raw, by_good, by_bad))
            out.append(w0 + w1 * difference + w2 * ratio)
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30))))

    return score(F.col(text_col).cast("string"))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted`` (1: kept).

    NULL and empty texts get the curve's value at zero; NULL ids are scored
    like any other; an empty table gives no rows; other columns are ignored.
    """
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored at or above the threshold, columns unchanged."""
    score = free_name(docs, "_score")
    return docs.withColumn(score, score_column(model)).where(F.col(score) >= threshold).drop(score)
