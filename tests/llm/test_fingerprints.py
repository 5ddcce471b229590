import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoframe.llm import fingerprints
from chronoframe.llm.fingerprints import fingerprint_with_edits, hex_signature


def terms(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", text))


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


@pytest.fixture(scope="module")
def related(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    rows, text = [], [rng.choice(vocab) for _ in range(80)]
    for i in range(120):
        if i % 10 == 0:
            text = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        else:
            text = [rng.choice(vocab) if rng.random() < 0.15 else w for w in text]
        rows.append((i * 3, " ".join(text)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_collision_rate_is_generalised_jaccard(related, monkeypatch):
    rows, df = related
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)  # many id ranges
    out = {r["doc_id"]: r for r in fingerprint_with_edits(df).collect()}
    ordered = sorted(rows, reverse=True)
    bias, square = 0.0, 0.0
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + following[:h]
        got = out[i]
        assert got["n_chars"] == len(text)
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for estimate, truth in ((got["near_next"], jaccard(text, following)), (got["near_edited"], jaccard(text, edited))):
            bias += estimate - truth
            square += (estimate - truth) ** 2
    n = 2 * len(ordered)
    assert abs(bias / n) < 0.03  # the standard error of the mean is below 0.01
    assert (square / n) ** 0.5 < 0.12  # one estimate: at most 0.5 / sqrt(32) = 0.088


def test_odd_rows(docs, rows, clashing, no_docs):
    out = fingerprint_with_edits(docs).withColumn("fp", hex_signature(F.col("signature"))).collect()
    assert Counter(str(r["doc_id"]) for r in out) == Counter(str(r[0]) for r in rows)
    fps = {}
    texts = {str(r[0]): r[1] or "" for r in rows}
    for r in out:
        assert fps.setdefault(texts[str(r["doc_id"])], r["fp"]) == r["fp"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert fps[""] == fps[texts["102"]] and len(set(fps.values())) > 30
    assert fingerprint_with_edits(no_docs).count() == 0
    assert fingerprint_with_edits(clashing).count() == len(rows)


def test_a_single_row_follows_itself(spark):
    r = fingerprint_with_edits(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert r["near_next"] == 1.0
