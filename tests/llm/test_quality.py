import random

import pytest

from chronoframe.llm.quality import QualityModel, held_out, keep_good, score_quality, train

COLUMNS = "doc_id long, text string"


def labelled(spark, n=400):
    rng = random.Random(4)
    good = ["river", "stone", "walked", "slowly", "under", "bright", "morning", "light"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = train(docs, labels)
    out = score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 40 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)
    assert keep_good(docs, model).columns == docs.columns


def test_the_fit_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(docs, labels) == train(docs, flipped)


def test_odd_rows_and_missing_classes(spark, docs, clashing, no_docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs, none).prior == 0.5
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    model = train(docs, one)
    assert model.prior == 1.0 and all(r["score"] == 1.0 for r in score_quality(docs, model).collect())
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (None, 1), (4, None)], "doc_id long, quality int")
    train(docs, odd)
    full, labels = labelled(spark)
    model = train(full, labels)
    out = score_quality(clashing, model).collect()
    assert len(out) == len(rows)
    assert [r["score"] for r in out if r["doc_id"] in (100, 101)] == pytest.approx([zero(model)] * 2)
    assert score_quality(no_docs, model).count() == 0
    assert keep_good(clashing, model).columns == clashing.columns


def zero(model: QualityModel) -> float:
    from math import exp

    return 1 / (1 + exp(-model.weights[0]))
