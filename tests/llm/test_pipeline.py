"""run() against the stages' brute-force versions on a small table."""

import re

import numpy as np
import public_tokenizers
import pytest
from cases import COLUMNS, ODD_ROWS, make_rows
from pyspark.sql import functions as F
from test_decontam import plain as plain_overlaps
from test_line_dedup import NO_ID, plain_dedup
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from chronoframe.llm.quality import THRESHOLD, score_column, train


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = make_rows(seed=7, n=80) + ODD_ROWS
    rows += [(3, "a second text of one id with words of its own", "en", "s", 45), (None, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    items = [(0, rows[9][1]), (1, "w1 w2 w3"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def test_run_matches_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    text_of = F.coalesce("text", F.lit(""))
    scored = docs.select("doc_id", "text", score_column(model).alias("score"))
    good = {(r["doc_id"], r["text"]) for r in scored.where(F.col("score") >= THRESHOLD).collect()}
    rows = [r for r in rows if (r[0], r[1]) in good]

    def hashes(texts):
        df = spark.createDataFrame([(t,) for t in set(texts)], "text string")
        return {r["text"]: r["h"] for r in df.select("text", F.xxhash64(text_of).alias("h")).collect()}

    h = hashes(r[1] or "" for r in rows)
    gone = plain_dedup(rows, lambda r: (h[r[1] or ""] % (1 << 64)) >> 33)
    left = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        cut = gone[NO_ID if r[0] is None else r[0], r[1] or ""]
        kept = "\n".join(x for k, x in enumerate(lines) if k not in cut)
        if not cut or re.search(r"[^\x20\x09-\x0D]", kept):
            left.append((r[0], kept))
    h = hashes(t for _, t in left)
    comp = plain_components([plain_fingerprint(t) for _, t in left], 2)
    first = {}
    for c, (i, t) in zip(comp, left, strict=True):
        key = (i is None, i or 0, h[t]), (i, t)
        first[c] = min(first.get(c, key), key)
    left = [x for _, x in first.values()]
    bad = {k for k, *_ in plain_overlaps([(k, t) for k, (_, t) in enumerate(left)], items)}
    left = [x for k, x in enumerate(left) if k not in bad]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = sorted(
        (str(i), np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in left
    )
    pieces = {}
    for r in corpus_pipeline.run(spark, folder).collect():  # a document: pieces of one id that follow each other
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"]), {}).setdefault(r["start"], []).append(r["ids"])
    for (i, n), at in pieces.items():
        copies = [w for w in want if w[0] == i and len(w[1]) == 4 * n]
        for start, ids in at.items():
            assert sorted(bytes(x) for x in ids) == sorted(w[1][4 * start : 4 * start + len(ids[0])] for w in copies)
    assert sum(len(x) for at in pieces.values() for ids in at.values() for x in ids) == sum(len(w[1]) for w in want)
    assert len(want) > 10


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES:
        out = apply(spark, docs.where("false"), folder)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_line_stage_keeps_documents_with_lines_of_their_own(spark):
    notice = "all rights to this text are reserved by its owner"
    rows = [
        (1, f"{notice}\nx = 1\ny = 2"),
        (2, f"{notice}\nx = 1\nz = 3"),  # z = 3 is its own
        (3, f"{notice}\ny = 2\n\nx = 1"),  # copies only
        (4, f"{notice}\n \t\n"),  # blank lines only
        (5, notice),
        (6, f"{notice}\nq = 9\nq = 9"),  # repeated in itself, found in no earlier document
        (8, "x = 1"),
        (9, ""),
        (None, f"{notice}\nlast of all"),
        (None, f"{notice}\nlast of all"),  # the same document
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()), key=str)
    want = [(1, rows[0][1]), (2, "z = 3"), (6, "q = 9"), (9, "")] + [(None, "last of all")] * 2
    assert got == sorted(want, key=str)


def test_near_stage_keeps_one_row(spark):
    """Copies of one id and of several, NULL ids, two texts of one id."""
    rows = [(2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "other words stand here"), (3, "x y z z z"), (None, "q q q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "a b c d"), (3, "other words stand here"), (3, "x y z z z"), (None, "q q q")], key=str)
