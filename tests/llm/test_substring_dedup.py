import random
import re

import numpy as np
import pytest

from chronoframe.llm import substring_dedup
from chronoframe.llm.substring_dedup import Block, dedup_substrings, pack_columns, unpack_columns

NO_ID = (1 << 63) - 1


def plain(rows, window):
    split = [(NO_ID if r[0] is None else r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, words), r in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((str(r[0]), " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone)))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["kept_text"], r["n_words"], r["n_removed"]) for r in df.collect())


@pytest.mark.parametrize("block,segment", [(1_000_000, 1 << 24), (50, 1 << 6)])
def test_against_brute_force(docs, rows, monkeypatch, block, segment):
    """Also with tiny blocks and a sketch so small that nearly all windows pass it."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring_dedup.blocks, "__defaults__", (block,))
    monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
    monkeypatch.setattr(substring_dedup, "MAX_COUNTERS", max(segment * 2, 1 << 24))
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 2000)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 20_000)
    assert result(dedup_substrings(docs, window=6)) == plain(rows, 6)


def test_empty_and_clashing(no_docs, clashing, rows):
    assert dedup_substrings(no_docs).count() == 0
    out = dedup_substrings(clashing)
    assert out.columns == ["doc_id", "kept_text", "n_words", "n_removed"]
    assert result(out) == plain(rows, 13)


def test_blocks_never_join_documents():
    rng = random.Random(3)
    texts = [np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in (0, 5, 2, 9, 3)]
    block = Block(texts, 3)
    assert list(zip(block.doc, block.pos, strict=True)) == [(1, k) for k in range(3)] + [(3, k) for k in range(7)] + [(4, 0)]
    alone = [Block([t], 3).h1 for t in texts if len(t) >= 3]
    assert (block.h1 == np.concatenate(alone)).all()


def test_packed_columns_round_trip():
    cols = [np.arange(9, dtype=np.uint32), np.zeros(0, np.uint16), np.array([-1, 1 << 62], np.int64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(cols, unpack_columns(pack_columns(*cols)), strict=True))
