import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoframe.llm import packing
from chronoframe.llm.packing import TextEncoder, binary_pieces, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
FAST = TextEncoder(PATH)


def plain_ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 　᠎​'sé́ab1!<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_those_of_the_tokenizers_library(text):
    assert FAST.encode(text) == np.array(plain_ids(text), dtype="<u4").tobytes()


def test_very_long_blank_runs():
    n = 2_000_000
    for text in [" " * n, "\n" * n, " \n\t" * (n // 3), "words before " + " " * n + "x", "x" * 300_000]:
        assert FAST.encode(text) == np.array(plain_ids(text), dtype="<u4").tobytes()


def test_other_kinds_of_file_run_by_the_tokenizers_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(other)
    plain.encode_special_tokens = True
    for text in ["", "Two words, été", "<|startoftext|> x"]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert TextEncoder(other).encode(text) == np.array(want, dtype="<u4").tobytes()


def test_the_slow_library_is_loaded_when_needed():
    encoder = TextEncoder(PATH)
    assert encoder.encode("Two words") == np.array(plain_ids("Two words"), dtype="<u4").tobytes()
    assert "plain" not in vars(encoder)


def test_a_long_document_is_sent_in_parts(spark, monkeypatch):
    sent = {}
    monkeypatch.setattr(packing, "map_arrow", lambda d, fn, out: sent.update(fn=fn) or d.sparkSession.createDataFrame([], out))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "FLUSH_TOKENS", 3000)
    pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    texts = ["some words " * 10_000, None, "x"]
    out = list(sent["fn"](iter([pa.RecordBatch.from_pydict({"id": [7, 8, 9], "text": texts})])))
    assert max(sum(b.column("length").to_pylist()) for b in out) < 3000 + packing.WINDOW
    ids = b"".join(x for b in out for x in b.column("ids").to_pylist())
    assert ids == np.array([i for t in texts for i in [*plain_ids(t or ""), 0]], "<u4").tobytes()


def test_binary_pieces():
    for n in [*range(1, 70), 1023, 1024, 1025, 5000]:
        pieces = list(binary_pieces(n))
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [k for _, k in pieces[:-1]]))
        assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= 1024 for _, k in pieces)
        assert len(pieces) == n // 1024 + bin(n % 1024).count("1")


def test_round_trip(docs, rows, clashing, no_docs):
    out = pack(docs, PATH).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    assert all(r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] for r in out)
    want = sorted((str(r[0]), np.array([*plain_ids(r[1] or ""), 0], "<u4").tobytes()) for r in rows)
    whole, texts = {}, []
    for r in sorted(out, key=lambda r: (str(r["doc_id"]), r["sequence_id"] >> 33 & 0xFFFFFF, r["start"])):
        whole.setdefault((str(r["doc_id"]), r["sequence_id"] >> 33 & 0xFFFFFF), []).append(r)
    for (doc, _), pieces in whole.items():
        copies = sum(p["start"] == 0 for p in pieces)
        texts += [(doc, b"".join(p["ids"] for p in pieces[::copies]))] * copies
    assert sorted(texts) == want
    assert pack(no_docs, PATH).count() == 0
    assert pack(clashing, PATH).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_crc_of_ids(docs):
    for r in pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).limit(20).collect():
        assert r["c"] == zlib.crc32(r["ids"])
