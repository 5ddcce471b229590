"""Packing by power-of-two decomposition.

A document of n tokens is cut into full windows and then into the pieces of
n's binary expansion, longest first.  Every piece has a power-of-two length, is
a sequence of its own and needs no padding, and sequences of equal length
share a bucket; so no sequence crosses documents.

A task tokenises its rows and numbers its pieces per bucket; ``sequence_id``
puts the bucket into the high bits, so a bucket's sequences are a range of ids.
There is no shuffle and nothing is gathered; a task holds the ids of one document and
about ``FLUSH_TOKENS`` tokens of pieces that wait to be sent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import map_arrow

WINDOW = 1024
END_ID = 0
# Fixed value: how byte-level BPE vocabularies split a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKET_SHIFT, TASK_SHIFT = 57, 33  # sequence_id: bucket, task, number within both
FLUSH_TOKENS = 250_000  # tokens sent back in one record batch, but for its last piece


def binary_pieces(n: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens, longest first."""
    start = 0
    while n - start >= window:
        yield start, window
        start += window
    piece = window >> 1
    while piece:
        if (n - start) & piece:
            yield start, piece
            start += piece
        piece >>= 1


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {**{chr(b): b for b in printable}, **{chr(256 + n): b for n, b in enumerate(others)}}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Merge ranks of a byte-level BPE file; None if the file is of another kind.

    Ids must follow the order of the merges, which is what makes an id a rank.
    """
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or split.get("add_prefix_space") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    order = [vocab["".join(pair)] for pair in pairs]
    chars = byte_characters()
    if order != sorted(order) or len(vocab) != len(order) + 256 or max(vocab[c] for c in chars) > min(order):
        return None
    return {bytes(chars[c] for c in token): i for token, i in vocab.items()}


class TextEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    A byte-level BPE file is run by tiktoken, which gives the same ids several
    times faster (a test compares them); any other file, and texts that tiktoken's
    pattern cannot split (runs of a million blanks), by tokenizers, which is
    loaded when it is needed first.  Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        self.path = path
        self.fast = None
        with open(path, encoding="utf-8") as file:
            ranks = byte_level_ranks(json.load(file))
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(self.path)
        plain.encode_special_tokens = True
        return plain

    def ids(self, text: str):
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return self.plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return np.asarray(self.ids(text), dtype="<u4").tobytes()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids``: the piece's token ids as little-endian unsigned 32-bit integers.
    ``doc_tokens`` counts the document's ids with its end id.  A NULL or empty
    text is the end id alone.  Rows with NULL or repeated ids are packed like
    any other; an empty table gives no rows; other columns are ignored.
    ``tokenizer_path`` must exist on every worker.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = TextEncoder(tokenizer_path)
        task = TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        cols: list[list] = [[] for _ in range(6)]
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id"]
        kept = 0

        def flush(id_type) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            for col in cols:
                col.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in binary_pieces(n, window):
                    bucket = length.bit_length() - 1
                    number = numbers.get(bucket, 0)
                    numbers[bucket] = number + 1
                    sequence = (bucket << BUCKET_SHIFT) | (task << TASK_SHIFT) | number
                    row = (doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    kept += length
                    if kept >= FLUSH_TOKENS:
                        yield flush(id_type)
                        kept = 0
        if cols[0]:
            yield flush(id_type)

    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long"
    packed = map_arrow(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")), run, out)
    # a sequence is one piece, so every piece starts its sequence
    return packed.withColumn("offset", F.lit(0).cast("long")).withColumnRenamed("id", id_col)
