"""Exact removal of repeated word windows behind a count-min prefilter.

Pass 1 hashes every window of ``window`` words; each task sends the counters it
touched, per segment of the sketch, as sorted deltas.  A segment's messages are
merged by one task, which keeps one bit per counter: hit at least twice.
Estimates never fall below true counts, so a window whose counters were hit once
occurs once.

Pass 2 hashes the windows again and keeps those estimated repeated.  Within a
block of documents repeats of a smaller id are settled at once, so a passage that many
documents share leaves a block once per window; the rest is grouped exactly, by
96 hash bits, in tasks keyed by hash range.  Every window that also starts in a
document with a smaller id is reported back to its document, where the covered
words are cut out.

The sketch has ``COUNTERS_PER_WINDOW`` counters a window up to ``MAX_COUNTERS``;
beyond that the prefilter passes more windows on (the result stays exact and
the shuffle of pass 2 grows towards all windows).  Its compressed bits are the
only thing collected and broadcast: at most ``ROWS * MAX_COUNTERS / 8`` bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import map_arrow, utf8

WINDOW = 13
ROWS = 2  # independent hash rows of the sketch
COUNTERS_PER_WINDOW = 4
SEGMENT = 1 << 24  # counters merged by one task
MAX_COUNTERS = 1 << 29  # per row
BYTES_PER_WORD = 6  # used only to choose the sketch size and the number of groups
BLOCK_WORDS = 1_000_000  # words hashed together
BUCKET_WINDOWS = 1 << 21  # windows aimed at per exact-grouping task
GROUP_BYTES = 8 << 20  # text aimed at per cutting task
NO_ID = (1 << 63) - 1


# ---- packed number columns -------------------------------------------------


def pack_columns(*columns: np.ndarray) -> bytes:
    """Integer columns as byte planes, compressed together."""
    parts = []
    for col in columns:
        col = np.ascontiguousarray(col)
        parts.append(struct.pack("<cq", col.dtype.char.encode(), len(col)))
        parts.append(col.view(np.uint8).reshape(-1, col.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_columns(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    at, out = 0, []
    while at < len(raw):
        char, n = struct.unpack_from("<cq", raw, at)
        at += 9
        kind = np.dtype(char.decode())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Same values in the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


# ---- window hashes ---------------------------------------------------------


def _odd_numbers(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name} {i}") | 1 for i in range(n)], dtype=np.uint64)


def window_hashes(words: np.ndarray, window: int, lane: int) -> np.ndarray:
    """Hash of each run of ``window`` entries of ``words`` (multilinear, then mixed)."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd_numbers(f"lane {lane}", window)):
        h += words[j : j + n] * c
    h ^= h >> np.uint64(32)
    h *= _odd_numbers(f"mix {lane}", 1)[0]
    h ^= h >> np.uint64(29)
    return h


class Block:
    """Word hashes of some whole documents, and their windows."""

    def __init__(self, texts: list[np.ndarray], window: int):
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        windows = np.maximum(lengths - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
        begin = np.repeat(np.cumsum(windows) - windows, windows)
        self.pos = (np.arange(len(self.doc)) - begin).astype(np.uint32)
        del begin
        words = np.concatenate(texts)
        start = (np.cumsum(lengths) - lengths)[self.doc] + self.pos
        self.h1 = window_hashes(words, window, 1)[start] if len(start) else np.zeros(0, np.uint64)
        self.h2 = window_hashes(words, window, 2)[start] if len(start) else np.zeros(0, np.uint64)

    def counters(self, row: int, width: int) -> np.ndarray:
        return (self.h1 if row == 0 else self.h2) % np.uint64(width)


def blocks(batches, text_column: int, block_words: int = BLOCK_WORDS):
    """Yield (other columns' values, word hashes) of whole rows, about ``block_words`` words at a time."""
    rows, texts, held = [], [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for k in range(batch.num_rows):
            words = utf8(columns[text_column][k].as_py()).split()
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            rows.append(tuple(c[k].as_py() for i, c in enumerate(columns) if i != text_column))
            texts.append(words)
            held += len(words)
            if held >= block_words:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


# ---- pass 1: the sketch ----------------------------------------------------


def sketch_width(total_bytes: int) -> int:
    segments = -(-COUNTERS_PER_WINDOW * (total_bytes // BYTES_PER_WORD) // SEGMENT)
    return SEGMENT * min(max(1, segments), MAX_COUNTERS // SEGMENT)


def build_sketch(docs: DataFrame, width: int, window: int) -> dict[int, bytes]:
    """Compressed repeat bits by segment number (``row * segments + segment``)."""
    segments = width // SEGMENT

    def touch(batches):
        for _, texts in blocks(batches, 0):
            block = Block(texts, window)
            keys, payloads = [], []
            for row in range(ROWS):
                counter, hits = np.unique(block.counters(row, width), return_counts=True)
                cut = np.searchsorted(counter, np.arange(segments + 1, dtype=np.uint64) * np.uint64(SEGMENT))
                for s in range(segments):
                    a, b = cut[s], cut[s + 1]
                    if a < b:
                        local = (counter[a:b] - np.uint64(s * SEGMENT)).astype(np.uint32)
                        keys.append(row * segments + s)
                        payloads.append(pack_columns(np.diff(local, prepend=np.uint32(0)), np.packbits(hits[a:b] > 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(payloads, pa.binary())], names=["segment", "payload"]
            )

    def merge(batches):
        def close():
            bits = zstandard.ZstdCompressor(level=3).compress(np.packbits(twice, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([bits], pa.binary())], names=["segment", "payload"]
            )

        current, once, twice = None, None, None
        for batch in batches:
            for segment, payload in zip(batch.column(0), batch.column(1), strict=True):
                segment = segment.as_py()
                if segment != current:
                    if current is not None:
                        yield close()
                    current, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                delta, many = unpack_columns(payload.as_py())
                at = np.cumsum(delta, dtype=np.uint32)
                twice[at] |= once[at] | np.unpackbits(many, count=len(at)).astype(bool)
                once[at] = True
        if current is not None:
            yield close()

    schema = "segment int, payload binary"
    sent = map_arrow(docs.select(F.col("text").cast("string").alias("text")), touch, schema)
    merged = map_arrow(sent.repartition("segment").sortWithinPartitions("segment"), merge, schema)
    return {r["segment"]: bytes(r["payload"]) for r in merged.collect()}


def estimated_repeats(block: Block, sketch: dict[int, bytes], width: int) -> np.ndarray:
    """Windows of the block whose counters were all hit more than once."""
    segments = width // SEGMENT
    left = np.arange(len(block.h1))
    for row in range(ROWS):
        counter = block.counters(row, width)[left]
        segment = (counter // np.uint64(SEGMENT)).astype(np.uint16)
        order = np.argsort(segment, kind="stable")
        cut = np.searchsorted(segment[order], np.arange(segments + 1))
        keep = np.zeros(len(left), bool)
        for s in range(segments):
            own = order[cut[s] : cut[s + 1]]
            if len(own):
                raw = zstandard.ZstdDecompressor().decompress(sketch[row * segments + s])
                bits = np.frombuffer(raw, np.uint8)
                local = (counter[own] - np.uint64(s * SEGMENT)).astype(np.int64)
                keep[own] = (bits[local >> 3] >> (local & 7).astype(np.uint8)) & 1
        left = left[keep]
    return left


# ---- pass 2: exact grouping ------------------------------------------------


def settle(h1: np.ndarray, h2: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): windows sorted by hash, and whether a smaller id has the same one."""
    order = np.lexsort((doc_id, h2, h1))
    a, b, d = h1[order], h2[order], doc_id[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else d
    return order, d > first


def removal_blocks(doc_id, text_key, group, pos):
    """(group, payload) of window starts to cut, by the cutting group of their document."""
    if not len(pos):
        return
    order = np.lexsort((pos, text_key, doc_id, group))
    doc_id, text_key, group, pos = doc_id[order], text_key[order], group[order], pos[order]
    new = np.ones(len(pos), bool)
    new[1:] = (doc_id[1:] != doc_id[:-1]) | (text_key[1:] != text_key[:-1])
    begin = np.nonzero(new)[0]
    count = np.diff(begin, append=len(pos))
    own = group[begin]
    first = np.nonzero(np.diff(own, prepend=-1))[0]
    for x, y in zip(first, [*first[1:], len(own)], strict=True):
        starts = pos[begin[x] : begin[y - 1] + count[y - 1]]
        yield int(own[x]), pack_columns(doc_id[begin[x:y]], text_key[begin[x:y]], narrow(count[x:y]), narrow(starts))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ``kept_text``, ``n_words``, ``n_removed``.

    Words are runs of characters other than space and U+0009 to U+000D.  A word
    goes if a window covering it also starts in a document with a smaller id;
    windows are judged on the input.  Kept words are joined by one space.  NULL
    texts have no words; a NULL id counts as larger than any other, and rows of
    equal id do not remove each other's words.  An empty table gives no rows;
    other columns are ignored.  Ids must be integers.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    width = sketch_width(total)
    buckets = max(1, total // BYTES_PER_WORD // BUCKET_WINDOWS)
    groups = max(1, total // GROUP_BYTES)
    sketch = spark.sparkContext.broadcast(build_sketch(docs, width, window))

    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        text.alias("text"),
    ).withColumn("grp", F.pmod(F.xxhash64("doc", "key"), F.lit(groups)))

    def repeats(batches):
        for rows, texts in blocks(batches, 3):
            block = Block(texts, window)
            hit = estimated_repeats(block, sketch.value, width)
            doc_ids = np.array([r[0] for r in rows], dtype=np.int64)
            keys = np.array([r[1] for r in rows], dtype=np.int64)
            grps = np.array([r[2] for r in rows], dtype=np.int64)
            h1, h2, doc, pos = block.h1[hit], (block.h2[hit] >> np.uint64(32)).astype(np.uint32), block.doc[hit], block.pos[hit]
            del block
            order, later = settle(h1, h2, doc_ids[doc])
            gone, left = order[later], order[~later]
            who = doc[gone]
            settled = removal_blocks(doc_ids[who], keys[who], grps[who], pos[gone])
            out = [(-1 - g, payload) for g, payload in settled]
            h1, h2, doc, pos = h1[left], h2[left], doc[left], pos[left]
            step = (1 << 64) // buckets + 1
            cut = np.searchsorted(h1, np.array([min(b * step, (1 << 64) - 1) for b in range(buckets)], dtype=np.uint64))
            for b, (x, y) in enumerate(zip(cut, [*cut[1:], len(h1)], strict=True)):
                if x < y:
                    used, local = np.unique(doc[x:y], return_inverse=True)
                    delta = np.diff(h1[x:y], prepend=np.uint64(0))
                    payload = pack_columns(
                        delta, h2[x:y], narrow(local), narrow(pos[x:y]), doc_ids[used], keys[used], narrow(grps[used])
                    )
                    out.append((b, payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())],
                names=["part", "payload"],
            )

    def regroup(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:  # settled already: on to the documents
            return pa.table({"grp": pa.array([-1 - part] * table.num_rows, pa.int64()), "payload": table.column("payload")})
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for payload in table.column("payload"):
            delta, h2, local, pos, doc_ids, keys, grps = unpack_columns(payload.as_py())
            h1 = np.cumsum(delta, dtype=np.uint64)
            own = (h1, h2, doc_ids[local], keys[local], grps[local].astype(np.int64), pos.astype(np.uint32))
            for col, values in zip(columns, own, strict=True):
                col.append(values)
        h1, h2, doc, key, grp, pos = (np.concatenate(c) for c in columns)
        order, later = settle(h1, h2, doc)
        gone = order[later]
        found = list(removal_blocks(doc[gone], key[gone], grp[gone], pos[gone]))
        return pa.table({"grp": pa.array([g for g, _ in found], pa.int64()), "payload": pa.array([p for _, p in found], pa.binary())})

    sent = map_arrow(keyed.select("doc", "key", "grp", "text"), repeats, "part long, payload binary")
    removals = sent.groupBy("part").applyInArrow(regroup, "grp long, payload binary")

    id_type = docs.schema[id_col].dataType.simpleString()

    def cut_out(own: pa.Table, gone: pa.Table) -> pa.Table:
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for payload in gone.column("payload"):
            d, t, count, pos = unpack_columns(payload.as_py())
            ends = np.cumsum(count, dtype=np.int64)
            for k in range(len(d)):
                starts.setdefault((int(d[k]), int(t[k])), []).append(pos[int(ends[k]) - int(count[k]) : int(ends[k])])
        kept, n_words, n_removed = [], [], []
        for doc, key, value in zip(own.column("doc"), own.column("key"), own.column("text"), strict=True):
            words = utf8(value.as_py()).split()
            n_words.append(len(words))
            found = starts.get((doc.as_py(), key.as_py()))
            if found is None:
                n_removed.append(0)
            else:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.concatenate(found).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                n_removed.append(int(covered.sum()))
                words = [words[i] for i in np.nonzero(~covered)[0]]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.table(
            {
                "id": own.column("id"),
                "kept_text": pa.array(kept, pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
            }
        )

    out = f"id {id_type}, kept_text string, n_words long, n_removed long"
    cut = keyed.groupBy("grp").cogroup(removals.groupBy("grp")).applyInArrow(cut_out, out)
    return cut.withColumnRenamed("id", id_col)
