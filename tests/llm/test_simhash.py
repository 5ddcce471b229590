import random
import re

import numpy as np
import xxhash

from chronoframe.llm import simhash
from chronoframe.llm.components import components
from chronoframe.llm.simhash import fingerprint, keep_one_per_component, link_fingerprints, simhash_components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_and_components(docs, rows):
    out = simhash_components(docs).collect()
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert all(fingerprint(r[1]) == f for r, f in zip(rows, fps, strict=True))
    comp = plain_components(fps, 2)
    first = {}
    for c, r in zip(comp, rows, strict=True):
        if r[0] is not None:
            first[c] = min(first.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f"{f:016x}", str(first.get(c))) for r, f, c in zip(rows, fps, comp, strict=True))
    assert want == sorted((str(r[0]), r[1], str(r[2])) for r in out)


def ball(seed, n):
    """Fingerprints in tight balls around a few centres, and loose ones."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            c ^= 1 << rng.randrange(64)
        out.add(c if rng.random() < 0.7 else rng.getrandbits(64))
    return sorted(out)


def check_links(spark, fps):
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = {r["fp"]: r["root"] for r in link_fingerprints(df, 2).collect()}
    comp = plain_components(fps, 2)
    names = {}
    for x, c in zip(signed, comp, strict=True):
        assert names.setdefault(c, got[int(x)]) == got[int(x)]
    assert len(set(names.values())) == len(names)


def test_deep_tree_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    check_links(spark, ball(5, 600))


def test_blocks_of_large_leaves_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 100)
    monkeypatch.setattr(simhash, "MEMBERS", 20)
    monkeypatch.setattr(simhash, "VISITORS", 50)
    check_links(spark, ball(6, 500))


def test_fingerprints_are_dealt_by_the_rows_they_make(spark, monkeypatch):
    rng = random.Random(5)
    fps = list({rng.getrandbits(63) >> 40 << 40 | rng.getrandbits(4) for _ in range(3000)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long").coalesce(1)
    want = sorted(link_fingerprints(df, 2).collect())
    tasks, plain = [], simhash.map_arrow
    monkeypatch.setattr(simhash, "map_arrow", lambda d, fn, out: tasks.append(d.rdd.getNumPartitions()) or plain(d, fn, out))
    monkeypatch.setattr(simhash, "VISITS", 2000, raising=False)
    assert sorted(link_fingerprints(df, 2).collect()) == want
    made = len(fps) * (1 + len(simhash.detours(simhash.tree_depth(len(fps)), 2)))
    assert made > 2 * 2000 and tasks[0] >= made / 2000


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_keep_one(docs, clashing, no_docs, rows):
    kept = keep_one_per_component(clashing)
    assert kept.columns == clashing.columns
    comp = plain_components([plain_fingerprint(r[1]) for r in rows], 2)
    assert kept.count() == len(set(comp))
    best = {}
    for c, r in zip(comp, rows, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[c] = min(best.get(c, key), key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(best.values())
    assert keep_one_per_component(no_docs).count() == 0
    assert simhash_components(no_docs).count() == 0
