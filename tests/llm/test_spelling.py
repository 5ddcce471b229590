import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from chronoframe.llm import spelling
from chronoframe.llm.spelling import letter_group, one_edit_apart, spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    out = {}
    for w in n:
        links = [x for x in n if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(links, key=lambda x: (-n[x], x), default=None)
        out[w] = (n[w], len(links), best if best and n[best] >= 2 * n[w] else None)
    rows = []
    for w, (c, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, form, root, c, k, n[form] if form else None))
    return sorted(rows, key=repr)


def result(df):
    return sorted((tuple(r) for r in spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéÉÀ÷"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(40)]
    rows = [(None, None), (1, ""), (1, "one,two;three-Three THREE three"), (None, "three threE three")]
    for i in range(120):
        words = []
        for w in rng.choices(base, [2 ** (i % 7) for i in range(40)], k=60):
            kind = rng.random()
            at = rng.randrange(len(w))
            if kind < 0.1:
                w = w[:at] + w[at + 1 :]
            elif kind < 0.2:
                w = w[:at] + rng.choice(letters) + w[at + 1 :]
            elif kind < 0.3:
                w = w[:at] + rng.choice(letters) + w[at:]
            words.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return rows + rows[:30]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_against_all_pairs(spark):
    rows = corpus(1)
    want = plain(rows)
    assert result(frame(spark, rows)) == want
    assert len(want) > 200 and any(r[1] and r[2] != r[1] for r in want)  # a way of two steps


def test_bounds_set_small(spark, monkeypatch):
    """Subtrees of a few words: all levels are used and words of one vector are cut into blocks."""
    monkeypatch.setattr(spelling, "SUBTREE_WORDS", 2)
    monkeypatch.setattr(spelling, "TOP_LEVELS", 5)
    monkeypatch.setattr(spelling, "MAX_WORDS", 30)
    rows = corpus(2)
    assert result(frame(spark, rows)) == plain(rows)


def test_many_words_of_one_vector(spark):
    """Anagrams share a leaf; their pairs come from the halves index."""
    rng = random.Random(3)
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(250)} | {"".join(rng.sample("aabbccd", 7)) for _ in range(80)}
    same = [c for c in map(chr, range(97, 123)) if letter_group(ord(c)) == letter_group(ord("a"))]
    words |= {w.replace("a", rng.choice(same), 1) for w in list(words)[:100]}
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, " ".join(sorted(words)[::3]))]
    assert result(frame(spark, rows)) == plain(rows)


def test_one_edit_apart():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in "xy")
        if len(a) >= len(b):
            assert one_edit_apart(a, b) == near(a, b), (a, b)


def test_empty_long_and_clashing(docs, no_docs, clashing, rows):
    assert spelling_variants(no_docs).count() == 0
    extra = clashing.withColumns({c: F.lit(1) for c in ("word", "n", "form", "root", "path", "near", "size")})
    assert result(extra) == plain([(r[0], r[1]) for r in rows])


def test_runs_too_short_for_a_word_are_not_hashed(spark):
    assert spelling.RUN.findall("ab abcde1Éclair abcd z") == ["abcde", "Éclair"]
    docs = spark.createDataFrame([(i, "abcde abcd fghijk ab") for i in range(400)], "doc_id int, text string")
    want = Counter()
    for i in range(400):
        for run in ("abcde", "fghijk"):
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[word] += len(word) >= 5
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, "doc_id").collect()}
    assert got == {w: n for w, n in want.items() if n} and len(got) > 2
