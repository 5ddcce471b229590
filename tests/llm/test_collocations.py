import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chronoframe.llm import collocations as module
from chronoframe.llm.collocations import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, depth, top, percent=100):
    f, size = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(depth, len(words) - i) + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in cands.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= percent * f[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    out = {}
    for (lang, p), a in cands.items():
        if (lang, p) not in dropped:
            cut = min((1000 * a * size[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            l, r = f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, x[2].decode(), -x[1], x[3], x[4], size[lang], -x[0])
        for lang, found in out.items()
        for i, x in enumerate(sorted(found)[:top])
    )


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "a", "b", "é", "ÉA", "日本", "x\x00y", "x", "\x01", "\x01a", "\x02b", "x\x1f", " z", "Z"]
    seps = [" "] * 12 + [". ", ", ", "\n", "\t", "  ", "!?", "\r\n", "\x0b"]
    rows = [(None, None), ("en", ""), ("en", " .\n"), (None, "a b a b a b"), ("zz", "one two")]
    for _ in range(150):
        text = "".join(w + rng.choice(seps) for w in rng.choices(words, [9, 9, 5, 5, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 3], k=rng.randint(0, 40)))
        if rng.random() < 0.4:
            text += " one fixed long phrase of many words here. " * rng.randint(1, 2)
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + rows[10:40]


def result(spark, rows, *args):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    out = collocations(df, *args)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def test_against_all_phrases(spark):
    rows = corpus(1)
    got = result(spark, rows, 5, 5, 2000)
    assert got == plain(rows, 5, 5, 2000) and len(got) > 50
    assert any(len(r[2].split(" ")) == 5 for r in got)


def test_bounds_set_small(spark, monkeypatch):
    """Many groups, extended prefixes, forgotten words, no filters, a cut rank: the same result."""
    rows = corpus(2)
    for name, value in dict(BUDGET=20, BLOCK_WORDS=50, MAX_WORDS=12, MAX_BIGRAMS=40, MAX_FILTER_KEYS=3).items():
        monkeypatch.setattr(module, name, value)
    assert result(spark, rows, 4, 4, 25) == plain(rows, 4, 4, 25)
    monkeypatch.setattr(module, "MAX_FILTER_KEYS", 1 << 20)
    assert result(spark, rows, 8, 5, 2000, 80) == plain(rows, 8, 5, 2000, 80)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r exceed a long."""
    parts = spark.createDataFrame([(3_000_000_007, 4_000_000_000_000, 3_000_000_011, 5_000_000_029)], "a long, n long, l long, r long")
    a, n, l, r = parts.first()
    exact = module._exact
    div = F.call_function("div", exact("a1000", 19) * exact("n", 18), exact("l", 19) * exact("r", 18))
    assert parts.withColumn("a1000", F.col("a") * 1000).select(div).first()[0] == 1000 * a * n // (l * r)


def test_empty_long_and_clashing(spark, no_docs, clashing):
    assert collocations(no_docs).count() == 0
    extra = clashing.withColumns({c: F.lit(1) for c in ("phrase", "n", "a", "l", "r", "rank", "hash", "part", "whole")})
    plain_rows = [(r["lang"], r["text"]) for r in clashing.collect()]
    got = sorted(tuple(r) for r in collocations(extra, 20).collect())
    assert got == plain(plain_rows, 20, 5, 2000) and got


def test_two_word_suffixes_are_not_sent(spark, monkeypatch):
    """Counted prefixes are the phrases of two words: only longer suffixes travel, unless hashes may mix words."""
    rows = [("en", "red fox. blue sky! red fox, one two three four.")] * 6 + [(None, "red fox")] * 5
    sent, send = [], module.send_suffixes

    def spy(*args):
        out = send(*args)
        sent.append([tuple(r["suffix"].split(module.SEP)) for r in out.collect()])
        return out

    monkeypatch.setattr(module, "send_suffixes", spy)
    assert result(spark, rows, 5, 5, 2000) == plain(rows, 5, 5, 2000)
    assert {len(s) for s in sent[0]} == {3, 4}
    monkeypatch.setattr(module, "_ambiguous", lambda words, common: True)
    assert result(spark, rows, 5, 5, 2000) == plain(rows, 5, 5, 2000)
    assert ("red", "fox") in sent[1]


def test_words_of_one_hash_are_noticed(spark):
    words = spark.createDataFrame([("en", "a", 9, 1), ("en", "b", 2, 1), ("en", "c", 9, 3)], "lang string, word string, n long, hash long")
    assert module._ambiguous(words, words.where("n > 5"))
    assert not module._ambiguous(words.where("word != 'b'"), words.where("n > 5"))
