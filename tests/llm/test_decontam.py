import random
import re
from itertools import combinations

from chronoframe.llm import decontam
from chronoframe.llm.decontam import MASKS, MAX_SUBSTITUTIONS, WINDOW, drop_contaminated, overlaps


def test_masks_lose_no_window():
    for wrong in combinations(range(WINDOW), MAX_SUBSTITUTIONS):
        assert any(
            not any(at + p in wrong for p in mask) for mask in MASKS for at in range(WINDOW - mask[-1])
        ), wrong


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def plain(docs, items):
    out = set()
    for i, text in docs:
        d = words(text)
        for item, it in items:
            b = words(it)
            w, most = (13, 2) if len(b) >= 13 else (len(b), 0)
            starts = {
                s
                for s in range(len(d) - w + 1)
                for q in range(len(b) - w + 1)
                if w >= 8 and sum(x != y for x, y in zip(d[s : s + w], b[q : q + w], strict=True)) <= most
            }
            if starts:
                out.add((i, item, min(starts), max(starts) + w, len(starts)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 8, 9, 12, 13, 14, 30])))) for k in range(12)]
    items += [(90, None), (91, ""), (92, items[3][1]), (3, items[3][1])]
    docs = []
    for i in range(50):
        d = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        part = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 6)):
            if part:
                part[rng.randrange(len(part))] = rng.choice(["X", "y"])
        at = rng.randint(0, len(d))
        sep = rng.choice([" ", "\n", " \t "])
        docs.append((i, sep.join(d[:at] + [w.upper() for w in part] + d[at:])))
    return docs + [(200, None), (201, ""), (201, ""), (None, items[5][1])], items


def frames(spark, seed):
    docs, items = corpus(seed)
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def result(df):
    return {(r["doc_id"], r["item_id"], r["first_word"], r["last_word"], r["n_windows"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs, items, d, b = frames(spark, 1)
    want = plain(docs, items)
    assert len(want) > 15 and result(overlaps(d, b)) == want


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items, d, b = frames(spark, 2)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100 * decontam.SEED_BYTES)
    assert result(overlaps(d, b)) == plain(docs, items)


def test_drop_and_odd_tables(spark, clashing, no_docs):
    docs, items, d, b = frames(spark, 3)
    bad = {i for i, *_ in plain(docs, items)}
    kept = [r["doc_id"] for r in drop_contaminated(d, b).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in bad)
    assert overlaps(no_docs, b).count() == 0 and overlaps(d, b.where("false")).count() == 0
    out = drop_contaminated(clashing, b)
    assert out.columns == clashing.columns and out.count() == clashing.count()


def test_short_items_match_whole(spark):
    """Items of 8 to 12 words need every word; shorter ones, and one word changed, do not match."""
    ten = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, "so " + ten.upper() + " end"), (2, ten.replace("nine", "9")), (3, ten), (4, "one two three four five six seven")], "doc_id long, text string")
    b = spark.createDataFrame([(1, ten), (2, " ".join(ten.split()[:8])), (3, " ".join(ten.split()[:7]))], "item_id long, text string")
    assert result(overlaps(d, b)) == {(1, 1, 1, 11, 1), (1, 2, 1, 9, 1), (2, 2, 0, 8, 1), (3, 1, 0, 10, 1), (3, 2, 0, 8, 1)}
