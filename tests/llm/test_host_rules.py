import random
import re

from pyspark.sql import functions as F

from chronoframe.llm.host_rules import apply_host_rules, beta_prior, rule_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


def test_measures_against_plain(docs, rows, spark):
    rng = random.Random(4)
    more = [(i, " ".join(rng.choice("ab|") for _ in range(rng.randint(0, 60))), "en", "s", 0) for i in range(80)]
    more.append((99, "# ** $ a\n\n a\nb | <c>\n a\na", "en", "s", 0))
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    short = {r[1] for r in rows + more if len(r[1] or "") < 10_000}
    out = rule_measures(table.withColumn("text", F.col("text"))).collect()
    assert len(out) == len(rows) + len(more)
    texts = {}
    for r in rows + more:
        if r[1] in short:
            texts.setdefault(r[0], set()).add(tuple(sorted(plain(r[1]).items())))
    for r in out:
        got = tuple(sorted((k, r[k]) for k in plain("")))
        if r["id"] in texts and len(texts[r["id"]]) == 1 and r["id"] != 104:
            assert got in texts[r["id"]], r


def test_very_long_repeating_text(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(100_000))
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    r = apply_host_rules(df).first()
    assert (r["n_words"], r["n_repeat_words"], r["kept"]) == (100_000, 100_000, False)


GOOD = "these are the plain words of one good page about {} and it says what it says"
ODD = "these | are # the * odd $ words % of & a < page > about {} and it"


def test_hosts_are_shrunk(spark):
    """A large bad host goes with its good pages; one of two documents is no verdict; no host, no verdict."""
    rows = [(i, ODD.format(i) if i % 10 else GOOD.format(i), "bad") for i in range(200)]
    rows += [(1000 + i, GOOD.format(i) if i % 20 else ODD.format(i), f"good{i % 8}") for i in range(800)]
    rows += [(3000, ODD.format(1), "tiny"), (3001, GOOD.format(2), "tiny"), (3002, GOOD.format(3), None)]
    out = {r["doc_id"]: r for r in apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows)
    assert not any(out[i]["kept"] for i in range(200))
    assert all(out[i]["kept"] for i in [*range(1000, 1800), 3000, 3001, 3002])
    assert out[1]["host_rate"] > 0.8 and out[3000]["host_rate"] < 0.5 and out[3002]["host_rate"] is None


def test_prior_follows_the_spread(spark):
    rows = lambda rates: spark.createDataFrame([(100, int(100 * x)) for x in rates], "n long, failed long")
    strength = lambda rates: beta_prior(rows(rates)).first()["strength"]
    assert strength([0.2] * 10) == 10_000
    assert strength([0.0] * 8 + [1.0] * 2) == 1.0
    assert strength([0.1, 0.2, 0.3] * 4) > strength([0.0, 0.2, 0.6] * 4) > 1
    assert strength([0.3]) == 20 and strength([1.0, 1.0]) == 20


def test_empty_and_clashing(no_docs, clashing):
    assert apply_host_rules(no_docs).count() == 0
    extra = clashing.withColumns({c: F.lit("x") for c in ("host", "w", "lines", "failed", "rejected", "kept")})
    assert apply_host_rules(extra).count() == clashing.count()
