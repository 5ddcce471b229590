import random
import re

from pyspark.sql import functions as F

from chronoframe.llm import line_dedup
from chronoframe.llm.line_dedup import dedup_lines

NO_ID = (1 << 63) - 1


def plain_dedup(rows, key):
    """Rows in order; key(row) orders rows of one id. Returns {(id, text): (n_lines, removed numbers)}."""
    docs = sorted({(NO_ID if r[0] is None else r[0], key(r), r[1] or "") for r in rows})
    lines = [
        (doc, no, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line)))
        for doc in docs
        for no, line in enumerate(doc[2].split("\n"))
    ]
    gone = {doc: set() for doc in docs}
    for i, (doc, no, a) in enumerate(lines):
        if a and any(b and 9 * len(a & b) >= 4 * (len(a) + len(b)) for _, _, b in lines[:i]):
            gone[doc].add(no)
    return {(doc[0], doc[2]): gone[doc] for doc in docs}


def check(docs, rows):
    hashes = {r["text"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 33).alias("h")).distinct().collect()}
    want = plain_dedup(rows, lambda r: hashes[r[1] or ""])
    out = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(docs).collect())
    expected = []
    for r in rows:
        text = r[1] or ""
        gone = want[NO_ID if r[0] is None else r[0], text]
        lines = text.split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        expected.append((str(r[0]), kept, len(lines), len(gone)))
    assert out == sorted(expected)


def test_against_all_pairs(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT", 2)  # most matches then come from the join of the rest
    check(docs, rows)


def test_near_copies_of_one_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT", 3)
    rng = random.Random(8)
    base = [f"word{i}" for i in range(20)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(20)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(words) + "\nshort line here", None, None, None))
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)


def test_short_lines(spark):
    """Lines of one to four words take part, and very long lines of few words."""
    rows = [
        (1, "x = 1\na b c d\n\none", None, None, None),
        (2, "a b c d e\nx  =  1\none\n \t", None, None, None),
        (3, "A b c d " * 3000 + "\na b c\nb a", None, None, None),
        (4, "d c b A\nonE\na b", None, None, None),
    ]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)


def test_one_token_in_many_lines(spark):
    """A token that stands first in every line: few lines match, each once."""
    n = 20_000
    lines = F.concat_ws(" ", F.lit("same"), *(F.concat(F.lit(f"u{k}x"), F.col("id")) for k in range(4)))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), lines.alias("text"))
    copies = docs.where("doc_id % 100 = 0").select((F.col("doc_id") + n).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    out = dedup_lines(docs.unionByName(copies)).where("n_removed > 0").agg(F.count("*"), F.min("doc_id")).first()
    assert out[0] == n // 100 and out[1] == n


def test_empty_and_clashing(no_docs, clashing):
    assert dedup_lines(no_docs).count() == 0
    out = dedup_lines(clashing)
    assert sorted(out.columns) == sorted(clashing.columns)
    assert out.count() == clashing.count()


def test_prefix_keys_lose_no_pair(spark):
    """Every two similar subsets of eleven tokens share a key whose places pass the filters."""
    subsets = [[t + 1 for t in range(11) if s >> t & 1] for s in range(1, 1 << 11)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(subsets)], "s int, t array<long>")
    keys = table.select("s", F.size("t").alias("n"), F.posexplode(line_dedup.prefix_keys(F.col("t"))).alias("i", "key"))
    other = keys.withColumnsRenamed({c: f"v{c}" for c in keys.columns})
    found = keys.join(other, (F.col("key") == F.col("vkey")) & (F.col("s") < F.col("vs")) & line_dedup._fits())
    got = {tuple(r) for r in found.select("s", "vs").distinct().collect()}
    sets = [set(t) for t in subsets]
    similar = {
        (i, j)
        for i, a in enumerate(sets)
        for j in range(i + 1, len(sets))
        if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j]))
    }
    assert similar and similar <= got


def test_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Lines that share a long passage, but are not similar, are told apart where they meet: hardly a pair goes on."""
    passage = " ".join(f"common{k}" for k in range(40))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    rows = [(i, f"{own(i)} {passage}", None, None, None) for i in range(300)]
    rows += [(300 + i, f"{own(i)} late{i} {passage}", None, None, None) for i in range(0, 300, 50)]
    compared = []
    plausible, verified = line_dedup._plausible, line_dedup._verified

    def counting(step):
        def count(pairs, *more):
            compared.append(pairs.select("d", "o", "vd", "vo").distinct().count())
            return step(pairs, *more)

        return count

    monkeypatch.setattr(line_dedup, "_plausible", counting(plausible))
    monkeypatch.setattr(line_dedup, "_verified", counting(verified))
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)
    assert sum(compared) < 10 * len(rows)


def test_rebuilding_splits_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx y z"), (2, "q\na b c d e\nr s")], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array_except" in plan and not re.search(r"split\(text#\d+, \n, -1\)\[lambda", plan)
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out.orderBy("doc_id").collect()] == [
        ("a b c d e\nx y z", 2, 0), ("q\nr s", 3, 1)
    ]
