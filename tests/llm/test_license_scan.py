import random
import re

from chronoframe.llm.license_scan import FOREIGN, build_automaton, chain_anchors, chain_value, matching_statistics, scan, scan_licenses, tokens

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def plain_tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_tokens_follow_the_contract(rows):
    for r in rows:
        assert [t.decode() for t in tokens(r[1])] == plain_tokens(r[1])
    assert [t.decode() for t in tokens("É ÀB c3-x_y\x7f ß")] == plain_tokens("É ÀB c3-x_y\x7f ß")


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    words = [b"a", b"b", b"c"]
    for _ in range(30):
        templates = [(f"t{k}", [rng.choice(words) for _ in range(rng.randint(1, 12))], k == 0) for k in range(4)]
        from chronoframe.llm.license_scan import Automaton

        sam = Automaton().build(templates)
        subs = {tuple(w[i:j]) for _, w, _ in templates for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        text = [rng.choice([*words, b"z"]) for _ in range(60)]
        got = {i: n for i, _, n in matching_statistics(sam, text)}
        for i in range(len(text)):
            best = max((n for n in range(1, i + 2) if tuple(text[i - n + 1 : i + 1]) in subs), default=0)
            assert got.get(i, 0) == best
        phrase = templates[0][1]
        places, _ = scan(sam, text, 3, 8, 0.75)
        want = [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]
        assert sorted(at for _, at in places) == want


def test_chain_bridges_a_changed_word_and_splits_far_ones():
    assert list(chain_anchors([(0, 10, 0, 4), (0, 15, 5, 4)], 8)) == [(0, 10, 19, 0, 9, 8, 1)]
    assert list(chain_anchors([(0, 10, 0, 4), (0, 50, 5, 4)], 8)) == [(0, 10, 14, 0, 4, 4, 0), (0, 50, 54, 5, 9, 4, 0)]
    assert list(chain_anchors([(0, 10, 0, 5), (0, 13, 3, 5)], 8)) == [(0, 10, 18, 0, 8, 8, 0)]


def test_best_chain_against_all_chains():
    rng = random.Random(4)
    for _ in range(300):
        own = sorted({(rng.randrange(25), rng.randrange(12), rng.randint(2, 5)) for _ in range(rng.randint(1, 7))})
        values = []
        for mask in range(1, 1 << len(own)):
            found = chain_value([x for k, x in enumerate(own) if mask >> k & 1], 3)
            if found:
                values.append(found[0] - FOREIGN * found[1])
        chains = list(chain_anchors([(0, *x) for x in own], 3))
        assert max(c - FOREIGN * f for *_, c, f in chains) == max(values)
        spans = sorted((a, b) for _, a, b, *_ in chains)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def labels(text):
    return {s["label"] for s in scan(build_automaton(), tokens(text), 3, 8, 0.75)[1]}


def test_licences_are_told_apart():
    cc = "licensed under a Creative Commons Attribution{} 4.0 International License"
    assert labels(cc.format("")) == {"cc-by-4.0"}
    assert labels(cc.format("-NonCommercial")) == {"cc-by-nc-4.0"}
    assert labels(cc.format("-NoDerivatives")) == {"cc-by-nd-4.0"}
    assert labels(cc.format("-NonCommercial-ShareAlike")) == {"cc-by-nc-sa-4.0"}
    assert labels(cc.format("-Something")) == set()
    assert labels("Licensed under CC BY-NC-SA 4.0.") == {"cc-by-nc-sa-4.0"}
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == {"bsd-3-clause"}
    assert labels("SPDX-License-Identifier: Apache-2.0") == {"apache-2.0"}
    assert labels("SPDX-License-Identifier: Unknown") == set()
    assert labels("made available under the Eclipse Public License v 2.0") == {"epl-2.0"}
    assert labels("under the European Union Public Licence, version 1.2") == {"eupl-1.2"}
    assert labels("the 3-clause BSD; New BSD License") == {"bsd-3-clause"}
    assert labels("under the MIT License") == {"mit"} and labels("under the other License") == set()


def test_many_repeated_anchors_stay_cheap():
    """A text of 20,000 times the same licence words: each place of the chain looks back a bounded way."""
    text = "under the MIT License " * 5_000
    assert len(scan(build_automaton(), tokens(text), 3, 8, 0.75)[1]) == 5_000


def test_spans_and_labels():
    sam = build_automaton()
    text = "Code. Permission is hereby granted, FREE of charge, to any person obtaining one copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    places, spans = scan(sam, tokens(text), 3, 8, 0.75)
    assert not places and "mit" in {s["label"] for s in spans}
    places, spans = scan(sam, tokens("Licensed under CC BY-NC 4.0. All rights reserved."), 3, 8, 0.75)
    assert {p for p, _ in places} == {"cc-by", "reserved"} and "cc-by-nc-4.0" in {s["label"] for s in spans}
    assert scan(sam, tokens("the software and the license of the work"), 3, 8, 0.75)[1] == []


def test_scan_over_documents(spark, docs, clashing, no_docs, rows):
    out = {(r["doc_id"], r["n_words"]) for r in scan_licenses(docs).collect()}
    assert out == {(r[0], len(plain_tokens(r[1]))) for r in rows}
    assert scan_licenses(no_docs).count() == 0
    assert scan_licenses(clashing).columns == ["doc_id", "n_words", "base_places", "spans"]
    d = spark.createDataFrame([(1, "GNU General Public License; general public\nlicense all rights reserved")], "doc_id long, text string")
    row = scan_licenses(d).first()
    assert sorted((p["label"], p["start"]) for p in row["base_places"]) == [("gpl", 1), ("gpl", 4), ("reserved", 7)]
