"""Small documents with the awkward cases every operator must define."""

import random

VOCAB = [f"w{i}" for i in range(60)] + ["the", "of", "and", "été", "größe", "日本"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def make_rows(seed=1, n=60):
    """Random documents with copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    line = sentence(rng, 9)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.3:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = "\n".join(sentence(rng, rng.choice([2, 6, 12, 25])) for _ in range(rng.randint(1, 5)))
            if kind > 0.8:
                text += "\n" + line
            if kind > 0.9:
                text = sentence(rng, 5) + " " + passage + " " + text
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    return rows


ODD_ROWS = [
    (100, None, None, None, None),
    (101, "", "en", "s", 0),
    (102, " \t\n\r\x0b\x0c ", "en", "s", 7),
    (103, "one", "en", "s", 3),
    (104, "A  b c d " * 3000, "en", "s", 24000),
    (105, "x" * 50_000, "en", "s", 50_000),
    (106, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "en", "s", 59),
    (107, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "en", "s", 59),
    (107, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie", "en", "s", 59),
    (None, "no id but words of its own that others lack entirely here and there today", "en", "s", 70),
    (None, "no id but words of its own that others lack entirely here and there today", "en", "s", 70),
    (-5, "a negative id comes first of all ids in this table and it is fine", "en", "s", 66),
    (108, "<|endoftext|> combining é and \x1c separators\x1f", "en", "s", 40),
]
