"""Plain versions of the contracts, and texts that try them."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def texts(n=60, seed=1, words=400):
    """Texts over few words with copies, near copies, shared passages, repeated
    lines, odd characters, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = [None, "", " \n\t ", "one", "Three Short words", "a\u00a0b \u2028 c"]
    while len(out) < n:
        kind = rng.randrange(6)
        base = " ".join(rng.choices(vocabulary, k=rng.randint(5, 150)))
        if kind == 1 and len(out) > 8:
            base = rng.choice(out[6:])
        elif kind == 2 and len(out) > 8:
            parts = rng.choice(out[6:]).split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            base = " ".join(parts)
        elif kind == 3:
            base = f"{base}. {passage} {base[:40]}"
        elif kind == 4:
            base = "\n".join([base] + [rng.choice(["Again and again.", "xy " * 60, base[:50]])] * rng.randint(1, 4))
        out.append(base if rng.random() < 0.5 else base.title())
    return out


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame(rows, DOCS).repartition(3)
