"""Small documents with repeats, and the words and hashes the brute-force versions share."""

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def odd_rows(first=10_000):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(first, None), (first + 1, ""), (first + 2, "x"), (first + 3, " \n\t "), (first + 4, "é 😀 " * 300),
            (first + 5, "same text twice in the table, word for word"), (first + 6, "same text twice in the table, word for word"),
            (first + 7, "repeated row"), (first + 7, "repeated row"), (None, "no id"), (None, None),
            (first + 8, "long " + " ".join(f"w{i % 977}" for i in range(30_000)))]


def repeating(seed, n=100, vocabulary=30, join=" "):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)] if join else list("abcdé ")
    base = [rng.choice(pool) for _ in range(3000 if not join else 400)]
    size = 300 if not join else 60
    rows = []
    for i in range(n):
        a = rng.randint(0, len(base) - size)
        own = [rng.choice(pool) for _ in range(rng.randint(0, size // 2))] + base[a:a + rng.randint(1, size)] \
            + [rng.choice(pool) for _ in range(rng.randint(0, size))]
        if i % 10 == 0:
            own = [pool[0]] * rng.randint(1, size * 2)
        if i % 17 == 0:
            own = own * 2
        rows.append((i, join.join(own)))
    return rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def with_extra_columns(df):
    """The table with columns whose names an operator could use itself."""
    from pyspark.sql import functions as F

    names = ["id", "key", "guard", "pos", "run", "fp", "spans", "parts", "length", "component", "quality", "pii",
             "contamination", "start", "_id", "_h", "h", "t", "n"]
    return df.withColumns({c: F.lit(f"mine {c}") for c in names if c not in df.columns})
