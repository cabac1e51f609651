"""Small tables with every kind of odd row, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHES = ["n_words", "score", "kept", "id", "token_ids", "n_removed", "seed", "group", "prev", "Key", "bucket", "scale", "m0", "c00", "_counted", "estimate", "tie"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def odd_rows():
    """Null, empty, blank, short, long, repeated, copied and nearly copied texts."""
    a, b = prose(1, 120), prose(2, 90)
    near = a.replace(a.split()[60], "changed", 1)
    texts = [
        (1, a), (2, a), (3, near), (4, b), (5, b + " " + a), (6, None), (7, ""), (8, " \n\t\x0b "), (9, "one"), (10, "one two three"),
        (11, "tick " * 300), (12, prose(3, 20000, 50)), (13, "é€😀 " * 80), (14, "one two three"), (None, a), (None, None), (15, b), (15, b), (16, "x" * 5000),
        (17, "▁▁  a\r\n \x00 <|im_end|>"), (18, prose(4, 60)),
    ]
    return [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "s", k, *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
