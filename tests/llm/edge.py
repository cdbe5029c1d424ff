"""Tables that hold every odd case once, and brute-force answers."""

from __future__ import annotations

import random
from itertools import cycle

WORDS = ["the", "of", "A", "Über", "naïve", "x", "don't", "42", "end."]
#: Columns that operators use inside; they must not get in each other's way.
CLASHING = "rank int, score double, n bigint, node string, kept boolean, block int, weight double, page string"
DOCUMENT = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sentence(chance: random.Random, n: int) -> str:
    return " ".join(chance.choice(WORDS) + chance.choice(["", "", str(chance.randint(0, 30))]) for _ in range(n))


def edge_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    chance = random.Random(seed)
    base = sentence(chance, 120)
    other = sentence(chance, 60)
    edited = base.split()
    edited[50] = "changed"
    long = sentence(chance, 6000)
    return [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "One"), (9, "two words"),
        (10, long), (11, other + " " + " ".join(base.split()[20:70]) + " " + other), (12, base.upper()), (13, long[: len(long) // 2]), (None, base), (None, None),
        (14, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"), (15, " nbsp stays\x0bin\x0cword x"), (2, base), (16, "<s> </s> <|endoftext|> <unk>"), (-5, other),
    ]


def edge_documents(spark, texts=None):
    rows = [(i, t, None, s, None, 1, 0.5, 2, "n", True, 3, 0.1, "p") for (i, t), s in zip(texts or edge_texts(), cycle(["a", "a", None, "b", "a", ""]))]
    return spark.createDataFrame(rows, DOCUMENT)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
