"""Rows that every corpus operator must take, and columns whose names clash with their own."""

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "", str(pick.randrange(50))]) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, "Plain text of a few words."),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\f\r "),
    (5, LONG),
    (6, LONG),
    (7, "Plain text of a few words."),
    (7, "Plain text of a few words."),
    (None, "Plain text of a few words."),
    (None, None),
    (8, "ünïcödé 漢字 😀 \u0085   ends"),
    (9, "a" * 20_000),
    (10, "1 " * 9_000),
    (11, "\n" * 500),
]
NAMES = (
    "digest chunk recipe rank salt order text_hash place minimizer value class_id component hub group n"
    " copy shuffle_key weight score kept key toxic quality stats ids start end spans candidates"
)


def frame(spark, rows=ROWS):
    """doc_id, text, lang, source, n_chars, and columns with the operators' own names, some null."""
    extra = NAMES.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{n} string" for n in extra
    )
    full = [
        (i, t, None if k % 3 else "en", None if k % 4 == 3 else f"s{k % 2}", len(t or ""))
        + tuple(None if k % 2 else "x" for _ in extra)
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schema)


def empty(spark):
    return frame(spark).filter("false")
