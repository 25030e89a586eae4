"""Awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew tea near old stone bridges and quiet rivers".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark):
    """doc_id, text, lang, source, n_chars and columns whose names operators use inside."""
    line = "a line that is long enough to be counted by the filter"
    base = prose(1, 120)
    rows = [
        (None, None, None, None), (None, base, "en", "a"), (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t", "de", "a"), (4, "one", "de", "a"),
        (5, base, "en", "a"), (6, base, "en", "b"), (7, base.replace("fox", "cat", 1), "en", "b"), (8, base, None, "b"),
        (9, prose(2, 60) + "\n" + line, "en", "a"), (10, prose(3, 60) + "\n" + line.upper() + "  ", "en", "a"), (11, line + "\n" + prose(4, 30), "en", "a"),
        (12, line + "\n" + line, "en", "a"), (13, "\n" + line + "\n", "en", "a"), (14, prose(5, 40), "fr", "c"), (14, prose(5, 40), "fr", "c"),
        (15, prose(6, 8000), "fr", "c"), (16, "x" * 3000, "fr", "c"), (17, "héé \U0001f600 " * 60, "fr", "c"), (18, "héé \U0001f600 " * 50, "fr", "c"), (19, "1234 5678 !!", "de", "c"),
    ]
    rows = [(i, t, la, s, len(t) if t else None, "k", 1, "z") for i, t, la, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, rep string").repartition(3)


def empty(df):
    return df.where("false")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
