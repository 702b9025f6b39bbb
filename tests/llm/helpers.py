"""Small fixtures with the awkward rows that every operator must take."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, cell long, fp string, h long, hits string"


def words(n, seed=1, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def awkward_rows():
    """Null in every column, empty and very long texts, ties, repeated rows, and
    columns whose names clash with those that operators use inside."""
    long = words(30_000, 7, 5_000)
    rows = [
        (1, "Hello world, the cat sat. Write to ann.b@mail.example.com or +1 (555) 010-9999.", "en", "a", 10, 1, "k", 1, "f", 1, "h"),
        (2, None, "en", "a", None, None, None, None, None, None, None),
        (3, "", "fr", None, 0, 1, "k", 1, "f", 1, "h"),
        (None, "no id here 10.0.0.1 and 4111 1111 1111 1111", None, "b", 5, 1, "k", 1, "f", 1, "h"),
        (5, long, "de", "b", len(long), 1, "k", 1, "f", 1, "h"),
        (6, "12345 !!! ---", "de", "c", 13, 1, "k", 1, "f", 1, "h"),
        (7, "same text twice, same text twice, ümlaut É é", "es", "c", 1, 1, "k", 1, "f", 1, "h"),
        (7, "same text twice, same text twice, ümlaut É é", "es", "c", 1, 1, "k", 1, "f", 1, "h"),
        (8, "same text twice, same text twice, ümlaut É é", "es", "c", 1, 1, "k", 1, "f", 1, "h"),
        (8, "another text of id eight 😀 astral", "en", "", 1, 1, "k", 1, "f", 1, "h"),
        (9, "\t\n  \x0b", "en", "d", 1, 1, "k", 1, "f", 1, "h"),
    ]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA)
