import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and a to in is it you that he was for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
#: Columns of no meaning with names that operators use for their own.
CLASHING = ["size", "shard", "slot", "h", "n", "node", "score", "spans", "matches", "n_lines", "rid", "copies", "component", "target", "taken", "bucket", "count", "_t_text", "_t_id"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "er", "ing"])) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Ids, texts, languages and sources with every unpleasant case."""
    long = prose(60_000, 1)
    rows = [
        (1, "a short one", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \t\n ", "en", "s2"), (5, long, "en", "s1"), (6, long + " end", "en", "s1"),
        (7, "x" * 200_000, "de", "s3"), (8, "Same text here, twice.\nSame text here, twice.", "en", "s1"), (9, "same TEXT here, twice.\n\n", "en", "s1"), (9, "same TEXT here, twice.\n\n", "en", "s1"),
        (None, "no id at all here", "en", None), (None, None, None, None), (10, "12345 !!! 678", "en", "s1"), (11, "日本語 テキスト", None, "s2"), (12, "line one is long enough\r\nline two is long enough", "fr", "s9"),
    ]
    return rows + [(100 + i, prose(40 + i % 7, i // 2), "en" if i % 3 else "fr", f"s{i % 5}") for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
