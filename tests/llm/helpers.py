"""Edge-case documents and brute-force helpers shared by the tests."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))


def prose(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    words = []
    for _ in range(n):
        words.append("".join(rng.choice(["an", "the", "or", "ing", "st", "re", "wh", "éa", "ou"])
                             for _ in range(rng.randint(1, 4))) + str(rng.randrange(vocabulary)))
    return " ".join(words)


def edge_docs(spark):
    """Nulls, empty and long texts, white space only, repeated rows, shared ids, clashing columns."""
    rows = [(1, prose(1)), (2, prose(2)), (3, None), (4, ""), (None, prose(3)), (None, None),
            (5, LONG), (6, prose(2)), (7, prose(7)), (7, prose(7)), (8, prose(8)), (8, prose(9)),
            (9, " \t\n \r\n"), (10, "Über Ärger 日本語   ünd\x00 €"), (11, "a"), (12, "A"), (13, "!!! ..."),
            (14, prose(1) + " " + prose(1))]
    df = spark.createDataFrame([(i, t, "en" if i != 2 else None, "s", len(t or "")) for i, t in rows], SCHEMA)
    for c in ("words", "key", "h", "od", "bucket", "n_lines", "kept_text", "score", "class_id", "shard"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(n, links):
    """Smallest member of the component of each of 0 .. n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
