"""Awkward documents, shared by the tests of all operators."""

import random

rng = random.Random(1)
PROSE = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(400))
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),  # a repeated row
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "one two", "en", "b"),
    (8, "ONE two", "en", "é"),
    (9, PROSE.replace("a", "A", 3), "en", "b"),
    (10, "x" * 3000, "en", "b"),
    (11, "\x00   ünï 𝄞 <|endoftext|>", "en", "b"),
    (None, "a text without an id " * 30, "en", "b"),
]


def docs(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    # columns that clash with names inside the operators
    return df.selectExpr("*", "1 AS key", "'k' AS uid", "2 AS node", "3 AS block", "'h' AS h", "4 AS n", "5 AS _id", "'x' AS _hash", "6 AS _own", "7 AS _row", "8 AS copies", "'s' AS shards", "9 AS rid", "1 AS size", "2 AS bin", "3 AS text_hash", "0 AS run", "1 AS n_hit") if extra else df


def empty(spark):
    return docs(spark, extra=True).limit(0)


def items(spark):
    words = PROSE.split()
    rows = [(1, " ".join(words[50:80])), (2, " ".join(words[:13]).upper()), (3, "one, TWO!"), (4, None), (5, ""), (1, " ".join(words[50:80])), (None, " ".join(words[100:120])), (7, "never seen words at all in any of the documents here to be found")]
    return spark.createDataFrame(rows, "item_id long, text string")
