"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away home", "a"),
    (2, "The quick brown fox  jumps over the lazy dog and runs away home", "a"),
    (2, "The quick brown fox  jumps over the lazy dog and runs away home", "a"),
    (3, "the quick brown fox jumps over the lazy dog and runs away homes", None),
    (4, None, "b"),
    (5, "", "b"),
    (6, " \t\n", None),
    (None, "the quick brown fox jumps over the lazy dog and runs away home", "c"),
    (None, None, None),
    (7, LONG, "c"),
    (8, "é ü 漢字 <|endoftext|> it's 42\x1c\x85x y", "c"),
    (9, "word", "a"),
]
CLASHING = ["_rid", "_id", "_key", "_text", "id", "fp", "n", "size", "taken", "kept", "group_size", "finish", "weight", "_source"]


def frame(spark, rows=DOCS, extra=True):
    t = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    if extra:
        t = t.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
    return t


def saved(spark, tmp_path, name="docs", **how):
    at = f"file://{tmp_path}/{name}"
    frame(spark, **how).write.parquet(at)
    return spark.read.parquet(at)
