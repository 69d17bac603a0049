"""Small documents with everything that tends to break: nulls, empties, repeats, long texts, clashing column names."""

LONG = " ".join(f"w{k % 997}" for k in range(20000))
SAME = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while in the sun " * 3
EDGE = [
    (0, SAME, "en", "src0", 10), (1, SAME, "en", "src0", None), (2, SAME + "today", None, "src1", 5), (3, None, "en", None, 0), (4, "", "de", "src1", 0), (5, " \n\t ", None, None, None),
    (6, "one", "en", "src2", 3), (7, LONG, "en", "src0", len(LONG)), (8, LONG + " more words at the end", "fr", "src0", 1), (9, "mail me: joe@mail.example.com now, or joe@mail.example.com later", "en", "src2", 9),
    (10, "é ü 日本 🙂 text", "xx", "src3", 1), (None, SAME, "en", "src0", 1), (None, None, None, None, None), (12, "one", "en", "src2", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, extra: bool = True):
    """The rows above in several partitions, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(EDGE, SCHEMA).repartition(3)
    if extra:
        for c in ("id", "key", "h", "fp", "size", "rank", "root", "node", "grp", "value", "count"):
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
