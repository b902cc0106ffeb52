"""Small tables with everything that may go wrong in one place."""

import random

from pyspark.sql import types as T

WORDS = "the of and to in house river stone bright quickly garden letter window morning evening people water under table silver".split()
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def document_rows():
    long = prose(99, 40_000)
    texts = [
        (1, prose(1)), (2, prose(2)), (3, prose(1)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, long), (8, "x" * 300_000), (9, "no letters? 123"),
        (10, "12 34 !!"), (11, "Été là çà 中文 \U0001f600"), (None, prose(3)), (None, None), (2, prose(2)), (2, prose(2)), (12, prose(4).upper()),
    ]
    return [(i, t, None if k % 5 == 3 else "en", None if k % 4 == 1 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


#: Names that the operators use themselves.
CLASHING = ["score", "n_words", "fp", "row", "_row", "host", "wrapper", "q_text", "lang_pred", "token_ids", "hit_spans", "root", "key", "t", "size", "shard", "slot", "a.b", "text.size"]


def documents(spark, clash=False, rows=None):
    df = spark.createDataFrame(document_rows() if rows is None else rows, DOCUMENTS)
    if clash:
        for name in CLASHING:
            df = df.selectExpr("*", f"'{name}!' AS `{name}`")
    return df


def nothing(spark, clash=False):
    return documents(spark, clash, [])


def as_text(df):
    """Rows in an order of their own."""
    return sorted(map(repr, df.collect()))
