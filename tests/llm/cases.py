"""Rows that every operator must take: NULLs, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and the of to" for i in range(12_000))

TEXTS = [
    (1, "The cat sat on the mat and the dog ran to the house of the man.", "en"),
    (2, "The cat sat on the mat and the dog ran to the house of the man.", "en"),
    (2, "The cat sat on the mat and the dog ran to the house of the man.", "en"),
    (3, "", "en"),
    (4, None, "de"),
    (None, "Der Hund und die Katze sind in dem Haus von dem Mann.", "de"),
    (None, None, None),
    (5, "   \t\n ", None),
    (6, "12345 !!! 678", "de"),
    (7, LONG, "en"),
    (8, "x" * 50_000, None),
    (9, "Der Hund und die Katze sind in dem Haus von dem Mann und der Frau.", "de"),
    (9, "another text under the same id", "en"),
    (10, "Ab​c \x1f \x85 ﬁ İ ẞ 漢字 é \U0001f600", None),
]

EXTRA = "score key n count fp row text_key spans value start end label probability word item_id hash __index __id __key __spans __fp __language gone_id secret_id leak".split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in EXTRA),
    ]
)


def documents(spark, rows=TEXTS, partitions=3):
    full = [(i, t, lang, None, None, *("extra",) * len(EXTRA)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
