"""Small tables with every awkward case."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n", T.StringType()),  # names that operators use themselves
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("n_lines", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
AWKWARD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "Alpha beta gamma\tdelta epsilon zeta eta  theta iota kappa"),
    (2, "Alpha beta gamma\tdelta epsilon zeta eta  theta iota kappa"),  # a row that repeats
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "a text without an id, of some words, that nobody else has at all"),
    (None, None),
    (6, "one two"),
    (7, "ONE two"),
    (8, LONG),
    (9, LONG + " more"),
    (10, "tie \U0001f600 näh ##$ | a@b.de\nsame line of a fair length here\nsame line of a fair length here"),
    (11, "other\nsame line of a fair length here\n"),
    (12, "third\n  SAME line of a fair length here \x0b\nend"),
]


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(
        [(i, t, None, None if i == 6 else "h", None if t is None else len(t), "n", "r", "k", "x", "l") for i, t in rows], SCHEMA
    )


def table(spark, name, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
