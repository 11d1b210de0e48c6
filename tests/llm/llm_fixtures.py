"""Small document tables with the awkward cases every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, rows, extra=()):
    """``rows``: (doc_id, text) or (doc_id, text, source); ``extra``: names of
    additional columns, such as names that operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) + (7,) * len(extra)
            for r in rows]
    schema = T.StructType(DOCS.fields + [T.StructField(n, T.IntegerType()) for n in extra])
    return spark.createDataFrame(full, schema)


AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two THREE four five six"),
           (6, "one two three four five six"), (7, "x" * 30000), (8, "ein zwei drei " * 3000), (None, "no id at all"),
           (9, None), (10, "tie tie tie"), (10, "tie tie tie"), (11, "日本語 текст é\u0085 \x1c"), (12, "a  b\n\n  c ▁ d")]
EXTRA = ("score", "n_tokens", "length", "start", "fingerprint", "component_id", "_row", "size", "target", "words")
