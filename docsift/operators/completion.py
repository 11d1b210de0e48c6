"""Completion of paths, tags and other names from a stored index.

The different values are written in order, so what begins with a text is one
range of the file; and the 3-grams of the folded values are written in gram
order, so what contains a text is found in the ranges of its grams and then
compared.  No search reads all values, but for texts shorter than a gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.facets import first_rows

GRAM = 3
ROW_GROUP = 4 << 20  # bytes of a row group: the least that a range reads


def _grams(folded: Column) -> Column:
    n = F.length(folded) - F.lit(GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(folded, i, F.lit(GRAM)))))


def write_completions(values: DataFrame, path: str, col: str = "value", contains: bool = True) -> Completions:
    """Write the index of the different values of ``col`` (nulls left out) with
    their number of rows as ``weight``."""
    spark = values.sparkSession
    rows = values.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    (rows.withColumn("folded", F.lower("value")).repartitionByRange("value").sortWithinPartitions("value")
     .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/values"))
    if contains:
        stored = spark.read.parquet(f"{path}/values")
        (stored.select(F.explode(_grams(F.col("folded"))).alias("gram"), "value", "folded", "weight")
         .repartitionByRange("gram", "value").sortWithinPartitions("gram", "value")
         .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/grams"))
    return open_completions(spark, path, contains)


def open_completions(spark: SparkSession, path: str, contains: bool = True) -> Completions:
    return Completions(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/grams") if contains else None)


class Completions:
    """The stored values (value, weight, folded) and their 3-grams."""

    def __init__(self, values: DataFrame, grams: DataFrame | None = None):
        self.values, self.grams = values, grams

    def starting(self, text: str) -> DataFrame:
        """(value, weight) of the values that begin with ``text``: their range."""
        return self.values.where(F.col("value").startswith(text)).select("value", "weight")

    def containing(self, text: str) -> DataFrame:
        """(value, weight) of the values that contain ``text`` in any case."""
        low = text.lower()
        wanted = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not wanted or self.grams is None:
            return self.values.where(F.col("folded").contains(low)).select("value", "weight")
        # a value that contains the text has all of its grams, so the rows of one are enough
        return self.grams.where((F.col("gram") == wanted[0]) & F.col("folded").contains(low)).select("value", "weight")

    def suggest_paths(self, text: str, n: int | None = None) -> DataFrame:
        """Values that begin with ``text``; when none does, those that
        contain it ignoring case.  Shortest first, then alphabetical."""
        start = self.starting(text)
        begins = start.select(F.count(F.lit(1))).scalar() > 0
        # what begins with the text contains it, too
        found = start.unionByName(self.containing(text).where(~begins))
        return first_rows(found.orderBy(F.length("value"), "value"), n).select("value")

    def suggest(self, text: str, n: int | None = None, by_weight: bool = False) -> DataFrame:
        """Values that begin with ``text``, in order or the most frequent first."""
        order = [F.col("weight").desc(), F.col("value")] if by_weight else [F.col("value")]
        return first_rows(self.starting(text).orderBy(*order), n).select("value", "weight")
