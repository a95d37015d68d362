"""Helpers that several operators share."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: A word: a run of characters that are neither a space nor one of tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of words of a text; 0 for null.

    Words of the trimmed text, with every run of white space made one space, are one more than
    its spaces. Replacing fixed strings is several times faster than matching each word.
    """
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    single = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    single = F.trim(single)
    spaces = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit("")))
    count = F.when(single == "", F.lit(0)).otherwise(spaces + 1)
    return F.coalesce(count, F.lit(0)).cast("long")


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Number all rows from 1 in ``order``, which must make them distinct.

    Rows are range-partitioned over the order and numbered within their slice; a slice is shifted
    by the row counts of the earlier ones. Only one count per slice meets in one place.
    """
    sliced = written(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ranked"
    )
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        sliced.groupBy("_slice")
        .count()
        .select("_slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy("_slice").orderBy(*order)
    return (
        sliced.withColumn("_at", F.row_number().over(within))
        .join(shift, "_slice")
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_shift", "_slice")
    )
