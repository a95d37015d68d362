"""Helpers that need a session: written intermediate tables, safe numbering, lookup tables."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import quoted


@cache
def local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    In local mode an unset folder is replaced by a temporary one that is removed at exit.
    On a cluster an unset folder is an error, since executors could not read it back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = local_folder()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"


_records: list[list[str]] = []


@contextmanager
def recorded():
    """Collects the folders of the tables that are written meanwhile, for ``removed``."""
    paths: list[str] = []
    _records.append(paths)
    try:
        yield paths
    finally:
        _records.remove(paths)


def removed(spark: SparkSession, paths) -> None:
    """Remove written tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        folder = hadoop(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    Later branches share one computation, survive lost executors, and Spark knows the true
    size of the result when it picks join strategies.
    """
    path = fresh_path(df.sparkSession, name)
    for paths in _records:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(spark: SparkSession, fields, rows) -> DataFrame:
    """Short literal table. Plans as a local relation, so joins on it broadcast by its real size."""
    def cell(value):
        return quoted(value) if isinstance(value, str) else str(value)

    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(fields)})")


# Rows of a group up to which one task numbers it, and rows that a task of a larger table gets.
GROUP_ROWS = 100_000
TASK_ROWS = 250_000


def numbered(df: DataFrame, by, order, name: str = "n") -> DataFrame:
    """Number the rows of every ``by`` group from 1 in ``order``, whatever the group sizes.

    ``order`` must make the rows of a group distinct; rows with a NULL key are a group of their own.
    Groups of up to ``GROUP_ROWS`` rows are numbered by a window: one shuffle, which carries only the columns
    that are read later. Larger groups, of which there are few, are numbered in slices.
    """
    by, order = list(by), list(order)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    most, total = sizes.agg(F.max("_rows"), F.sum("_rows")).first()

    def whole(rows: DataFrame) -> DataFrame:
        tasks = -(-(total or 0) // TASK_ROWS)
        if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(tasks, *by)
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    if (most or 0) <= GROUP_ROWS:
        return whole(df)
    keys = [f"_key{k}" for k in range(len(by))]
    large = written(sizes.filter(F.col("_rows") > GROUP_ROWS).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]), "large")
    same = reduce(Column.__and__, [df[c].eqNullSafe(large[k]) for c, k in zip(by, keys, strict=True)])
    sliced = _numbered_in_slices(df.join(large, same, "left_semi"), by, order, name)
    return whole(df.join(large, same, "left_anti")).unionByName(sliced)


def _numbered_in_slices(df: DataFrame, by: list, order: list, name: str) -> DataFrame:
    """The same for groups of any size.

    Rows are range-partitioned over the whole (group, order) key, so a huge group spreads over
    many slices; each slice is numbered on its own and shifted by the row count of the group's
    earlier slices. Only one count per (group, slice) crosses slices.
    """
    # The slice number must not change between the two reads below, so it is written out.
    sliced = written(
        df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()), "sliced"
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sliced.groupBy(*by, "_slice").count().select(
        "_slice",
        F.struct(*by).alias("_group"),
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"),
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    numbers = sliced.withColumn("_at", F.row_number().over(within))
    same = reduce(
        Column.__and__,
        [numbers[c].eqNullSafe(shift["_group"][c]) for c in by],
        numbers["_slice"] == shift["_slice"],
    )
    return (
        numbers.join(shift, same)
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*df.columns, name)
    )
