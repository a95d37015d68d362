"""Source files as a table: reading trees, path filters, caps, lines."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import any_of, basename, extension, literals, suffix
from ..functions.tables import numbered


def _binary_files(spark: SparkSession, path: str) -> DataFrame | None:
    """Files under ``path``, a folder or a glob; None when nothing is there."""
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("ignoreMissingFiles", True)
            .option("ignoreCorruptFiles", True)
            .load(path)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_tree(
    spark: SparkSession, root: str, max_bytes: int | None = None, max_depth: int = 20
) -> DataFrame:
    """Read ``root/<repo>/<path...>`` recursively as files(repo, path, content).

    For object stores and other Hadoop file systems. Spark's listing leaves out names that start
    with "." or "_" and everything below them. Hidden folders are added by one glob per folder
    level; a listing below them leaves out hidden names again, which the next level's glob
    brings, so every file is read exactly once. Hidden files and empty files stay invisible to
    Spark's readers; where the tree is mounted on all nodes, ``repo_tree`` reads those as well.

    Bytes that are not UTF-8 become U+FFFD. Files that vanish or cannot be read while the scan
    runs are skipped. ``max_bytes`` leaves larger files out when set; the reader drops them by
    their listed length, before opening them.
    """
    parts = [_binary_files(spark, root)]
    for depth in range(1, max_depth + 1):
        level = root.rstrip("/") + "/*" * depth
        if _binary_files(spark, level) is None:
            break
        parts.append(_binary_files(spark, level + "/{.,_}*"))
    found = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
    if max_bytes is not None:
        found = found.filter(F.col("length") <= max_bytes)
    base = root.split(":", 1)[-1].strip("/")
    relative = F.substring_index("path", "/" + base + "/", -1)
    return found.select(
        F.substring_index(relative, "/", 1).alias("repo"),
        F.regexp_replace(relative, r"^[^/]*/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet table that already has the columns repo, path and content."""
    return spark.read.parquet(path).select("repo", "path", "content")


def excluded_names(extra=(), output_directory: str = "audit-results") -> list[str]:
    """Names that hide a path when any of its parts, the base name included, equals one."""
    own = [p for p in output_directory.split("/") if p][-1:]
    return list(dict.fromkeys([*V.EXCLUDED_NAMES, *extra, *own]))


def kept_path(path: Column, names=None) -> Column:
    hidden = F.expr(f"array({literals(names or excluded_names())})")
    return ~F.arrays_overlap(F.split(path, "/"), hidden)


def exclude(files: DataFrame, names=None) -> DataFrame:
    return files.filter(kept_path(F.col("path"), names))


def cap(files: DataFrame, limit: int = V.MAX_FILES_PER_REPO) -> DataFrame:
    """Keep the first ``limit`` paths of every repo and flag the repos that had more.

    Only repos over the limit are ranked, on their paths alone; file contents never move for it.
    """
    sizes = files.groupBy("repo").agg((F.count("*") > limit).alias("truncated"))
    crowded = sizes.filter("truncated").select("repo")
    paths = files.select("repo", "path").join(crowded, "repo", "left_semi")
    surplus = numbered(paths, ["repo"], ["path"]).filter(F.col("n") > limit).drop("n")
    return files.join(surplus, ["repo", "path"], "left_anti").join(sizes, "repo")


def is_text(path: Column) -> Column:
    return basename(path).startswith(".env") | extension(path).isin(V.TEXT_EXTENSIONS)


def is_route_file(path: Column) -> Column:
    skipped = any_of(F.lower(path).contains(p) for p in V.ROUTE_SKIPPED_PARTS)
    return suffix(path).isin(V.ROUTE_SUFFIXES) & ~skipped


def is_risky_config(path: Column) -> Column:
    """Files the configuration scanner opens (wider than the discovery list of config files)."""
    ending = suffix(path)
    named = F.lower(path).rlike("(?:" + "|".join(V.RISKY_CODE_STEMS) + r")\.[a-z]+\z")
    return is_text(path) & (
        basename(path).startswith(".env")
        | ending.isin(V.RISKY_CONFIG_SUFFIXES)
        | (ending.isin(V.RISKY_CODE_SUFFIXES) & named)
    )


def text_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable text files, optionally the first ``limit`` of every repo."""
    kept = files.filter(is_text(F.col("path")))
    return kept if limit is None else cap(kept, limit).drop("truncated")


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line with a 1-based ``line_no``; all other columns are kept."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(F.split(text, V.LINE_BREAK)).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def lines_matching(files: DataFrame, pattern: str, text: str = "content") -> DataFrame:
    """Lines of the files in which ``pattern`` occurs at all.

    A file without any match is dropped before its lines are made, so only the few files with a
    hit are exploded. ``pattern`` must be free of line anchors, so that a match inside one line
    is also a match in the whole text.
    """
    return explode_lines(files.filter(F.col(text).rlike(pattern)), text)
