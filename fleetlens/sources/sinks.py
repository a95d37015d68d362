"""Writing results: findings tables, report rows and document chunks, Markdown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet split by severity, a short fixed list, and clustered by repository inside.

    One directory per repository would give a fleet millions of tiny files. Range partitioning
    on (repo, ordinal) spreads a huge repository over many files and lets readers skip row
    groups by repository.
    """
    (
        findings.repartitionByRange("repo", "ordinal")
        .sortWithinPartitions("repo", "ordinal")
        .write.mode(mode)
        .partitionBy("severity")
        .parquet(path)
    )


def write_rows(rows: DataFrame, path: str, order, mode: str = "overwrite") -> None:
    """Report rows or document chunks as JSON lines in global order.

    Reading the files by name gives every report in its order, however large.
    """
    (
        rows.repartitionByRange("repo", *order)
        .sortWithinPartitions("repo", *order)
        .write.mode(mode)
        .json(path)
    )


def write_markdown(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report text, one folder per repository, rows in order across its files."""
    (
        rows.repartitionByRange("repo", "section_no", "part", "ordinal")
        .sortWithinPartitions("repo", "section_no", "part", "ordinal")
        .select("repo", F.col("text").alias("value"))
        .write.mode(mode)
        .partitionBy("repo")
        .text(path)
    )
