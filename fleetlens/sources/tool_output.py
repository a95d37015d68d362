"""Output documents of external scanners, one row per (repo, run, tool)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def usable_outputs(scan_runs: DataFrame) -> DataFrame:
    """Completed runs with a non-blank document of a tool that can be ingested."""
    return scan_runs.filter(
        (F.col("status") == "completed")
        & (F.trim("stdout") != "")
        & F.col("tool").isin(V.PARSEABLE_TOOLS)
    )


def outputs_of(scan_runs: DataFrame, tool: str) -> DataFrame:
    return usable_outputs(scan_runs).filter(F.col("tool") == tool)
