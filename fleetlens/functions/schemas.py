"""Column layouts of the tables the operators exchange."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING_FIELDS = [
    ("repo", "string"),
    ("id", "string"),
    ("title", "string"),
    ("severity", "string"),
    ("category", "string"),
    ("status", "string"),
    ("confidence", "int"),
    ("file", "string"),
    ("line", "int"),
    ("endpoint", "string"),
    ("description", "string"),
    ("evidence", "string"),
    ("impact", "string"),
    ("trigger_condition", "string"),
    ("reproduction", "array<string>"),
    ("recommended_fix", "string"),
    ("source", "string"),
]

# What an absent field of a finding is taken to be.
FINDING_DEFAULTS = {
    "description": "",
    "evidence": "",
    "impact": "",
    "trigger_condition": "",
    "recommended_fix": "",
    "source": "manual",
}

FILES = "repo string, path string, content string"


def as_findings(df: DataFrame, extra=()) -> DataFrame:
    """Lay ``df`` out as findings, filling absent columns with their defaults.

    ``extra`` names columns to keep in front (a run key, a document order).
    """
    have = set(df.columns)
    columns = [F.col(name) for name in extra]
    for name, kind in FINDING_FIELDS:
        if name == "reproduction":
            empty = F.array().cast("array<string>")
            value = F.coalesce(F.col(name), empty) if name in have else empty
        elif name in FINDING_DEFAULTS:
            default = F.lit(FINDING_DEFAULTS[name])
            value = F.coalesce(F.col(name), default) if name in have else default
        elif name in have:
            value = F.col(name)
        else:
            value = F.lit(None)
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)
