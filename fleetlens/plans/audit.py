"""The whole audit as one Spark job over a fleet: discover, scan, ingest, report, gate, sync.

Stages hand over tables under one target folder, so each can be run again on its own and a
later stage never recomputes an earlier one.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.schemas import as_findings
from ..functions.tables import numbered, written
from ..operators import coverage, discovery, findings, ingest, reports, scanners
from ..sources import files as source
from ..sources import sinks


@dataclass
class Settings:
    """Job arguments. Caps are off by default: a fleet job reads every file."""

    exclude: tuple = ()
    output_directory: str = "audit-results"
    max_files: int | None = None
    disabled: tuple = ()
    security: bool = True
    dependencies: bool = True
    minimum_confidence: int = V.MINIMUM_CONFIDENCE
    fail_on: str = "high"


def save(df: DataFrame, target: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{target}/{name}")
    return load(df.sparkSession, target, name)


def load(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}")


def in_document_order(rows: DataFrame) -> DataFrame:
    """Give each finding its place in its repository's report: scanners first, then tools."""
    sources = [*[f"scanner:{name}" for name, _ in scanners.SCANNERS], *[f"tool:{t[0]}" for t in V.TOOLS]]
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    placed = rows.withColumn("_place", F.when(place == 0, F.lit(len(sources) + 1)).otherwise(place))
    order = ["_place", "source", F.char_length("id"), "id", "title"]
    return numbered(written(placed, "placed"), ["repo"], order, "ordinal").drop("_place")


def collect_evidence(files: DataFrame, outputs: DataFrame, observed: DataFrame, target: str, settings: Settings):
    """Discovery, scan coverage, API inventory and seed findings.

    ``outputs`` are tool documents (repo, tool, status, stdout), with ``run_id`` if a repository has several
    of one tool; ``observed`` says how the tools
    ended (repo, tool, outcome, exit_code).
    """
    names = source.excluded_names(settings.exclude, settings.output_directory)
    kept = source.exclude(files, names)
    if settings.max_files is not None:
        kept = source.cap(kept, settings.max_files).drop("truncated")
    evidence = scanners.collect(kept)
    inventory = save(scanners.api_inventory(evidence.endpoints), target, "api_inventory")
    profiles = save(
        discovery.profile(evidence.files, evidence.manifests, inventory), target, "discovery"
    )
    save(discovery.path_lists(evidence.files), target, "discovery_paths")
    limits = profiles.select(
        "repo",
        F.array(*[F.lit(t) for t in settings.disabled]).cast("array<string>").alias("disabled"),
        F.lit(settings.security).alias("security"),
        F.lit(settings.dependencies).alias("dependencies"),
        "package_managers",
        "dependency_files",
    )
    save(coverage.status_matrix(limits, observed), target, "scans")
    seeds = scanners.seed_findings(evidence, [as_findings(ingest.with_unique_ids(ingest.ingest_all(outputs)))])
    save(in_document_order(seeds), target, "seed_findings")


def review(spark: SparkSession, target: str, settings: Settings, reviewed: DataFrame | None = None):
    """Take reviewed findings where valid, else the seeds, and apply the confidence pass."""
    seeds = load(spark, target, "seed_findings")
    rows = seeds
    if reviewed is not None:
        rows = findings.with_fallback(findings.with_defaults(reviewed.select(seeds.columns)), seeds)
    save(findings.confidence_pass(rows, settings.minimum_confidence), target, "findings")


def write_reports(spark: SparkSession, target: str):
    rows, profiles = load(spark, target, "findings"), load(spark, target, "discovery")
    matrix = load(spark, target, "scans")
    tested = profiles.select("repo", (F.size("test_frameworks") > 0).alias("has_tests"))
    tests = profiles.select("repo", F.explode("test_frameworks").alias("label")).withColumn(
        "concern", F.lit("test_framework")
    )
    parts = [
        reports.technology_rows(profiles),
        reports.scan_rows(matrix),
        reports.gap_rows(findings.control_gaps(load(spark, target, "api_inventory"))),
        reports.posture_rows(findings.missing_tests(profiles, tests)),
        reports.limitation_rows(coverage.limitations(matrix, tested)),
    ]
    order = ["section_no", "part", "ordinal"]
    sinks.write_rows(reports.markdown_rows(profiles, rows, *parts), f"{target}/report_lines", order)
    sinks.write_rows(reports.json_documents(rows, profiles), f"{target}/report_json", ["chunk"])
    sinks.write_rows(reports.sarif_documents(rows, repos=profiles), f"{target}/report_sarif", ["chunk"])


def decide(spark: SparkSession, target: str, settings: Settings, open_issues: DataFrame):
    """Gate verdicts and issue changes."""
    rows, profiles = load(spark, target, "findings"), load(spark, target, "discovery")
    save(findings.gate_verdict(rows, settings.fail_on, profiles), target, "gate")
    save(findings.issue_mutations(profiles, rows, open_issues), target, "issue_mutations")
    save(findings.issue_rows(rows), target, "issue_rows")


def audit(files, outputs, observed, open_issues, target, settings=None, reviewed=None):
    """Run all stages. Results are the tables under ``target``."""
    settings = settings or Settings()
    spark = files.sparkSession
    collect_evidence(files, outputs, observed, target, settings)
    review(spark, target, settings, reviewed)
    write_reports(spark, target)
    decide(spark, target, settings, open_issues)
