"""Analytics over the findings table: validity, views, ranking, gates, rollups, issue sync."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import (
    any_of,
    explode_present,
    filled,
    is_active,
    severity_rank,
    text_or_empty,
)
from ..functions.schemas import FINDING_DEFAULTS
from ..functions.tables import written

ACTIVE = "status <> 'rejected'"


# --- validity ------------------------------------------------------------------------------------

def rules_broken() -> dict:
    """Condition under which a finding breaks each rule. An absent value breaks it too."""
    def lacks(test):
        return ~F.coalesce(test, F.lit(False))

    return {
        "id": lacks(F.col("id").rlike(V.FINDING_ID_PATTERN)),
        "title": lacks(F.char_length("title") > 0),
        "severity": lacks(F.col("severity").isin(V.SEVERITIES)),
        "category": lacks(F.col("category").isin(V.CATEGORIES)),
        "status": lacks(F.col("status").isin(V.STATUSES)),
        "confidence": lacks(F.col("confidence").between(0, 100)),
        "line": F.coalesce(F.col("line") <= 0, F.lit(False)),
    }


def violations(findings: DataFrame) -> DataFrame:
    codes = [F.when(broken, F.lit(code)) for code, broken in rules_broken().items()]
    return explode_present(findings, ["repo", "id", "ordinal"], codes, "violation")


def valid_files(findings: DataFrame) -> DataFrame:
    """Repositories with findings, and whether every one is valid: one bad row spoils the file."""
    bad = any_of(rules_broken().values())
    return findings.groupBy("repo").agg(
        (~F.bool_or(bad)).alias("valid"), F.count("*").alias("findings")
    )


def with_fallback(reviewed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Reviewed findings where a repository's file is valid as a whole, seed findings elsewhere.

    A task holds the names of its share of the valid repositories and streams the findings past them, so findings
    are neither sorted nor held, and the names are never whole in one place.
    """
    good = written(valid_files(reviewed).filter("valid").select("repo"), "valid").hint("shuffle_hash")
    return reviewed.join(good, "repo", "left_semi").unionByName(
        seeds.join(good, "repo", "left_anti")
    )


def with_defaults(findings: DataFrame) -> DataFrame:
    filling = {name: F.coalesce(name, F.lit(value)) for name, value in FINDING_DEFAULTS.items()}
    filling["reproduction"] = F.coalesce("reproduction", F.array().cast("array<string>"))
    return findings.withColumns(filling)


# --- report views --------------------------------------------------------------------------------

def finding_line() -> Column:
    """The one-line text of a finding used throughout the report."""
    where = F.when(
        filled(F.col("file")).isNotNull(),
        F.concat(
            F.lit(" — `"),
            "file",
            F.coalesce(F.concat(F.lit(":"), F.nullif("line", F.lit(0)).cast("string")), F.lit("")),
            F.lit("`"),
        ),
    )
    endpoint = F.concat(F.lit(" (`"), filled(F.col("endpoint")), F.lit("`)"))
    return F.concat(
        F.lit("- **["), F.upper("severity"), F.lit("] "), "id", F.lit("** "), "title",
        text_or_empty(endpoint), text_or_empty(where),
        F.lit(" · _"), "status", F.lit("_, confidence "), F.col("confidence").cast("string"), F.lit("%"),
    )


def of_every_repo(counts: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Counts per repository with a row of zeros for those of ``repos`` that have no findings."""
    if repos is None:
        return counts
    return repos.select("repo").distinct().join(counts, "repo", "left").fillna(0)


def active_rejected(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    counts = findings.groupBy("repo").agg(
        F.count("*").alias("total"),
        F.count_if(is_active(F.col("status"))).alias("active"),
        F.count_if(~is_active(F.col("status"))).alias("rejected"),
    )
    return of_every_repo(counts, repos)


def severity_counts(
    findings: DataFrame, where: Column | None = None, repos: DataFrame | None = None
) -> DataFrame:
    """One dense count column per severity."""
    counted = F.lit(True) if where is None else where
    counts = findings.groupBy("repo").agg(
        *[F.count_if(counted & (F.col("severity") == s)).alias(s) for s in V.SEVERITIES]
    )
    return of_every_repo(counts, repos)


def by_severity(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Active findings per severity; all five levels show, with zeros."""
    counts = severity_counts(findings, is_active(F.col("status")), repos)
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("findings"))
            for n, s in enumerate(V.SEVERITIES)
        ]
    )
    return counts.select("repo", F.explode(pairs).alias("p")).select("repo", "p.*")


def by_category(findings: DataFrame) -> DataFrame:
    return findings.filter(ACTIVE).groupBy("repo", "category").agg(F.count("*").alias("findings"))


def top_risks(findings: DataFrame, size: int = V.TOP_RISKS) -> DataFrame:
    """Worst active findings per repository: severity, then confidence, then document order.

    The limit on the row number lets Spark keep only ``size`` rows per repository on the map
    side, so a huge repository sends next to nothing to its window task.
    """
    worst = Window.partitionBy("repo").orderBy(
        severity_rank(F.col("severity")), F.col("confidence").desc(), "ordinal"
    )
    return (
        findings.filter(ACTIVE)
        .withColumn("place", F.row_number().over(worst))
        .filter(F.col("place") <= size)
    )


def remediation_order(findings: DataFrame) -> DataFrame:
    return top_risks(findings).select(
        "repo", "place", "id", "severity",
        F.coalesce(filled(F.col("recommended_fix")), "title").alias("action"),
    )


def control_text(control: Column) -> Column:
    return F.when(control.isNull(), F.lit("?")).when(control, F.lit("yes")).otherwise(F.lit("no"))


CONTROLS = ["auth_required", "authorization_checked", "rate_limited", "input_validated"]


def control_gaps(inventory: DataFrame) -> DataFrame:
    """Endpoints on which not all four controls are known to be in place."""
    complete = F.col(CONTROLS[0])
    for control in CONTROLS[1:]:
        complete = complete & F.col(control)
    return inventory.filter(~F.coalesce(complete, F.lit(False))).select(
        "repo", "file", "line", "pos",
        F.concat_ws(" ", "method", "path").alias("endpoint"),
        *[control_text(F.col(c)).alias(c) for c in CONTROLS],
        F.when(F.col("sensitive"), F.lit("yes")).otherwise(F.lit("no")).alias("sensitive"),
    )


def endpoint_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(ACTIVE).filter(
        filled(F.col("endpoint")).isNotNull() & F.col("category").isin(V.ENDPOINT_CATEGORIES)
    )


def in_category(findings: DataFrame, *categories: str) -> DataFrame:
    return findings.filter(ACTIVE).filter(F.col("category").isin(*categories))


def manual_items(findings: DataFrame) -> DataFrame:
    return findings.filter("status = 'manual-verification'")


def rejected_items(findings: DataFrame) -> DataFrame:
    return findings.filter("status = 'rejected'").withColumn(
        "reason", F.coalesce(filled(F.col("description")), F.lit("rejected"))
    )


def missing_tests(repos: DataFrame, facts: DataFrame) -> DataFrame:
    """Test posture of every repository. The frameworks of one form a short fixed vocabulary."""
    tools = (
        facts.filter("concern = 'test_framework'")
        .groupBy("repo")
        .agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("tools"))
    )
    text = F.when(F.col("tools").isNull(), F.lit(V.NO_TESTS_TEXT)).otherwise(
        F.concat(F.lit(V.TESTS_TEXT_HEAD), "tools", F.lit(V.TESTS_TEXT_TAIL))
    )
    return (
        repos.select("repo").distinct().join(tools, "repo", "left").select(
            "repo", F.col("tools").isNotNull().alias("has_tests"), text.alias("posture")
        )
    )


# --- gates and passes ------------------------------------------------------------------------------

def parse_threshold(threshold: str) -> str:
    known = threshold.lower()
    if known not in [*V.SEVERITIES, "none"]:
        raise ValueError(
            f"unknown failure threshold {threshold!r}; use one of {', '.join([*V.SEVERITIES, 'none'])}"
        )
    return known


def blocks(threshold: str) -> Column:
    """True for active findings at or above the threshold; never for ``none``."""
    known = parse_threshold(threshold)
    if known == "none":
        return F.lit(False)
    at_or_above = V.SEVERITIES[: V.SEVERITIES.index(known) + 1]
    return is_active(F.col("status")) & F.col("severity").isin(at_or_above)


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.filter(blocks(threshold))


def gate_verdict(findings: DataFrame, threshold: str, repos: DataFrame | None = None) -> DataFrame:
    """Blocking findings and the verdict; a repository of ``repos`` without findings passes."""
    counts = findings.groupBy("repo").agg(F.count_if(blocks(threshold)).alias("blocking"))
    return of_every_repo(counts, repos).withColumn("failed", F.col("blocking") > 0)


def confidence_pass(findings: DataFrame, minimum: int = V.MINIMUM_CONFIDENCE) -> DataFrame:
    """Potential findings below the minimum confidence go to manual verification."""
    weak = (F.col("status") == "potential") & (F.col("confidence") < minimum)
    return findings.withColumn("reclassified", weak).withColumn(
        "status", F.when(weak, F.lit("manual-verification")).otherwise(F.col("status"))
    )


def status_counts(
    findings: DataFrame, minimum: int = V.MINIMUM_CONFIDENCE, repos: DataFrame | None = None
) -> DataFrame:
    passed = confidence_pass(findings, minimum)
    counts = passed.groupBy("repo").agg(
        *[
            F.count_if(F.col("status") == s).alias(s.replace("-", "_"))
            for s in V.STATUSES
        ],
        F.count_if("reclassified").alias("reclassified"),
    )
    return of_every_repo(counts, repos)


# --- fleet rollup ----------------------------------------------------------------------------------

def portfolio_rollup(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity counts, rejected findings included, for every repository of the portfolio.

    ``repos`` has repo and category. A repository without findings counts as zeros.
    """
    counts = severity_counts(findings)
    dense = [F.coalesce(s, F.lit(0)).alias(s) for s in V.SEVERITIES]
    return repos.join(counts, "repo", "left").select(*repos.columns, *dense).withColumn(
        "findings", F.concat_ws("/", *[F.col(s).cast("string") for s in V.SEVERITIES])
    )


def portfolio_totals(rollup: DataFrame, *levels: str) -> DataFrame:
    """Totals per level, per prefix of the levels, and for the whole fleet (NULL levels)."""
    return rollup.rollup(*levels).agg(
        F.count("*").alias("repos"), *[F.sum(s).alias(s) for s in V.SEVERITIES]
    )


def critical_repos(repos: DataFrame, findings: DataFrame) -> DataFrame:
    critical = findings.filter("severity = 'critical'").select("repo").distinct()
    return repos.join(critical, "repo", "left_semi")


def audit_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Critical and high counts of two snapshots side by side, with the verdict of the change."""
    def side(snapshot, prefix):
        return snapshot.groupBy("repo").agg(
            F.count_if(F.col("severity") == "critical").alias(f"{prefix}_critical"),
            F.count_if(F.col("severity") == "high").alias(f"{prefix}_high"),
        )

    def shown(prefix):
        return F.concat_ws(
            "/",
            *[
                F.coalesce(F.col(f"{prefix}_{s}").cast("string"), F.lit("?"))
                for s in ("critical", "high")
            ],
        )

    left, was = F.col("after_critical"), F.col("before_critical")
    # An unknown count compares as "not zero", so it neither clears nor confirms anything.
    verdict = (
        F.when((left == 0) & ~F.coalesce(was == 0, F.lit(False)), F.lit(V.DELTA_CLEARED))
        .when(left == 0, F.lit(V.DELTA_APPLIED))
        .otherwise(
            F.concat(F.coalesce(left.cast("string"), F.lit("?")), F.lit(V.DELTA_REMAIN))
        )
    )
    return (
        side(before, "before")
        .join(side(after, "after"), "repo", "full_outer")
        .select("repo", shown("before").alias("before"), shown("after").alias("after"), verdict.alias("result"))
    )


# --- issue sync ------------------------------------------------------------------------------------

def qualifying(findings: DataFrame) -> DataFrame:
    return findings.filter(ACTIVE).filter(F.col("severity").isin("critical", "high"))


def table_cell(text: Column) -> Column:
    one_line = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.replace(one_line, F.lit("|"), F.lit("\\|"))


def issue_rows(findings: DataFrame) -> DataFrame:
    """Rows of the issue table. Evidence is left out, so no secret value can reach an issue."""
    place = F.coalesce(
        F.concat(
            filled(F.col("file")),
            F.coalesce(F.concat(F.lit(":"), F.nullif("line", F.lit(0)).cast("string")), F.lit("")),
        ),
        F.lit(V.REPOSITORY_WIDE),
    )
    return qualifying(findings).select(
        "repo", "ordinal", "severity",
        table_cell(F.col("id")).alias("id"),
        table_cell(F.col("title")).alias("title"),
        table_cell(place).alias("location"),
    )


def mutation(active: Column, is_open: Column) -> Column:
    return (
        F.when(active & is_open, F.lit("update"))
        .when(active, F.lit("create"))
        .when(is_open, F.lit("close"))
        .otherwise(F.lit("noop"))
    )


def issue_mutations(repos: DataFrame, findings: DataFrame, open_issues: DataFrame) -> DataFrame:
    """What to do with each repository's issue. ``open_issues`` has (repo, issue_number)."""
    active = qualifying(findings).groupBy("repo").agg(F.count("*").alias("active"))
    known = repos.select("repo").unionByName(open_issues.select("repo")).distinct()
    return (
        known.join(active, "repo", "left")
        .join(open_issues, "repo", "left")
        .select(
            "repo",
            F.coalesce("active", F.lit(0)).alias("active"),
            "issue_number",
            mutation(F.col("active").isNotNull(), F.col("issue_number").isNotNull()).alias("mutation"),
        )
    )


PLAN_LINES = [
    "Plan for %s: %s",
    "Severity %s, category %s, status %s",
    "Where: %s:%s %s",
    "Confirm: %s",
    "Fix: %s",
]


def remediation_plans(findings: DataFrame, requested: DataFrame) -> DataFrame:
    """Plan text of every requested (repo, id). Plans never change a file."""
    def given(name, missing):
        return F.coalesce(filled(F.col(name)), F.lit(missing))

    endpoint = text_or_empty(F.concat(F.lit("("), filled(F.col("endpoint")), F.lit(")")))
    plan = F.format_string(
        "\n".join(PLAN_LINES),
        "id", "title", "severity", "category", "status",
        F.coalesce("file", F.lit(V.NO_FILE)),
        F.coalesce(F.nullif("line", F.lit(0)).cast("string"), F.lit(V.NO_LINE)),
        endpoint,
        given("trigger_condition", V.NO_TRIGGER),
        given("recommended_fix", V.NO_FIX),
    )
    return findings.join(requested.select("repo", "id").distinct(), ["repo", "id"], "left_semi").select(
        "repo", "id", plan.alias("plan")
    )


def collapse_duplicates(findings: DataFrame) -> DataFrame:
    """One finding per (repo, file, line, category): the most severe, then most confident.

    An aggregate rather than a window, so copies are reduced before the shuffle and a location
    reported any number of times costs one row per map task. The sources seen are kept.
    """
    best = F.struct(
        severity_rank(F.col("severity")).alias("rank"),
        (-F.col("confidence")).alias("order"),
        F.col("ordinal"),
    )
    kept = ["id", "title", "severity", "confidence", "ordinal"]
    return (
        findings.filter(ACTIVE)
        .groupBy("repo", "file", "line", "category")
        .agg(
            F.min_by(F.struct(*kept), best).alias("f"),
            F.sort_array(F.collect_set("source")).alias("sources"),
            F.count("*").alias("copies"),
        )
        .select("repo", "file", "line", "category", "f.*", "sources", "copies")
    )
