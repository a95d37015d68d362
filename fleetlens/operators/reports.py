"""Report content as rows and chunks, never as one value per repository.

A report grows with its repository, so it is kept as ordered rows (Markdown, SARIF results) or
as JSON chunks of a bounded number of findings. Putting a report together is concatenating its
rows in order, which the sinks do file by file.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import explode_present, filled, is_active, sarif_level, severity_rank
from ..functions.tables import numbered
from .findings import ACTIVE, active_rejected, finding_line, remediation_order, severity_counts, top_risks

CHUNK_FINDINGS = 1_000
SECTION_NO = {title: n for n, title in enumerate(V.REPORT_SECTIONS, start=1)}


# --- SARIF ---------------------------------------------------------------------------------------

def sarif_results(findings: DataFrame) -> DataFrame:
    """One rule and one result per active finding, flat. NULL columns are absent properties."""
    impact = F.concat(F.lit("Impact: "), filled(F.col("impact")))
    fix = F.concat(F.lit("Fix: "), filled(F.col("recommended_fix")))
    return findings.filter(ACTIVE).select(
        "repo",
        "ordinal",
        F.col("id").alias("rule_id"),
        F.col("category").alias("rule_name"),
        F.coalesce(filled(F.col("description")), "title").alias("full_description"),
        sarif_level(F.col("severity")).alias("level"),
        F.concat_ws(" ", filled(F.col("title")), impact, fix).alias("message"),
        "status",
        "confidence",
        "endpoint",
        "source",
        F.coalesce("file", F.lit(".")).alias("uri"),
        F.nullif("line", F.lit(0)).alias("start_line"),
        "severity",
        "title",
    )


def sarif_level_counts(findings: DataFrame) -> DataFrame:
    return sarif_results(findings).groupBy("repo", "level").agg(F.count("*").alias("results"))


def sarif_documents(
    findings: DataFrame, tool: str = "fleetlens", version: str = "0.1.0", repos: DataFrame | None = None
) -> DataFrame:
    """SARIF 2.1.0 texts (repo, chunk, chunks, text); each chunk is a whole document of its findings.

    ``automationDetails.id`` is repository/chunk/chunks in every document. A repository of
    ``repos`` without active findings has one document without results.
    """
    rows = _chunked(sarif_results(findings))
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.struct("level").alias("defaultConfiguration"),
        F.struct(F.col("rule_name").alias("category"), "severity").alias("properties"),
    )
    region = F.when(
        F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"))
    )
    place = F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct("status", "confidence", "endpoint", "source").alias("properties"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
    )
    packed = F.sort_array(F.collect_list(F.struct("n", rule.alias("rule"), result.alias("result"))))
    chunks = _with_chunks(rows, rows.groupBy("repo", "chunk").agg(packed.alias("items")), repos)
    driver = F.struct(
        F.lit(tool).alias("name"),
        F.lit(version).alias("version"),
        F.transform("items", lambda x: x["rule"]).alias("rules"),
    )
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.struct(F.concat_ws("/", "repo", "chunk", "chunks").alias("id")).alias("automationDetails"),
        F.transform("items", lambda x: x["result"]).alias("results"),
    )
    document = F.struct(
        F.lit(V.SARIF_SCHEMA).alias("$schema"),
        F.lit("2.1.0").alias("version"),
        F.array(run).alias("runs"),
    )
    return chunks.select("repo", "chunk", "chunks", F.to_json(document).alias("text"))


# --- JSON ----------------------------------------------------------------------------------------

def _chunked(rows: DataFrame) -> DataFrame:
    """Number each repository's rows in document order and cut them into bounded chunks."""
    return numbered(rows, ["repo"], ["ordinal"]).withColumn(
        "chunk", F.floor((F.col("n") - 1) / CHUNK_FINDINGS)
    )


def _with_chunks(rows: DataFrame, packed: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Packed chunks with the number of chunks of their repository; with ``repos``, at least one for each."""
    counts = rows.groupBy("repo").agg((F.max("chunk") + 1).alias("chunks"))
    if repos is None:
        return packed.join(counts, "repo")
    kind = packed.schema["items"].dataType
    return (
        repos.select("repo").distinct()
        .join(counts, "repo", "left")
        .join(packed, "repo", "left")
        .select(
            "repo",
            F.coalesce("chunk", F.lit(0)).alias("chunk"),
            F.coalesce("chunks", F.lit(1)).alias("chunks"),
            F.coalesce("items", F.array().cast(kind)).alias("items"),
        )
    )


JSON_FIELDS = [
    "id", "title", "severity", "category", "status", "confidence", "file", "line", "endpoint",
    "description", "evidence", "impact", "trigger_condition", "reproduction", "recommended_fix", "source",
]


def json_documents(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Findings of a repository as JSON texts (repo, chunk, chunks, text). Absent values stay as null.

    A repository of ``repos`` without findings has one text with an empty list.
    """
    packed = F.sort_array(F.collect_list(F.struct("n", F.struct(*JSON_FIELDS).alias("finding"))))
    rows = _chunked(findings)
    chunks = _with_chunks(rows, rows.groupBy("repo", "chunk").agg(packed.alias("items")), repos)
    document = F.struct(
        F.col("repo").alias("repository"),
        "chunk",
        "chunks",
        F.transform("items", lambda x: x["finding"]).alias("findings"),
    )
    return chunks.select(
        "repo", "chunk", "chunks", F.to_json(document, {"ignoreNullFields": "false"}).alias("text")
    )


# --- Markdown --------------------------------------------------------------------------------------

def finding_rows(findings: DataFrame) -> DataFrame:
    """One row per finding and report section it shows in: (repo, section_no, part, ordinal, text).

    ``part`` orders the blocks inside a section: the severity rank, or the category's position.
    """
    line = finding_line()
    active = is_active(F.col("status"))
    rank = severity_rank(F.col("severity")).cast("int")
    category_no = F.array_position(F.array(*[F.lit(c) for c in V.CATEGORIES]), F.col("category")).cast("int")

    def row(section, when, part, text):
        return F.when(
            when,
            F.struct(
                F.lit(SECTION_NO[section]).alias("section_no"), part.alias("part"), text.alias("text")
            ),
        )

    zero = F.lit(0)
    reason = F.coalesce(filled(F.col("description")), F.lit("rejected"))
    shown = [
        row("Findings by Severity", active, rank, line),
        row("Findings by Category", active, category_no, line),
        row("Rate-Limiting Findings", active & (F.col("category") == "rate-limiting"), zero, line),
        row("Dependency Findings", active & (F.col("category") == "dependency"), zero, line),
        row("Configuration Findings", active & (F.col("category") == "configuration"), zero, line),
        row("Manual Verification Items", F.col("status") == "manual-verification", zero, line),
        row(
            "Rejected Scanner Findings", ~active, zero,
            F.concat(F.lit("- **"), "id", F.lit("** "), "title", F.lit(" — "), reason),
        ),
    ]
    body = explode_present(findings, ["repo", "ordinal"], shown, "r").select(
        "repo", "r.section_no", "r.part", F.col("ordinal").cast("long").alias("ordinal"), "r.text"
    )
    place = F.concat(F.col("place").cast("string"), F.lit(". "))
    top = top_risks(findings).select(
        "repo",
        F.lit(SECTION_NO["Top Five Risks"]).alias("section_no"),
        F.lit(0).alias("part"),
        F.col("place").cast("long").alias("ordinal"),
        F.concat(place, F.substr(line, F.lit(3))).alias("text"),
    )
    order = remediation_order(findings).select(
        "repo",
        F.lit(SECTION_NO["Recommended Remediation Order"]).alias("section_no"),
        F.lit(0).alias("part"),
        F.col("place").cast("long").alias("ordinal"),
        F.concat(place, F.lit("**"), "id", F.lit("** ("), "severity", F.lit(") — "), "action").alias("text"),
    )
    return reduce(DataFrame.unionByName, [body, top, order])


def heading_rows(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Summary line and the per-severity headings with their counts, zeros included."""
    counts = severity_counts(findings, is_active(F.col("status")), repos).join(
        active_rejected(findings, repos), "repo"
    )
    summary = F.format_string(
        "- **Total findings:** %d (%d active, %d rejected)",
        F.col("total"), F.col("active"), F.col("total") - F.col("active"),
    )

    def row(section, part, text):
        return F.struct(
            F.lit(SECTION_NO[section]).alias("section_no"),
            F.lit(part).alias("part"),
            text.alias("text"),
        )

    def heading(rank, severity):
        empty = F.when(F.col(severity) == 0, F.lit("\n\n_None._")).otherwise(F.lit(""))
        text = F.concat(
            F.lit(f"### {severity} ("), F.col(severity).cast("string"), F.lit(")"), empty
        )
        return row("Findings by Severity", rank, text)

    rows = F.array(
        row("Repository Summary", 0, summary),
        *[heading(rank, severity) for rank, severity in enumerate(V.SEVERITIES)],
    )
    return counts.select("repo", F.explode(rows).alias("r")).select(
        "repo", "r.section_no", "r.part", F.lit(-1).cast("long").alias("ordinal"), "r.text"
    )


def section_rows(repos: DataFrame) -> DataFrame:
    """The fifteen section titles of every report."""
    titles = F.array(
        *[
            F.struct(F.lit(n).alias("section_no"), F.lit(f"## {title}").alias("text"))
            for title, n in SECTION_NO.items()
        ]
    )
    return repos.select("repo").distinct().select("repo", F.explode(titles).alias("r")).select(
        "repo", "r.section_no", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("ordinal"), "r.text"
    )


def technology_rows(profiles: DataFrame) -> DataFrame:
    """Repository and technology summary lines from the discovery profile."""
    def listed(column):
        return F.coalesce(filled(F.array_join(column, ", ")), F.lit("none detected"))

    def row(section, place, label, value):
        return F.struct(
            F.lit(SECTION_NO[section]).alias("section_no"),
            F.lit(place).cast("long").alias("ordinal"),
            F.concat(F.lit(f"- **{label}:** "), value).alias("text"),
        )

    def count(name):
        return F.col(name).cast("string")

    rows = F.array(
        row("Repository Summary", 0, "Files scanned", count("file_count")),
        row("Repository Summary", 1, "Languages", listed("languages")),
        row("Repository Summary", 2, "Package managers", listed("package_managers")),
        row("Repository Summary", 3, "API endpoints discovered", count("api_endpoints")),
        row("Technology Summary", 0, "Frameworks", listed("frameworks")),
        row("Technology Summary", 1, "API frameworks", listed("api_frameworks")),
        row("Technology Summary", 2, "Databases", listed("databases")),
        row("Technology Summary", 3, "Integrations", listed("integrations")),
        row("Technology Summary", 4, "Test frameworks", listed("test_frameworks")),
        row("Technology Summary", 5, "CI workflows", count("ci_workflows")),
        row("Technology Summary", 6, "Infra files", count("infra_files")),
        row("Technology Summary", 7, "Config files", count("config_files")),
    )
    return profiles.select("repo", F.explode(rows).alias("r")).select(
        "repo", "r.section_no", F.lit(0).alias("part"), "r.ordinal", "r.text"
    )


def scan_rows(matrix: DataFrame) -> DataFrame:
    text = F.concat_ws(
        " | ", "tool", "status",
        F.coalesce(F.col("exit_code").cast("string"), F.lit("—")),
        F.substring(F.replace("note", F.lit("|"), F.lit("\\|")), 1, 80),
    )
    return matrix.select(
        "repo",
        F.lit(SECTION_NO["Scanner Execution Summary"]).alias("section_no"),
        F.lit(0).alias("part"),
        F.col("tool_order").cast("long").alias("ordinal"),
        F.concat(F.lit("| "), text, F.lit(" |")).alias("text"),
    )


def gap_rows(gaps: DataFrame) -> DataFrame:
    cells = F.concat_ws(
        " | ",
        F.concat(F.lit("`"), "endpoint", F.lit("`")),
        "auth_required", "authorization_checked", "rate_limited", "input_validated", "sensitive",
    )
    # In the order of the files and of the calls within them.
    return numbered(gaps, ["repo"], ["file", "line", "pos"], "ordinal").select(
        "repo",
        F.lit(SECTION_NO["API Endpoints With Missing Controls"]).alias("section_no"),
        F.lit(0).alias("part"),
        "ordinal",
        F.concat(F.lit("| "), cells, F.lit(" |")).alias("text"),
    )


def posture_rows(postures: DataFrame) -> DataFrame:
    return postures.select(
        "repo",
        F.lit(SECTION_NO["Missing Test Coverage"]).alias("section_no"),
        F.lit(0).alias("part"),
        F.lit(0).cast("long").alias("ordinal"),
        F.col("posture").alias("text"),
    )


def limitation_rows(limitations: DataFrame) -> DataFrame:
    return limitations.select(
        "repo",
        F.lit(SECTION_NO["Limitations of This Audit"]).alias("section_no"),
        F.lit(0).alias("part"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.concat(F.lit("- "), "limitation").alias("text"),
    )


def markdown_rows(repos: DataFrame, findings: DataFrame, *parts: DataFrame) -> DataFrame:
    """All rows of all reports; ``parts`` are further row tables such as ``technology_rows``."""
    return reduce(
        DataFrame.unionByName,
        [section_rows(repos), heading_rows(findings, repos), finding_rows(findings), *parts],
    )
