"""Queries on findings, reports and sinks."""

from functools import partial

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.tables import fresh_path
from ..operators import findings as ops
from ..operators import reports, scanners
from ..sources import rule_catalog, sinks
from . import views
from .registry import query, with_views

found = partial(with_views, views.FINDINGS_SQL)
reviewed = partial(with_views, views.REVIEWED_SQL)
ACTIVE = "status <> 'rejected'"
LINE_SQL = """'- **[' || upper(severity) || '] ' || id || '** ' || title
  || CASE WHEN endpoint IS NOT NULL THEN ' (`' || endpoint || '`)' ELSE '' END
  || CASE WHEN file IS NOT NULL THEN ' — `' || file || coalesce(':' || line, '') || '`' ELSE '' END
  || ' · _' || status || '_, confidence ' || confidence || '%'"""


def sql_counts(where="true"):
    return ", ".join(f"count(*) FILTER (severity = '{s}' AND {where}) AS {s}" for s in V.SEVERITIES)


# --- validity -----------------------------------------------------------------------------------------

BROKEN = [(97, "id"), (89, "severity"), (83, "status"), (79, "confidence"), (73, "title"), (71, "line")]


@query(
    "finding_violations",
    reviewed(
        select=" UNION ALL ".join(
            f"SELECT repo, id, ordinal, '{code}' AS violation FROM reviewed WHERE ordinal % {n} = 0"
            for n, code in BROKEN
        )
    ),
)
def finding_violations(spark, folder):
    return ops.violations(views.reviewed_findings(spark, folder))


@query(
    "findings_file_valid",
    reviewed(select="SELECT repo, NOT bool_or(broken) AS valid, count(*) AS findings FROM reviewed GROUP BY repo"),
)
def findings_file_valid(spark, folder):
    return ops.valid_files(views.reviewed_findings(spark, folder))


@query(
    "finding_defaults",
    """SELECT 'repo_' || o_custkey AS repo, o_orderkey AS ordinal,
      CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'text' END AS description, '' AS evidence,
      CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'tool:x' END AS source, '' AS impact,
      '' AS trigger_condition, '' AS recommended_fix, CAST(0 AS BIGINT) AS steps FROM orders""",
)
def finding_defaults(spark, folder):
    k = F.col("ordinal")
    none = F.lit(None).cast("string")
    sparse = views.findings(spark, folder).select(
        "repo", "ordinal",
        F.when(k % 2 != 0, F.lit("text")).alias("description"),
        none.alias("evidence"), none.alias("impact"), none.alias("trigger_condition"),
        none.alias("recommended_fix"),
        F.when(k % 3 != 0, F.lit("tool:x")).alias("source"),
        F.lit(None).cast("array<string>").alias("reproduction"),
    )
    return ops.with_defaults(sparse).withColumn(
        "steps", F.size("reproduction").cast("long")
    ).drop("reproduction")


@query(
    "findings_fallback",
    reviewed(
        select="""SELECT repo, ordinal, id, title, origin FROM (
          SELECT *, 'reviewed' AS origin FROM reviewed WHERE repo NOT IN (SELECT repo FROM reviewed WHERE broken)
          UNION ALL SELECT *, false, 'seed' FROM findings WHERE repo IN (SELECT repo FROM reviewed WHERE broken))"""
    ),
)
def findings_fallback(spark, folder):
    tagged = [
        rows.withColumn("origin", F.lit(origin))
        for rows, origin in [
            (views.reviewed_findings(spark, folder), "reviewed"),
            (views.findings(spark, folder), "seed"),
        ]
    ]
    return ops.with_fallback(*tagged).select("repo", "ordinal", "id", "title", "origin")


# --- report views -------------------------------------------------------------------------------------

# Every repository, with its findings if it has any.
EVERY_REPO = "(SELECT 'repo_' || c_custkey AS repo FROM customer) LEFT JOIN findings USING (repo)"


def every_repo(spark, folder):
    return views.table(spark, folder, "customer").selectExpr("concat('repo_', c_custkey) AS repo")


@query(
    "active_rejected",
    found(
        select=f"""SELECT repo, count(id) AS total, count(*) FILTER ({ACTIVE}) AS active,
          count(*) FILTER (NOT ({ACTIVE})) AS rejected FROM {EVERY_REPO} GROUP BY ALL"""
    ),
)
def active_rejected(spark, folder):
    return ops.active_rejected(views.findings(spark, folder), every_repo(spark, folder))


@query(
    "by_severity",
    found(
        select=f"""SELECT r.repo, CAST(s.rank AS INTEGER) AS rank, s.severity,
          count(*) FILTER (f.severity = s.severity AND {ACTIVE}) AS findings
        FROM (SELECT 'repo_' || c_custkey AS repo FROM customer) r
          CROSS JOIN (VALUES {", ".join(f"({n}, '{s}')" for n, s in enumerate(V.SEVERITIES))}) s(rank, severity)
          LEFT JOIN findings f ON f.repo = r.repo GROUP BY ALL"""
    ),
)
def by_severity(spark, folder):
    return ops.by_severity(views.findings(spark, folder), every_repo(spark, folder))


@query("by_category", found(select=f"SELECT repo, category, count(*) AS findings FROM findings WHERE {ACTIVE} GROUP BY ALL"))
def by_category(spark, folder):
    return ops.by_category(views.findings(spark, folder))


TOP_SQL = f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY repo ORDER BY rank, confidence DESC, ordinal) AS place FROM findings WHERE {ACTIVE}) WHERE place <= 5)"""
top = partial(with_views, views.FINDINGS_SQL, TOP_SQL)


@query("top_risks", top(select="SELECT repo, CAST(place AS INTEGER) AS place, id, severity, confidence, title FROM top"))
def top_risks(spark, folder):
    return ops.top_risks(views.findings(spark, folder)).select(
        "repo", "place", "id", "severity", "confidence", "title"
    )


@query(
    "remediation_order",
    top(
        select="""SELECT repo, CAST(place AS INTEGER) AS place, id, severity,
          CASE WHEN recommended_fix = '' THEN title ELSE recommended_fix END AS action FROM top"""
    ),
)
def remediation_order(spark, folder):
    return ops.remediation_order(views.findings(spark, folder))


@query(
    "endpoint_findings",
    found(select=f"SELECT repo, ordinal, endpoint, title, severity, status FROM findings WHERE {ACTIVE} AND endpoint IS NOT NULL"),
)
def endpoint_findings(spark, folder):
    return ops.endpoint_findings(views.findings(spark, folder)).select(
        "repo", "ordinal", "endpoint", "title", "severity", "status"
    )


@query(
    "category_section",
    found(
        select=f"""SELECT repo, ordinal, category, {LINE_SQL} AS text FROM findings
          WHERE {ACTIVE} AND category IN ('rate-limiting', 'dependency', 'configuration')"""
    ),
)
def category_section(spark, folder):
    chosen = ops.in_category(
        views.findings(spark, folder), "rate-limiting", "dependency", "configuration"
    )
    return chosen.select("repo", "ordinal", "category", ops.finding_line().alias("text"))


@query(
    "manual_items",
    found(select=f"SELECT repo, ordinal, {LINE_SQL} AS text FROM findings WHERE status = 'manual-verification'"),
)
def manual_items(spark, folder):
    return ops.manual_items(views.findings(spark, folder)).select(
        "repo", "ordinal", ops.finding_line().alias("text")
    )


@query(
    "rejected_items",
    found(
        select="""SELECT repo, id, title, CASE WHEN description = '' THEN 'rejected' ELSE description END AS reason
          FROM findings WHERE status = 'rejected'"""
    ),
)
def rejected_items(spark, folder):
    return ops.rejected_items(views.findings(spark, folder)).select("repo", "id", "title", "reason")


# --- gates and passes ---------------------------------------------------------------------------------

@query(
    "severity_gate",
    found(select=f"SELECT repo, id, severity FROM findings WHERE {ACTIVE} AND severity IN ('critical', 'high')"),
)
def severity_gate(spark, folder):
    return ops.at_or_above(views.findings(spark, folder), "high").select("repo", "id", "severity")


@query(
    "gate_verdict",
    found(
        select=f"""SELECT repo, count(*) FILTER ({ACTIVE} AND rank <= 2) AS blocking,
          count(*) FILTER ({ACTIVE} AND rank <= 2) > 0 AS failed FROM {EVERY_REPO} GROUP BY ALL"""
    ),
)
def gate_verdict(spark, folder):
    return ops.gate_verdict(views.findings(spark, folder), "medium", every_repo(spark, folder))


PASS_SQL = f"""passed AS (SELECT * REPLACE (CASE WHEN status = 'potential' AND confidence < {V.MINIMUM_CONFIDENCE}
    THEN 'manual-verification' ELSE status END AS status),
    (status = 'potential' AND confidence < {V.MINIMUM_CONFIDENCE}) AS reclassified FROM findings)"""


@query(
    "confidence_pass",
    with_views(views.FINDINGS_SQL, PASS_SQL, select="SELECT repo, id, confidence, status, reclassified FROM passed"),
)
def confidence_pass(spark, folder):
    return ops.confidence_pass(views.findings(spark, folder)).select(
        "repo", "id", "confidence", "status", "reclassified"
    )


@query(
    "status_counts",
    with_views(
        views.FINDINGS_SQL, PASS_SQL,
        select="SELECT repo, "
        + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.replace('-', '_')}" for s in V.STATUSES)
        + ", count(*) FILTER (reclassified) AS reclassified FROM "
        + "(SELECT 'repo_' || c_custkey AS repo FROM customer) LEFT JOIN passed USING (repo) GROUP BY repo",
    ),
)
def status_counts(spark, folder):
    return ops.status_counts(views.findings(spark, folder), repos=every_repo(spark, folder))


@query("severity_counts", found(select=f"SELECT repo, {sql_counts(ACTIVE)} FROM {EVERY_REPO} GROUP BY ALL"))
def severity_counts(spark, folder):
    rows = views.findings(spark, folder)
    return ops.severity_counts(rows, F.col("status") != "rejected", every_repo(spark, folder))


# --- fleet rollup -------------------------------------------------------------------------------------

ROLLUP_SQL = f"""repos AS (SELECT 'repo_' || c_custkey AS repo, c_mktsegment AS category, c_nationkey AS nation FROM customer),
counts AS (SELECT repo, {sql_counts()} FROM findings GROUP BY repo),
rollup_rows AS (SELECT repos.repo, category, nation, {", ".join(f"coalesce({s}, 0) AS {s}" for s in V.SEVERITIES)}
  FROM repos LEFT JOIN counts ON repos.repo = counts.repo)"""
portfolio = partial(with_views, views.FINDINGS_SQL, ROLLUP_SQL)


@query(
    "portfolio_rollup",
    portfolio(
        select="SELECT repo, category, " + " || '/' || ".join(V.SEVERITIES) + " AS findings FROM rollup_rows"
    ),
)
def portfolio_rollup(spark, folder):
    return ops.portfolio_rollup(
        views.repositories(spark, folder), views.findings(spark, folder)
    ).select("repo", "category", "findings")


@query(
    "portfolio_totals",
    portfolio(
        select="SELECT r_name AS region, category, count(*) AS repos, "
        + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in V.SEVERITIES)
        + """ FROM rollup_rows JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey
          GROUP BY ROLLUP (r_name, category)""",
    ),
)
def portfolio_totals(spark, folder):
    regions = (
        views.table(spark, folder, "nation")
        .join(views.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    )
    rollup = ops.portfolio_rollup(
        views.repositories(spark, folder), views.findings(spark, folder)
    ).join(regions, "nation")
    return ops.portfolio_totals(rollup, "region", "category")


@query(
    "critical_repos",
    portfolio(select="SELECT repo, category FROM rollup_rows WHERE critical > 0"),
)
def critical_repos(spark, folder):
    return ops.critical_repos(
        views.repositories(spark, folder), views.findings(spark, folder)
    ).select("repo", "category")


@query(
    "audit_delta",
    found(
        select=f"""SELECT coalesce(b.repo, a.repo) AS repo,
          coalesce(CAST(b.critical AS VARCHAR), '?') || '/' || coalesce(CAST(b.high AS VARCHAR), '?') AS before,
          coalesce(CAST(a.critical AS VARCHAR), '?') || '/' || coalesce(CAST(a.high AS VARCHAR), '?') AS after,
          CASE WHEN a.critical = 0 AND b.critical = 0 THEN '{V.DELTA_APPLIED}' WHEN a.critical = 0 THEN '{V.DELTA_CLEARED}'
            ELSE coalesce(CAST(a.critical AS VARCHAR), '?') || '{V.DELTA_REMAIN}' END AS result
        FROM (SELECT repo, {sql_counts()} FROM findings WHERE ordinal % 2 = 0 GROUP BY repo) b
        FULL JOIN (SELECT repo, {sql_counts()} FROM findings WHERE ordinal % 2 = 1 GROUP BY repo) a ON a.repo = b.repo"""
    ),
)
def audit_delta(spark, folder):
    """Even orders stand for the audit before an update, odd ones for the audit after it."""
    rows = views.findings(spark, folder)
    return ops.audit_delta(rows.filter("ordinal % 2 = 0"), rows.filter("ordinal % 2 = 1"))


# --- issue sync ---------------------------------------------------------------------------------------

QUALIFIES = f"{ACTIVE} AND severity IN ('critical', 'high')"


@query("qualifying_findings", found(select=f"SELECT repo, id, severity, status FROM findings WHERE {QUALIFIES}"))
def qualifying_findings(spark, folder):
    return ops.qualifying(views.findings(spark, folder)).select("repo", "id", "severity", "status")


@query(
    "issue_rows",
    found(
        select=f"""SELECT repo, ordinal, severity, id, replace(replace(title, chr(10), ' '), '|', '\\|') AS title,
          CASE WHEN file IS NULL THEN '{V.REPOSITORY_WIDE}' ELSE file || coalesce(':' || line, '') END AS location
        FROM findings WHERE {QUALIFIES}"""
    ),
)
def issue_rows(spark, folder):
    return ops.issue_rows(views.findings(spark, folder))


@query(
    "issue_mutations",
    portfolio(
        select=f"""SELECT r.repo, coalesce(q.active, 0) AS active, i.issue_number,
          CASE WHEN q.active > 0 AND i.issue_number IS NOT NULL THEN 'update' WHEN q.active > 0 THEN 'create'
            WHEN i.issue_number IS NOT NULL THEN 'close' ELSE 'noop' END AS mutation
        FROM rollup_rows r LEFT JOIN (SELECT repo, count(*) AS active FROM findings WHERE {QUALIFIES} GROUP BY repo) q
          ON q.repo = r.repo
        LEFT JOIN (SELECT 'repo_' || c_custkey AS repo, c_custkey AS issue_number FROM customer WHERE c_custkey % 2 = 0) i
          ON i.repo = r.repo"""
    ),
)
def issue_mutations(spark, folder):
    """Every second repository has an open issue from an earlier run."""
    c = F.col("c_custkey")
    open_issues = (
        views.table(spark, folder, "customer")
        .filter(c % 2 == 0)
        .select(views.repo_of(c).alias("repo"), c.alias("issue_number"))
    )
    return ops.issue_mutations(
        views.repositories(spark, folder), views.findings(spark, folder), open_issues
    )


@query(
    "remediation_plans",
    found(
        select=f"""SELECT repo, id, 'Plan for ' || id || ': ' || title || chr(10)
            || 'Severity ' || severity || ', category ' || category || ', status ' || status || chr(10)
            || 'Where: ' || coalesce(file, '{V.NO_FILE}') || ':' || coalesce(CAST(line AS VARCHAR), '{V.NO_LINE}') || ' '
            || coalesce('(' || endpoint || ')', '') || chr(10)
            || 'Confirm: ' || CASE WHEN trigger_condition = '' THEN '{V.NO_TRIGGER}' ELSE trigger_condition END || chr(10)
            || 'Fix: ' || CASE WHEN recommended_fix = '' THEN '{V.NO_FIX}' ELSE recommended_fix END AS plan
        FROM findings WHERE ordinal IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
    ),
)
def remediation_plans(spark, folder):
    """Plans for the findings whose orders had a line returned."""
    rows = views.findings(spark, folder)
    returned = (
        views.table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("ordinal"))
        .distinct()
    )
    requested = rows.join(returned, "ordinal", "left_semi").select("repo", "id")
    return ops.remediation_plans(rows, requested)


@query(
    "collapse_duplicates",
    found(
        select=f"""SELECT repo, file, line, category, id, severity, confidence, ordinal, sources, copies FROM (
          SELECT *, row_number() OVER (PARTITION BY repo, file, line, category ORDER BY rank, confidence DESC, ordinal) AS r,
            count(*) OVER (PARTITION BY repo, file, line, category) AS copies FROM (
              SELECT * REPLACE ('repo_' || (ordinal % 8) AS repo) FROM findings WHERE {ACTIVE})) f
          JOIN (SELECT repo AS g_repo, file AS g_file, line AS g_line, category AS g_category,
                  string_agg(DISTINCT source, ',' ORDER BY source) AS sources
                FROM (SELECT * REPLACE ('repo_' || (ordinal % 8) AS repo) FROM findings WHERE {ACTIVE}) GROUP BY ALL) g
          ON repo = g_repo AND file IS NOT DISTINCT FROM g_file AND line IS NOT DISTINCT FROM g_line
            AND category = g_category WHERE r = 1"""
    ),
)
def collapse_duplicates(spark, folder):
    """Findings of eight monorepos, so that many share a place."""
    merged = views.findings(spark, folder).withColumn("repo", views.repo_of(F.col("ordinal") % 8))
    return ops.collapse_duplicates(merged).withColumn("sources", F.array_join("sources", ",")).drop("title")


@query(
    "scanner_summary",
    portfolio(
        select="""SELECT r.repo, s.source, count(f.repo) AS findings
        FROM rollup_rows r CROSS JOIN (VALUES """
        + ", ".join(f"('scanner:{s}')" for s in V.SCANNERS)
        + """) s(source) LEFT JOIN findings f ON f.repo = r.repo AND f.source = s.source GROUP BY ALL
        UNION ALL SELECT repo, source, count(*) FROM findings WHERE source NOT LIKE 'scanner:%' GROUP BY ALL"""
    ),
)
def scanner_summary(spark, folder):
    return scanners.scanner_summary(
        views.findings(spark, folder), views.repositories(spark, folder)
    )


# --- rules ----------------------------------------------------------------------------------------------

RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in rule) + ")"
    for n, rule in enumerate(rule_catalog.RULES)
) + ") t(check_order, pack_dir, pack, category, check_id, severity, title))"


@query(
    "rule_catalog",
    with_views(
        views.FINDINGS_SQL, RULES_SQL,
        select=f"""SELECT r.*, (SELECT count(*) FROM findings f WHERE {ACTIVE} AND f.category = r.category
          AND f.severity = r.severity) AS active_findings FROM rules r""",
    ),
)
def catalog(spark, folder):
    return rule_catalog.checklist(rule_catalog.catalog(spark), views.findings(spark, folder))


@query(
    "rule_coverage",
    with_views(
        views.FINDINGS_SQL, RULES_SQL,
        select=f"""SELECT repo, f.category, active_findings, coalesce(checks, 0) AS checks, coalesce(packs, 0) AS packs
        FROM (SELECT repo, category, count(*) AS active_findings FROM findings WHERE {ACTIVE} GROUP BY ALL) f
        LEFT JOIN (SELECT category, count(*) AS checks, count(DISTINCT pack) AS packs FROM rules GROUP BY ALL) r
          ON r.category = f.category""",
    ),
)
def rule_coverage(spark, folder):
    return rule_catalog.coverage(rule_catalog.catalog(spark), views.findings(spark, folder))


# --- reports and sinks ----------------------------------------------------------------------------------

SARIF_SQL = f"""sarif AS (SELECT repo, ordinal, id AS rule_id, category AS rule_name,
    CASE WHEN description = '' THEN title ELSE description END AS full_description,
    CASE WHEN rank < 2 THEN 'error' WHEN rank < 4 THEN 'warning' ELSE 'note' END AS level,
    title || CASE WHEN impact = '' THEN '' ELSE ' Impact: ' || impact END
      || CASE WHEN recommended_fix = '' THEN '' ELSE ' Fix: ' || recommended_fix END AS message,
    status, confidence, endpoint, source, coalesce(file, '.') AS uri, line AS start_line, severity, title
  FROM findings WHERE {ACTIVE})"""


@query("sarif_results", with_views(views.FINDINGS_SQL, SARIF_SQL, select="SELECT * FROM sarif"))
def sarif_results(spark, folder):
    return reports.sarif_results(views.findings(spark, folder))


@query(
    "sarif_level_counts",
    with_views(views.FINDINGS_SQL, SARIF_SQL, select="SELECT repo, level, count(*) AS results FROM sarif GROUP BY ALL"),
)
def sarif_level_counts(spark, folder):
    return reports.sarif_level_counts(views.findings(spark, folder))


def sql_json(**fields):
    """SQL for a JSON object from SQL texts of its already encoded values."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}'"


def encoded(column):
    return f"CAST(to_json({column}) AS VARCHAR)"


SARIF_RULE = sql_json(
    id=encoded("rule_id"), name=encoded("rule_name"), shortDescription=sql_json(text=encoded("title")),
    fullDescription=sql_json(text=encoded("full_description")), defaultConfiguration=sql_json(level=encoded("level")),
    properties=sql_json(category=encoded("rule_name"), severity=encoded("severity")),
)
# An absent endpoint or line leaves its property out.
SARIF_RESULT = (
    "'{\"ruleId\":' || " + encoded("rule_id") + " || ',\"level\":' || " + encoded("level")
    + " || ',\"message\":' || " + sql_json(text=encoded("message"))
    + " || ',\"properties\":{\"status\":' || " + encoded("status") + " || ',\"confidence\":' || confidence"
    + " || coalesce(',\"endpoint\":' || " + encoded("endpoint") + ", '') || ',\"source\":' || " + encoded("source")
    + " || '},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":' || " + sql_json(uri=encoded("uri"))
    + " || coalesce(',\"region\":{\"startLine\":' || start_line || '}', '') || '}}]}'"
)


@query(
    "sarif_documents",
    with_views(
        views.FINDINGS_SQL, SARIF_SQL,
        select=f"""SELECT repo, chunk, chunks,
          '{{"$schema":"{V.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"fleetlens",'
          || '"version":"0.1.0","rules":[' || coalesce(string_agg({SARIF_RULE}, ',' ORDER BY n) FILTER (n > 0), '')
          || ']}}}},"automationDetails":{{"id":"' || repo || '/' || chunk || '/' || chunks || '"}},"results":['
          || coalesce(string_agg({SARIF_RESULT}, ',' ORDER BY n) FILTER (n > 0), '') || ']}}]}}' AS text
        FROM (SELECT *, coalesce((n - 1) // {reports.CHUNK_FINDINGS}, 0) AS chunk,
                coalesce((max(n) OVER (PARTITION BY repo) - 1) // {reports.CHUNK_FINDINGS} + 1, 1) AS chunks
              FROM (SELECT 'repo_' || c_custkey AS repo FROM customer) LEFT JOIN
                (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ordinal) AS n FROM sarif) USING (repo))
        GROUP BY repo, chunk, chunks""",
    ),
)
def sarif_documents(spark, folder):
    return reports.sarif_documents(views.findings(spark, folder), repos=every_repo(spark, folder))


JSON_SQL = ", ".join(f"{name} := {name}" for name in reports.JSON_FIELDS)


@query(
    "report_json",
    found(
        select=f"""SELECT repo, chunk, chunks, CAST(to_json(struct_pack(repository := repo, chunk := chunk, chunks := chunks,
            findings := coalesce(list(struct_pack({JSON_SQL}) ORDER BY n) FILTER (n > 0), []))) AS VARCHAR) AS text
        FROM (SELECT *, coalesce((n - 1) // {reports.CHUNK_FINDINGS}, 0) AS chunk,
                coalesce((max(n) OVER (PARTITION BY repo) - 1) // {reports.CHUNK_FINDINGS} + 1, 1) AS chunks,
                CAST([] AS VARCHAR[]) AS reproduction
              FROM (SELECT 'repo_' || c_custkey AS repo FROM customer) LEFT JOIN
                (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ordinal) AS n FROM findings) USING (repo))
        GROUP BY repo, chunk, chunks"""
    ),
)
def report_json(spark, folder):
    return reports.json_documents(views.findings(spark, folder), every_repo(spark, folder))


CATEGORY_NO = f"list_position({views.sql_list(V.CATEGORIES)}, category)"


@query(
    "report_lines",
    top(
        select=f"""SELECT repo, CAST(section_no AS INTEGER) AS section_no, CAST(part AS INTEGER) AS part, ordinal, text FROM (
          SELECT repo, 4 AS section_no, rank AS part, ordinal, {LINE_SQL} AS text FROM findings WHERE {ACTIVE}
          UNION ALL SELECT repo, 5, {CATEGORY_NO}, ordinal, {LINE_SQL} FROM findings WHERE {ACTIVE}
          UNION ALL SELECT repo, CASE category WHEN 'rate-limiting' THEN 8 WHEN 'dependency' THEN 9 ELSE 10 END, 0,
            ordinal, {LINE_SQL} FROM findings
            WHERE {ACTIVE} AND category IN ('rate-limiting', 'dependency', 'configuration')
          UNION ALL SELECT repo, 13, 0, ordinal, {LINE_SQL} FROM findings WHERE status = 'manual-verification'
          UNION ALL SELECT repo, 14, 0, ordinal, '- **' || id || '** ' || title || ' — '
            || CASE WHEN description = '' THEN 'rejected' ELSE description END FROM findings WHERE status = 'rejected'
          UNION ALL SELECT repo, 6, 0, place, place || '. ' || substr({LINE_SQL}, 3) FROM top
          UNION ALL SELECT repo, 12, 0, place, place || '. **' || id || '** (' || severity || ') — '
            || CASE WHEN recommended_fix = '' THEN title ELSE recommended_fix END FROM top)"""
    ),
)
def report_lines(spark, folder):
    return reports.finding_rows(views.findings(spark, folder))


@query(
    "findings_sink",
    found(
        select="""SELECT repo, ordinal, id, title, severity, category, status, confidence, file, line, endpoint,
          description, evidence, impact, trigger_condition, CAST([] AS VARCHAR[]) AS reproduction, recommended_fix, source
          FROM findings"""
    ),
)
def findings_sink(spark, folder):
    """Write the findings, then read them back."""
    path = fresh_path(spark, "findings")
    rows = views.findings(spark, folder)
    sinks.write_findings(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)
