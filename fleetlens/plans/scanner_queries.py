"""Queries on line scanners, finding construction, tool ingestion and coverage."""

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import finding_id, normal_severity
from ..functions.tables import lookup, numbered, written
from ..operators import coverage, ingest, ingest_rejects, rule_index, scanners
from ..sources import files as source
from ..sources.tool_output import outputs_of, usable_outputs
from . import views
from .registry import query, with_views

# The SQL twins of the secret rules, in RE2 syntax.
SECRET_SQL = r"""lines AS (
  SELECT doc_id, parts[n] AS line, CAST(n AS INTEGER) AS line_no FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (
      SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS parts FROM documents))),
found AS (
  SELECT doc_id, line_no, 'aws-access-key' AS kind,
         unnest(regexp_extract_all(line, '\b(AKIA[0-9A-Z]{16})\b', 1)) AS value FROM lines
  UNION ALL
  SELECT doc_id, line_no, 'assigned-credential',
         unnest(regexp_extract_all(line,
           '(?i)(?:token|secret|api_?key|password)\s*[:=]\s*["'']([^"''\s]{16,})["'']', 1)) FROM lines
  UNION ALL
  SELECT doc_id, line_no, 'private-key',
         unnest(regexp_extract_all(line, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)) FROM lines),
secrets AS (
  SELECT * FROM found WHERE NOT regexp_matches(value, '(?i)your-|example|changeme|xxxx|placeholder'))"""


def document_texts(spark, folder):
    return views.spread_table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("content")
    )


@query(
    "secrets_scan",
    with_views(
        SECRET_SQL,
        select="""SELECT doc_id, line_no, kind, sha256(value) AS secret_sha256,
          CAST(length(value) AS INTEGER) AS secret_length FROM secrets""",
    ),
)
def secrets_scan(spark, folder):
    lines = source.lines_matching(document_texts(spark, folder), scanners.SECRET_LINE)
    return scanners.secret_hits(lines).drop("pos")


@query(
    "finding_ids",
    with_views(
        views.CONFIG_SQL,
        select="""SELECT repo, path, line_no, label, severity,
          printf('RG-CONF-%03d', row_number() OVER (PARTITION BY repo ORDER BY path, line_no, rule_no)) AS id
        FROM config""",
    ),
)
def finding_ids(spark, folder):
    """Numbering of one scanner's hits on its own."""
    lines = source.lines_matching(views.config_source_files(spark, folder), scanners.CONFIG_LINE)
    hits = scanners.config_hits(lines)
    ranked = numbered(written(hits, "config"), ["repo"], ["path", "line_no", "rule_no"])
    return ranked.select(
        "repo", "path", "line_no", "label", "severity", finding_id("CONF", F.col("n")).alias("id")
    )


def fleet_files(spark, folder):
    """Every derived repository together: applications, configuration, routes and documents.

    Generated files are stored first, as a fleet's files would be; documents are stored already.
    """
    generated = (
        views.application_files(spark, folder)
        .unionByName(views.config_source_files(spark, folder))
        .unionByName(views.route_files(spark, folder))
    )
    return written(generated, "files").unionByName(views.document_files(spark, folder))


@query(
    "seed_findings",
    with_views(
        views.ROUTES_SQL, views.MANIFESTS_SQL, views.CONFIG_SQL, views.DOCUMENT_FILES_SQL, SECRET_SQL,
        select=f"""SELECT repo, source, printf('RG-' || area || '-%03d', row_number() OVER (
              PARTITION BY repo, source ORDER BY part, file, line, k1, k2)) AS id, severity, category, status,
            CAST(confidence AS INTEGER) AS confidence, file, CAST(line AS INTEGER) AS line, title FROM (
          SELECT repo, 'scanner:routes' AS source, 'API' AS area, 0 AS part, file, line, pos AS k1, kind AS k2,
                 severity, category, 'potential' AS status, 45 AS confidence, title FROM (
            SELECT *, 0 AS kind, 'high' AS severity, 'api-security' AS category,
                   '{V.NO_AUTH_TITLE}' || method || ' ' || path AS title FROM inventory
              WHERE sensitive AND auth_required IS NULL
            UNION ALL
            SELECT *, 1, 'medium', 'rate-limiting', '{V.NO_RATE_TITLE}' || method || ' ' || path FROM inventory
              WHERE sensitive AND rate_limited IS NULL)
          UNION ALL
          SELECT repo, 'scanner:configuration', 'CONF', 0, path, line_no, rule_no, 0, severity, 'configuration',
                 'potential', 55, label || ' in ' || path FROM config
          UNION ALL
          SELECT repo, 'scanner:dependencies', 'DEP', part, path, NULL, block_no, 0, 'low', 'dependency', status,
                 confidence, title FROM (
            SELECT repo, path, 0 AS part, 0 AS block_no, 'manual-verification' AS status, 40 AS confidence,
                   'Unparseable manifest ' || path AS title FROM bad
            UNION ALL SELECT repo, path, 0, block_no, 'potential', 60,
                   'Floating version for "' || dep || '" (' || range || ')' FROM floating
            UNION ALL SELECT repo, path, 1, 0, 'potential', 65, '{V.NO_LOCKFILE_TITLE}' FROM unlocked)
          UNION ALL
          SELECT f.repo, 'scanner:secrets', 'SECRET', 0, f.path, s.line_no, 0, 0, 'high', 'secrets', 'potential', 50,
                 'Possible hardcoded secret (' || s.kind || ')'
          FROM secrets s JOIN files f ON f.doc_id = s.doc_id
          WHERE f.ext <> '.tf' AND f.dir NOT IN ('node_modules/x', 'build')
          UNION ALL
          SELECT repo, 'scanner:permissions', 'AUTHZ', 0, NULL, NULL, 0, 0, 'high', 'authorization',
                 'manual-verification', 40, '{V.NO_AUTHZ_TITLE}'
          FROM (SELECT repo FROM node_facts WHERE concern = 'api_framework'
                UNION SELECT repo FROM other_facts WHERE concern = 'api_framework'
                UNION SELECT repo FROM calls)
          WHERE repo NOT IN (SELECT repo FROM root WHERE c % 4 = 0)
          UNION ALL
          SELECT DISTINCT repo, 'scanner:security-headers', 'HDR', 0, NULL, NULL, 0, 0, 'medium', 'security',
                 'potential', 50, '{V.NO_HEADERS_TITLE}'
          FROM node_facts WHERE concern = 'api_framework' AND label IN ('Express', 'Fastify', 'Koa')
            AND repo NOT IN (SELECT repo FROM root WHERE c % 5 = 0))"""
,
    ),
)
def seed_findings(spark, folder):
    evidence = scanners.collect(source.exclude(fleet_files(spark, folder)))
    return scanners.seed_findings(evidence).select(
        "repo", "source", "id", "severity", "category", "status", "confidence", "file", "line", "title"
    )


CUSTOM_RULES = [
    ("license text", "informational", r"(?i)licen[sc]e", "Check the licence terms."),
    ("dotted address", "low", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "Do not hardcode addresses."),
    ("long number", "medium", r"[0-9]{16}", "Remove card-like numbers."),
    ("token assignment", "high", r"token\s*=", "Load tokens from a secret store."),
]


@query(
    "custom_rule_scan",
    "WITH "
    + SECRET_SQL
    + ", rules AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"({n}, '{label}', '{severity}', '{pattern}', '{fix}')"
        for n, (label, severity, pattern, fix) in enumerate(CUSTOM_RULES)
    )
    + """) t(rule_no, label, severity, pattern, fix))
    SELECT doc_id, line_no, rule_no, label, severity, fix FROM lines, rules
    WHERE regexp_matches(line, pattern)""",
)
def custom_rule_scan(spark, folder):
    return scanners.custom_rules(document_texts(spark, folder), CUSTOM_RULES)


def word_rules(spark, folder):
    """The custom rules, and one for every long first word of a document."""
    fixed = lookup(spark, ["rule_no", "label", "severity", "pattern", "fix"], [(n, *rule) for n, rule in enumerate(CUSTOM_RULES)])
    words = views.table(spark, folder, "documents").select(F.regexp_extract("text", "^[A-Za-z]{8,}", 0).alias("label")).where("label <> ''").distinct()
    numbered = words.select(F.xxhash64("label").alias("rule_no"), "label", F.lit("low").alias("severity"), F.col("label").alias("pattern"), F.lit("").alias("fix"))
    return fixed.unionByName(numbered)


@query(
    "custom_rule_index",
    "WITH "
    + SECRET_SQL
    + """, words AS (SELECT DISTINCT regexp_extract(text, '^[A-Za-z]{8,}') AS label FROM documents),
    rules AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{label}', '{severity}', '{pattern}', '{fix}')" for label, severity, pattern, fix in CUSTOM_RULES)
    + """) t(label, severity, pattern, fix))
    SELECT doc_id, line_no, label, severity, fix FROM lines, rules WHERE regexp_matches(line, pattern)
    UNION ALL SELECT doc_id, line_no, label, 'low', '' FROM lines, words WHERE label <> '' AND contains(line, label)""",
)
def custom_rule_index(spark, folder):
    """All rules in one pass over the contents, found by their literals."""
    return rule_index.scan(document_texts(spark, folder), word_rules(spark, folder)).drop("rule_no")


# --- tool ingestion ----------------------------------------------------------------------------------

tools = partial(with_views, views.TOOL_ITEMS_SQL)
INGEST_COLUMNS = [
    "repo", "run_id", "ordinal", "id", "title", "severity", "category", "file", "line", "description",
    "evidence", "recommended_fix",
]


def ingested(spark, folder, tool, ingester=None):
    runs = outputs_of(views.tool_runs(spark, folder, tool), tool)
    return (ingester or ingest.INGESTERS[tool])(runs).select(*INGEST_COLUMNS)


def tool_sql(area, number, title, category, where="true", file="NULL", line="NULL", description="''",
             evidence="''", fix="''", severity="severity"):
    return tools(
        select=f"""SELECT repo, run_id, CAST({number} AS BIGINT) AS ordinal,
          printf('RG-{area}-%03d', CAST({number} AS BIGINT)) AS id, {title} AS title, {severity} AS severity,
          '{category}' AS category, CAST({file} AS VARCHAR) AS file, CAST({line} AS INTEGER) AS line,
          {description} AS description, {evidence} AS evidence, {fix} AS recommended_fix
        FROM items WHERE {where}"""
    )


@query(
    "tool_output_source",
    """SELECT 'repo_' || o_custkey AS repo, o_orderkey AS run_id, tool FROM orders,
      (VALUES ('semgrep'), ('gitleaks'), ('npm-audit'), ('pnpm-audit'), ('osv-scanner'), ('trivy')) t(tool)
    WHERE o_orderkey % 31 <> 0 AND (o_orderkey % 29 = 0 OR o_orderkey % 37 <> 0)""",
)
def tool_output_source(spark, folder):
    return usable_outputs(views.tool_runs(spark, folder)).select("repo", "run_id", "tool")


@query(
    "ingest_semgrep",
    tool_sql(
        "SEMGREP", "i + 1",
        "'semgrep: ' || CASE (k + i) % 7 WHEN 0 THEN 'plain' || i WHEN 1 THEN 'odd.' ELSE 'rule' || i END",
        "security",
        file="CASE WHEN (k + i) % 5 <> 0 THEN 'src/f' || i || '.js' END",
        line="nullif((k + i) % 50, 0)",
        description="CASE WHEN i % 2 = 0 THEN 's' || i ELSE 'm' || k || '-' || i END",
        evidence="'m' || k || '-' || i",
    ),
)
def ingest_semgrep(spark, folder):
    return ingested(spark, folder, "semgrep")


@query(
    "ingest_gitleaks",
    tool_sql(
        "GITLEAKS", "i + 1", "'Secret: ' || CASE WHEN i % 3 = 2 THEN 'd' || i ELSE 'r' || i END", "secrets",
        file="'f' || k || '.env'", line="nullif(i, 0)", description="'d' || i",
        evidence="repeat('x', CAST(i % 100 + 150 AS INTEGER))", fix=f"'{V.LEAK_FIX}'",
        severity="'high'",
    ),
)
def ingest_gitleaks(spark, folder):
    return ingested(spark, folder, "gitleaks")


@query(
    "ingest_npm",
    tool_sql(
        "NPM", "i + 1",
        "'Vulnerable dependency: pkg' || i || CASE WHEN i % 2 = 0 THEN ' — t' || i ELSE '' END", "dependency",
        description="""'npm audit flagged "pkg' || i || '" (range: <' || k || ').'""",
        evidence="CASE WHEN i % 2 = 0 THEN 'u' || i ELSE '' END",
        fix=f"CASE WHEN i % 3 = 1 THEN '{V.NO_FIX_AVAILABLE}' ELSE '{V.FIX_AVAILABLE}' END",
    ),
)
def ingest_npm(spark, folder):
    return ingested(spark, folder, "npm-audit", ingest.npm_vulnerabilities)


# Advisory ids descend in the document; integer keys are taken in ascending order.
FROM_LAST = "size - 1 - i"


@query(
    "ingest_npm_v6",
    tool_sql(
        "NPM", f"size + {FROM_LAST} + 1", "'Vulnerable dependency: mod' || i || ' — t' || k",
        "dependency",
        description="CASE WHEN i % 2 = 0 THEN repeat('o', CAST(i % 100 + 250 AS INTEGER)) ELSE '' END",
        evidence="'u' || i",
    ),
)
def ingest_npm_v6(spark, folder):
    return ingested(spark, folder, "npm-audit", ingest.npm_advisories)


@query(
    "ingest_pnpm",
    tool_sql(
        "PNPM", f"{FROM_LAST} + 1", "'Vulnerable dependency: mod' || i || ' — t' || k", "dependency",
        description="CASE WHEN i % 2 = 0 THEN repeat('o', CAST(i % 100 + 250 AS INTEGER)) ELSE 't' || k END",
        evidence="'u' || i",
    ),
)
def ingest_pnpm(spark, folder):
    return ingested(spark, folder, "pnpm-audit")


# Of every three neighbours the last repeats the first one's advisory.

@query(
    "ingest_osv",
    with_views(
        views.TOOL_ITEMS_SQL,
        select="""SELECT repo, run_id, n AS ordinal, printf('RG-OSV-%03d', n) AS id,
          'p' || (i // 3) || '@1: G-' || (i % 2) AS title, severity, 'dependency' AS category,
          CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, 's' || i AS description,
          'G-' || (i % 2) AS evidence, '' AS recommended_fix
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, i // 3, i % 2 ORDER BY i) AS r FROM items) WHERE r = 1)""",
    ),
)
def ingest_osv(spark, folder):
    return ingested(spark, folder, "osv-scanner")


@query(
    "ingest_trivy",
    with_views(
        views.TOOL_ITEMS_SQL,
        select="""SELECT repo, run_id, n AS ordinal, printf('RG-TRIVY-%03d', n) AS id,
          CASE kind WHEN 0 THEN 'p' || i || ': CVE-' || k WHEN 1 THEN 'Secret: r' || i
            ELSE 'Misconfig: DS' || i || ' t' || i END AS title, severity,
          CASE kind WHEN 0 THEN 'dependency' WHEN 1 THEN 'secrets' ELSE 'configuration' END AS category,
          CASE WHEN kind = 0 THEN 't' || k END AS file, CASE WHEN kind = 1 THEN CAST(i AS INTEGER) END AS line,
          CASE WHEN kind = 0 AND i % 2 = 0 THEN 't' || i WHEN kind = 1 THEN 't' || i ELSE 'd' || i END AS description,
          CASE WHEN kind = 0 THEN 'u' || i ELSE '' END AS evidence, '' AS recommended_fix
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind, i) AS n
              FROM items, (VALUES (0), (1), (2)) t(kind) WHERE kind <> 1 OR i % 2 = 1)""",
    ),
)
def ingest_trivy(spark, folder):
    return ingested(spark, folder, "trivy")


@query(
    "severity_normalise",
    f"""SELECT o_orderkey, spelling, CASE lower(spelling) WHEN 'error' THEN 'high' WHEN 'low' THEN 'low'
      WHEN 'info' THEN 'informational' ELSE 'medium' END AS severity
    FROM (SELECT o_orderkey, {views.sql_list(views.TOOL_SEVERITIES)}[CAST(o_orderkey % 6 AS INTEGER) + 1] AS spelling
          FROM orders)""",
)
def severity_normalise(spark, folder):
    spelling = F.expr(views.choose("o_orderkey", views.TOOL_SEVERITIES))
    return views.table(spark, folder, "orders").select(
        "o_orderkey", spelling.alias("spelling"), normal_severity(spelling).alias("severity")
    )


@query(
    "tool_cap",
    tools(
        select="""SELECT repo, run_id, 'tool:' || tool AS source, CASE WHEN tool = 'npm-audit' THEN 2 ELSE 1 END
            * least(CASE tool WHEN 'osv-scanner' THEN size - size // 3
                WHEN 'trivy' THEN size + size // 2 + size ELSE size END, 200) AS findings
        FROM docs, (VALUES ('semgrep'), ('gitleaks'), ('npm-audit'), ('pnpm-audit'), ('osv-scanner'), ('trivy')) t(tool)
        WHERE size > 0"""
    ),
)
def tool_cap(spark, folder):
    """Findings kept per document under the customary limits, which hold inside each document."""
    kept = [
        ingest.ingest_all(views.tool_runs(spark, folder, tool), {tool: ingester}, ingest.CUSTOMARY)
        for tool, ingester in ingest.INGESTERS.items()
    ]
    return (
        reduce(DataFrame.unionByName, kept)
        .groupBy("repo", "run_id", "source")
        .agg(F.count("*").alias("findings"))
    )


# --- coverage ----------------------------------------------------------------------------------------

settings = partial(with_views, views.SETTINGS_SQL)


@query("enabled_scanners", settings(select="SELECT repo, tool, gate FROM per_tool WHERE NOT disabled AND NOT gated"))
def enabled_scanners(spark, folder):
    return coverage.enabled(views.settings(spark, folder)).select("repo", "tool", "gate")


@query("scanner_applicability", settings(select="SELECT repo, tool, applicable FROM per_tool"))
def scanner_applicability(spark, folder):
    return coverage.applicability(views.settings(spark, folder)).select("repo", "tool", "applicable")


def matrix_of(spark, folder):
    return coverage.status_matrix(views.settings(spark, folder), views.observed_runs(spark, folder))


@query(
    "scan_status_matrix",
    settings(select="SELECT repo, tool_order, tool, available, status, exit_code, note FROM matrix"),
)
def scan_status_matrix(spark, folder):
    return matrix_of(spark, folder)


@query(
    "scan_completion",
    settings(
        select="SELECT repo, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM matrix GROUP BY repo"
    ),
)
def scan_completion(spark, folder):
    return coverage.completion(matrix_of(spark, folder))


@query(
    "audit_limitations",
    settings(
        select=f"""SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY place) AS INTEGER) AS ordinal, limitation FROM (
          SELECT repo, place, limitation FROM settings, (VALUES
            {", ".join(f"({n}, '{t}')" for n, t in enumerate(V.LIMITATIONS))}) t(place, limitation)
          UNION ALL SELECT repo, 10, '{V.UNAVAILABLE_LIMITATION}' || string_agg(tool, ', ' ORDER BY tool_order) || '.'
            FROM matrix WHERE status = 'skipped-unavailable' GROUP BY repo
          UNION ALL SELECT repo, 11, '{V.NO_TESTS_LIMITATION}' FROM settings WHERE c % 4 = 3)"""
    ),
)
def audit_limitations(spark, folder):
    tested = views.settings(spark, folder).select("repo", "has_tests")
    return coverage.limitations(matrix_of(spark, folder), tested)


def scope_sql():
    columns = []
    for toggle in V.AUDIT_TOGGLES:
        flags = [f"scope_{s}" for s, members in V.SCOPE_TOGGLES.items() if toggle in members]
        chosen = " OR ".join(flags) or "false"
        columns.append(
            f'CASE WHEN scope_security OR scope_api THEN ({chosen}) ELSE "{toggle}" END AS "{toggle}"'
        )
    return settings(
        select=f"""SELECT *, CASE gate WHEN 'security' THEN security ELSE dependencies END AS allowed FROM (
          SELECT repo, tool, gate, {", ".join(columns)} FROM settings, tools)"""
    )


@query("scope_matrix", scope_sql())
def scope_matrix(spark, folder):
    return coverage.scope_matrix(views.settings(spark, folder)).drop(
        "tool_order", "binary", "applies_when"
    )


@query(
    "ingest_rejects",
    f"""WITH d AS (
      SELECT 'repo_' || o_custkey AS repo, o_orderkey AS run_id, o_orderkey AS k,
             CASE WHEN o_orderkey % 500 = 0 THEN {views.LONG_DOCUMENT} ELSE o_orderkey % 4 END AS size
      FROM orders WHERE o_orderkey % 31 <> 0),
    t AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in ingest_rejects.LAYOUTS)}) t(tool)),
    odd AS (SELECT * FROM d WHERE k % 29 <> 0 AND k % 37 <> 0 AND k % 5 = 0)
    SELECT repo, run_id, tool, '' AS place, CASE WHEN k % 29 = 0 THEN 'not json' ELSE 'empty' END AS reason
      FROM d, t WHERE k % 29 = 0 OR k % 37 = 0
    UNION ALL SELECT repo, run_id, 'osv-scanner', '/results/' || (size + j), 'not a record' FROM odd, (VALUES (0), (1)) x(j)
    UNION ALL SELECT repo, run_id, 'osv-scanner', '/results/' || (size + 2) || '/packages/' || j, 'not a record'
      FROM odd, (VALUES (0), (1)) x(j)
    UNION ALL SELECT repo, run_id, 'trivy', '/Results/' || j, 'not a record' FROM odd, (VALUES (2), (3)) x(j)
    UNION ALL SELECT repo, run_id, 'trivy', '/Results/4/Vulnerabilities', 'not a list' FROM odd""",
)
def rejected_elements(spark, folder):
    """What the ingest functions pass over, with place and reason."""
    return ingest_rejects.rejects(views.tool_runs(spark, folder))
