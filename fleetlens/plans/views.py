"""Fleet tables derived from the given tables, row by row.

Every view maps one base row to one or a few files, documents or findings, so building it needs
no shuffle and grows with the base table. Repositories are customers, users or document
sources, so one may well own a large part of all rows.

The SQL twins (``*_SQL``) are what the oracle uses. They hold the facts the generated text was
made from, not the text, so that the two sides share no parsing.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import quoted


# A table read by fewer tasks than there are cores is dealt out over this many at least, if there are as many cores.
SPREAD = 64
# Rows of a table beyond twice which a task is too long; such tables are dealt out in pieces of this many.
PIECE_ROWS = 50_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table whose rows are costly to scan.

    A row group is read by one task, however many pieces its file is cut into, so what counts is how many
    rows each task finds (told by the footers). Where tasks are few or long, the rows are dealt out evenly; a
    table that is read in many short tasks is left as it is.
    """
    rows = table(spark, folder, name)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count()
    n, most, total = tasks.agg(F.count("*"), F.max("count"), F.sum("count")).first()
    cores = min(spark.sparkContext.defaultParallelism, SPREAD)
    if n >= cores and most <= 2 * PIECE_ROWS:
        return rows
    return rows.repartition(max(cores, -(-(total or 0) // PIECE_ROWS)))


def choose(number: str, options) -> str:
    """SQL for the option at ``number`` modulo their count."""
    listed = ", ".join("NULL" if o is None else quoted(o) for o in options)
    return f"get(array({listed}), CAST({number} % {len(options)} AS INT))"


def repo_of(key: Column) -> Column:
    return F.concat(F.lit("repo_"), key.cast("string"))


def text(key: Column) -> Column:
    return key.cast("string")


# --- documents as source files -----------------------------------------------------------------

DOCUMENT_DIRS = ["src", "node_modules/x", ".github/workflows", "k8s", "src/auth", "lib", "build"]
DOCUMENT_EXTS = [".ts", ".py", ".go", ".md", ".yaml", ".tf"]


def document_files(spark, folder) -> DataFrame:
    directory, suffix = choose("doc_id", DOCUMENT_DIRS), choose("doc_id", DOCUMENT_EXTS)
    return spread_table(spark, folder, "documents").selectExpr(
        "source AS repo",
        f"concat({directory}, '/', doc_id, {suffix}) AS path",
        "text AS content",
    )


def sql_list(options):
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


DOCUMENT_FILES_SQL = f"""files AS (
  SELECT source AS repo, doc_id, text AS content,
         {sql_list(DOCUMENT_DIRS)}[CAST(doc_id % 7 AS INTEGER) + 1] AS dir,
         {sql_list(DOCUMENT_EXTS)}[CAST(doc_id % 6 AS INTEGER) + 1] AS ext,
         {sql_list(DOCUMENT_DIRS)}[CAST(doc_id % 7 AS INTEGER) + 1] || '/' || doc_id
           || {sql_list(DOCUMENT_EXTS)}[CAST(doc_id % 6 AS INTEGER) + 1] AS path
  FROM documents)"""


# --- events as route files ------------------------------------------------------------------------

ROUTE_METHODS = ["get", "post", "put", "patch", "delete"]
ROUTE_SEGMENTS = {"signup": "signup", "error": "admin", "click": "export", "view": "items", "purchase": "payment"}
ROUTE_MIDDLEWARE = ["authenticate, ", "limiter, ", "validate(schema), ", ""]


def route_files(spark, folder) -> DataFrame:
    """One file per event: a comment line, then one to three route registrations."""
    segment = " ".join(f"WHEN '{kind}' THEN '{part}'" for kind, part in ROUTE_SEGMENTS.items())
    line = f"""concat(
        IF(event_id % 17 = 0, 'ROUTER . ', 'router.'), {choose("(event_id + j)", ROUTE_METHODS)},
        "('/api/", CASE event_type {segment} END, '/', event_type, '/', j, "', ",
        {choose("(event_id + j)", ROUTE_MIDDLEWARE)}, 'handler)',
        IF(event_id % 13 = 0, "; app.all('/health', handler)", ''))"""
    lines = f"transform(sequence(0, CAST(event_id % 3 AS INT)), j -> {line})"
    return spread_table(spark, folder, "events").selectExpr(
        "concat('repo_', user_id) AS repo",
        "concat('src/routes/', event_type, '_', event_id, IF(event_id % 11 = 0, '.test.ts', '.ts')) AS path",
        f"concat('// routes for ', event_type, '\\n', array_join({lines}, '\\n')) AS content",
    )


ROUTES_SQL = f"""calls AS (
  SELECT 'repo_' || user_id AS repo, event_id, event_type, j, k,
         'src/routes/' || event_type || '_' || event_id || '.ts' AS file,
         CAST(j + 2 AS INTEGER) AS line, CAST(k AS INTEGER) AS pos,
         CASE WHEN k = 1 THEN 'ALL'
              ELSE upper({sql_list(ROUTE_METHODS)}[CAST((event_id + j) % 5 AS INTEGER) + 1]) END AS method,
         CASE WHEN k = 1 THEN '/health'
              ELSE '/api/' || CASE event_type WHEN 'signup' THEN 'signup' WHEN 'error' THEN 'admin'
                WHEN 'click' THEN 'export' WHEN 'view' THEN 'items' ELSE 'payment' END
                || '/' || event_type || '/' || j END AS path,
         (event_id + j) % 4 AS middleware,
         (k = 0 AND event_type <> 'view') AS sensitive
  FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS j FROM events) e,
       (SELECT 0 AS k UNION ALL SELECT 1) kk
  WHERE event_id % 11 <> 0 AND (k = 0 OR event_id % 13 = 0)),
inventory AS (
  SELECT *, CASE WHEN middleware = 0 THEN true END AS auth_required,
         CASE WHEN middleware = 0 THEN true END AS authorization_checked,
         CASE WHEN middleware = 1 THEN true END AS rate_limited,
         CASE WHEN middleware = 2 THEN true END AS input_validated
  FROM calls)"""


# --- customers and orders as manifests ----------------------------------------------------------

def manifest_files(spark, folder) -> DataFrame:
    """Root files from customers, one nested package per order."""
    framework = choose("c_custkey", ["express", "fastify", "koa", "next", "react", None])
    store = choose("c_custkey", ["pg", "stripe", "@aws-sdk/client-s3", None])

    def block(*names):
        pairs = ", ".join(f"""concat('"', {n}, '":"^1.0.0"')""" for n in names)
        return f"concat('{{', array_join(array_compact(array({pairs})), ','), '}}')"

    root = f"""CASE WHEN c_custkey % 17 = 0 THEN '{{bad' WHEN c_custkey % 19 = 0 THEN ''
        ELSE concat('{{"dependencies":', {block(framework, store)}, ',"devDependencies":',
            {block("CASE c_custkey % 5 WHEN 0 THEN 'vitest' WHEN 1 THEN 'jest' END")},
            IF(c_custkey % 9 = 0, ',"peerDependencies":{{"vue":"*"}}', ''), '}}') END"""
    listed = [
        ("c_custkey % 23 <> 0", "package.json", root),
        ("c_custkey % 3 = 0", "pnpm-lock.yaml", "'lockfileVersion: 9'"),
        ("c_custkey % 3 = 1", "package-lock.json", "'{}'"),
        (
            "c_custkey % 5 = 0", "requirements.txt",
            r"IF(c_custkey % 2 = 0, 'Django==4\nupgrade-tools\n', 'fastapi\npytest\n')",
        ),
        ("c_custkey % 8 = 0", "go.mod", "'require github.com/gin-gonic/gin v1'"),
        ("c_custkey % 16 = 0", "tools/go.mod", "'require github.com/labstack/echo v4'"),
        ("c_custkey % 16 = 0", "cmd/main_test.go", "'package main'"),
        ("c_custkey % 12 = 0", "Cargo.toml", """'axum = "0.7"'"""),
        ("c_custkey % 7 = 0", "tests/test_app.py", "'assert True'"),
    ]
    files = ", ".join(
        f"IF({when}, named_struct('path', '{path}', 'content', {content}), NULL)"
        for when, path, content in listed
    )
    roots = spread_table(spark, folder, "customer").selectExpr(
        "concat('repo_', c_custkey) AS repo", f"inline(array_compact(array({files})))"
    )
    packages = spread_table(spark, folder, "orders").selectExpr(
        "concat('repo_', o_custkey) AS repo",
        "concat('packages/p', o_orderkey, '/package.json') AS path",
        """IF(o_orderkey % 97 = 0, '{bad', concat(
            '{"dependencies":{"dep-', o_orderkey, '":"',
            CASE o_orderkey % 10 WHEN 0 THEN '*' WHEN 1 THEN 'latest' ELSE '^1.0.0' END,
            '"},"devDependencies":{"dev-', o_orderkey, '":"',
            IF(o_orderkey % 7 = 0, 'latest', '~2.0.0'), '"}}')) AS content""",
    )
    return roots.unionByName(packages)


MANIFESTS_SQL = """root AS (
  SELECT 'repo_' || c_custkey AS repo, c_custkey AS c,
         (c_custkey % 23 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0) AS readable
  FROM customer),
paths AS (
  SELECT repo, 'package.json' AS path FROM root WHERE c % 23 <> 0
  UNION ALL SELECT repo, 'pnpm-lock.yaml' FROM root WHERE c % 3 = 0
  UNION ALL SELECT repo, 'package-lock.json' FROM root WHERE c % 3 = 1
  UNION ALL SELECT repo, 'requirements.txt' FROM root WHERE c % 5 = 0
  UNION ALL SELECT repo, 'go.mod' FROM root WHERE c % 8 = 0
  UNION ALL SELECT repo, 'tools/go.mod' FROM root WHERE c % 16 = 0
  UNION ALL SELECT repo, 'cmd/main_test.go' FROM root WHERE c % 16 = 0
  UNION ALL SELECT repo, 'Cargo.toml' FROM root WHERE c % 12 = 0
  UNION ALL SELECT repo, 'tests/test_app.py' FROM root WHERE c % 7 = 0
  UNION ALL SELECT 'repo_' || o_custkey, 'packages/p' || o_orderkey || '/package.json' FROM orders),
deps AS (
  SELECT repo, CASE c % 6 WHEN 0 THEN 'express' WHEN 1 THEN 'fastify' WHEN 2 THEN 'koa'
           WHEN 3 THEN 'next' WHEN 4 THEN 'react' END AS dep FROM root WHERE readable AND c % 6 < 5
  UNION SELECT repo, CASE c % 4 WHEN 0 THEN 'pg' WHEN 1 THEN 'stripe' ELSE '@aws-sdk/client-s3' END
    FROM root WHERE readable AND c % 4 < 3
  UNION SELECT repo, CASE c % 5 WHEN 0 THEN 'vitest' ELSE 'jest' END FROM root WHERE readable AND c % 5 < 2
  UNION SELECT repo, 'vue' FROM root WHERE readable AND c % 9 = 0
  UNION SELECT 'repo_' || o_custkey, 'dep-' || o_orderkey FROM orders WHERE o_orderkey % 97 <> 0
  UNION SELECT 'repo_' || o_custkey, 'dev-' || o_orderkey FROM orders WHERE o_orderkey % 97 <> 0),
managers AS (
  SELECT repo, 'pnpm' AS package_manager FROM root WHERE c % 3 = 0
  UNION SELECT repo, 'npm' FROM root WHERE c % 3 = 1
  UNION SELECT repo, 'pip' FROM root WHERE c % 5 = 0
  UNION SELECT repo, 'go-modules' FROM root WHERE c % 8 = 0
  UNION SELECT repo, 'cargo' FROM root WHERE c % 12 = 0
  UNION SELECT DISTINCT repo, 'npm' FROM paths
    WHERE path LIKE '%package.json' AND repo NOT IN (SELECT repo FROM root WHERE c % 3 < 2)),
node_facts AS (
  SELECT repo, 'framework' AS concern, CASE dep WHEN 'express' THEN 'Express' WHEN 'fastify' THEN 'Fastify'
    WHEN 'koa' THEN 'Koa' WHEN 'next' THEN 'Next.js (API routes)' WHEN 'react' THEN 'React' ELSE 'Vue' END AS label
  FROM deps WHERE dep IN ('express', 'fastify', 'koa', 'next', 'react', 'vue')
  UNION SELECT repo, 'api_framework', CASE dep WHEN 'express' THEN 'Express' WHEN 'fastify' THEN 'Fastify'
    WHEN 'koa' THEN 'Koa' ELSE 'Next.js (API routes)' END
  FROM deps WHERE dep IN ('express', 'fastify', 'koa', 'next')
  UNION SELECT repo, 'test_framework', CASE dep WHEN 'vitest' THEN 'Vitest' ELSE 'Jest' END
  FROM deps WHERE dep IN ('vitest', 'jest')),
other_facts AS (
  SELECT repo, concern, CASE c % 2 WHEN 0 THEN 'Django' ELSE 'FastAPI' END AS label
  FROM root, (SELECT 'framework' AS concern UNION ALL SELECT 'api_framework') x WHERE c % 5 = 0
  UNION SELECT repo, 'test_framework', 'pytest' FROM root WHERE (c % 5 = 0 AND c % 2 = 1) OR c % 7 = 0
  UNION SELECT repo, 'api_framework', 'Gin' FROM root WHERE c % 8 = 0
  UNION SELECT repo, 'test_framework', 'go test' FROM root WHERE c % 16 = 0
  UNION SELECT repo, 'api_framework', 'Axum' FROM root WHERE c % 12 = 0
  UNION SELECT repo, 'test_framework', 'cargo test' FROM root WHERE c % 12 = 0),
store_facts AS (
  SELECT repo, 'database' AS concern, 'PostgreSQL' AS label FROM deps WHERE dep = 'pg'
  UNION SELECT repo, 'database', 'PostgreSQL' FROM root WHERE c % 5 = 0 AND c % 2 = 0
  UNION SELECT repo, 'integration', 'Stripe' FROM deps WHERE dep = 'stripe'
  UNION SELECT repo, 'integration', 'AWS SDK' FROM deps WHERE dep = '@aws-sdk/client-s3'),
floating AS (
  SELECT 'repo_' || o_custkey AS repo, 'packages/p' || o_orderkey || '/package.json' AS path, 0 AS block_no,
         'dep-' || o_orderkey AS dep, CASE o_orderkey % 10 WHEN 0 THEN '*' ELSE 'latest' END AS range
  FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 10 < 2
  UNION ALL
  SELECT 'repo_' || o_custkey, 'packages/p' || o_orderkey || '/package.json', 1, 'dev-' || o_orderkey, 'latest'
  FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 7 = 0),
bad AS (
  SELECT repo, 'package.json' AS path FROM root WHERE c % 17 = 0 AND c % 23 <> 0
  UNION ALL SELECT 'repo_' || o_custkey, 'packages/p' || o_orderkey || '/package.json'
  FROM orders WHERE o_orderkey % 97 = 0),
unlocked AS (
  SELECT repo, min(path) AS path FROM paths WHERE path LIKE '%package.json'
    AND repo NOT IN (SELECT repo FROM root WHERE c % 3 < 2) GROUP BY repo)"""


# --- orders as configuration files ----------------------------------------------------------------

CONFIG_LINES = [
    "debug: true", "rejectUnauthorized: false", "origin: '*'", "httpOnly: false", "secure: false",
    "cookie: { secure: false, httpOnly: false }; debug = TRUE", "port: 80", "mode: plain",
]


def config_source_files(spark, folder) -> DataFrame:
    return spread_table(spark, folder, "orders").selectExpr(
        "concat('repo_', o_custkey) AS repo",
        "concat('conf/', o_orderstatus, '_', o_orderkey, IF(o_orderkey % 9 = 0, '.md', '.yaml')) AS path",
        f"concat('name: order_', o_orderkey, '\\n', {choose('o_orderkey', CONFIG_LINES)}, '\\nend') AS content",
    )


CONFIG_SQL = """config AS (
  SELECT 'repo_' || o_custkey AS repo, 'conf/' || o_orderstatus || '_' || o_orderkey || '.yaml' AS path,
         CAST(2 AS INTEGER) AS line_no, r.rule_no, r.label, r.severity, r.fix
  FROM orders, (VALUES
    (0, 'TLS certificate verification disabled', 'high', [1],
     'Do not disable TLS verification; fix the certificate chain instead.'),
    (1, 'Wildcard CORS origin', 'medium', [2],
     'Restrict CORS to an explicit origin allowlist; avoid ''*'' with credentials.'),
    (2, 'Debug mode enabled', 'low', [0, 5], 'Disable debug mode in production configuration.'),
    (3, 'Insecure cookie flag', 'medium', [3, 4, 5],
     'Set cookies with Secure and HttpOnly (and SameSite) in production.')
    ) r(rule_no, label, severity, kinds, fix)
  WHERE o_orderkey % 9 <> 0 AND list_contains(r.kinds, CAST(o_orderkey % 8 AS INTEGER)))"""


# --- customers as application sources -----------------------------------------------------------

def server_files(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "concat('repo_', c_custkey) AS repo",
        "'src/server.js' AS path",
        r"""concat_ws('\n', 'noop()', IF(c_custkey % 5 = 0, 'helmet()', 'noop()'),
            IF(c_custkey % 4 = 0, 'isadmin(user)', 'noop()')) AS content""",
    )


def application_files(spark, folder) -> DataFrame:
    """Sources and manifests of the customer repositories together."""
    return server_files(spark, folder).unionByName(manifest_files(spark, folder))


def earlier_files(files: DataFrame) -> DataFrame:
    """The fleet before its last changes: a fifth of the files did not exist, a fifth was different, and others are gone now."""
    turn = "pmod(xxhash64(repo, path), 5)"
    kept = files.where(f"{turn} <> 0").selectExpr(
        "repo", "path", f"""IF({turn} = 1, concat('{{"dependencies":{{"koa":"1","stripe":"2"}}}} django pytest gin ', length(content)), content) AS content"""
    )
    lost = files.where(f"{turn} = 2").selectExpr(
        "repo", "concat('a/', path) AS path", """IF(path LIKE '%go.mod', 'require github.com/gofiber/fiber v2', content) AS content"""
    )
    return kept.unionByName(lost)


# --- orders as findings -----------------------------------------------------------------------------

FINDING_SOURCES = ["scanner:routes", "tool:semgrep", "scanner:secrets", "manual"]


def findings(spark, folder) -> DataFrame:
    category = choose("o_orderkey", V.CATEGORIES)
    in_api = f"{category} IN ({', '.join(quoted(c) for c in V.ENDPOINT_CATEGORIES)})"

    def unless(every, value):
        return f"IF(o_orderkey % {every} = 0, '', concat('{value} ', o_orderkey))"

    return table(spark, folder, "orders").selectExpr(
        "concat('repo_', o_custkey) AS repo",
        "o_orderkey AS ordinal",
        "format_string('RG-ORD-%03d', o_orderkey) AS id",
        r"""concat('Order ', o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN ' | split'
            WHEN o_orderkey % 29 = 0 THEN '\nsecond line' ELSE '' END) AS title""",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'informational' END AS severity""",
        f"{category} AS category",
        """CASE WHEN o_orderkey % 10 = 0 THEN 'manual-verification' WHEN o_orderstatus = 'P' THEN 'potential'
            WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'rejected' END AS status""",
        "CAST(o_orderkey % 101 AS INT) AS confidence",
        "IF(o_orderkey % 5 <> 0, concat('src/f', o_orderkey % 50, '.ts'), NULL) AS file",
        "IF(o_orderkey % 3 <> 0, CAST(o_orderkey % 400 + 1 AS INT), NULL) AS line",
        f"IF({in_api}, concat('GET /api/', o_orderkey % 20), NULL) AS endpoint",
        f"{unless(4, 'about')} AS description",
        "concat('evidence ', o_orderkey) AS evidence",
        f"{unless(9, 'impact')} AS impact",
        f"{unless(7, 'when')} AS trigger_condition",
        "CAST(array() AS ARRAY<STRING>) AS reproduction",
        f"{unless(6, 'fix')} AS recommended_fix",
        f"{choose('o_orderkey', FINDING_SOURCES)} AS source",
    )


FINDINGS_SQL = f"""findings AS (
  SELECT 'repo_' || o_custkey AS repo, o_orderkey AS ordinal, printf('RG-ORD-%03d', o_orderkey) AS id,
         'Order ' || o_orderkey || CASE WHEN o_orderkey % 13 = 0 THEN ' | split'
            WHEN o_orderkey % 29 = 0 THEN chr(10) || 'second line' ELSE '' END AS title,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'informational' END AS severity,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
            WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END AS rank,
         {sql_list(V.CATEGORIES)}[CAST(o_orderkey % 11 AS INTEGER) + 1] AS category,
         CASE WHEN o_orderkey % 10 = 0 THEN 'manual-verification' WHEN o_orderstatus = 'P' THEN 'potential'
            WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'rejected' END AS status,
         CAST(o_orderkey % 101 AS INTEGER) AS confidence,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'src/f' || (o_orderkey % 50) || '.ts' END AS file,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 400 + 1 AS INTEGER) END AS line,
         CASE WHEN o_orderkey % 11 IN (2, 3, 4, 5) THEN 'GET /api/' || (o_orderkey % 20) END AS endpoint,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'about ' || o_orderkey END AS description,
         'evidence ' || o_orderkey AS evidence,
         CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'impact ' || o_orderkey END AS impact,
         CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'when ' || o_orderkey END AS trigger_condition,
         CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'fix ' || o_orderkey END AS recommended_fix,
         {sql_list(FINDING_SOURCES)}[CAST(o_orderkey % 4 AS INTEGER) + 1] AS source
  FROM orders)"""


def reviewed_findings(spark, folder) -> DataFrame:
    """Findings as a reviewer might have left them, some of them invalid."""
    k = F.col("ordinal")
    return findings(spark, folder).withColumns(
        {
            "id": F.when(k % 97 == 0, F.lit("auth-1")).otherwise(F.col("id")),
            "severity": F.when(k % 89 == 0, F.lit("urgent")).otherwise(F.col("severity")),
            "status": F.when(k % 83 == 0, F.lit("maybe")).otherwise(F.col("status")),
            "confidence": F.when(k % 79 == 0, F.lit(150)).otherwise(F.col("confidence")),
            "title": F.when(k % 73 == 0, F.lit("")).otherwise(F.col("title")),
            "line": F.when(k % 71 == 0, F.lit(0)).otherwise(F.col("line")),
        }
    )


REVIEWED_SQL = FINDINGS_SQL + """,
reviewed AS (
  SELECT * REPLACE (
    CASE WHEN ordinal % 97 = 0 THEN 'auth-1' ELSE id END AS id,
    CASE WHEN ordinal % 89 = 0 THEN 'urgent' ELSE severity END AS severity,
    CASE WHEN ordinal % 83 = 0 THEN 'maybe' ELSE status END AS status,
    CASE WHEN ordinal % 79 = 0 THEN 150 ELSE confidence END AS confidence,
    CASE WHEN ordinal % 73 = 0 THEN '' ELSE title END AS title,
    CASE WHEN ordinal % 71 = 0 THEN 0 ELSE line END AS line),
    (ordinal % 97 = 0 OR ordinal % 89 = 0 OR ordinal % 83 = 0 OR ordinal % 79 = 0 OR ordinal % 73 = 0
      OR ordinal % 71 = 0) AS broken
  FROM findings)"""


# --- customers as repositories with settings and host scans ---------------------------------------

def repositories(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        repo_of(F.col("c_custkey")).alias("repo"), F.col("c_mktsegment").alias("category"),
        F.col("c_nationkey").alias("nation"),
    )


def settings(spark, folder) -> DataFrame:
    """Scan settings and discovered stack of every repository."""
    managers = """array_compact(array(IF(c_custkey % 2 = 0, 'npm', NULL), IF(c_custkey % 3 = 0, 'pnpm', NULL),
        IF(c_custkey % 5 = 0, 'pip/poetry', NULL), IF(c_custkey % 7 = 0, 'poetry', NULL),
        IF(c_custkey % 4 = 0, 'go-modules', NULL), IF(c_custkey % 6 = 0, 'cargo', NULL)))"""
    return table(spark, folder, "customer").selectExpr(
        "concat('repo_', c_custkey) AS repo",
        f"array({choose('c_custkey', [t[0] for t in V.TOOLS])}) AS disabled",
        *[f"c_custkey % {10 + n} <> 0 AS {t}" for n, t in enumerate(V.AUDIT_TOGGLES)],
        "c_custkey % 4 = 1 AS scope_security",
        "c_custkey % 3 = 1 AS scope_api",
        f"{managers} AS package_managers",
        f"size({managers}) AS dependency_files",
        "c_custkey % 4 <> 3 AS has_tests",
    )


def observed_runs(spark, folder) -> DataFrame:
    """Tools found on each host and how they ended; a sixth of them are missing."""
    names = ", ".join(quoted(t[0]) for t in V.TOOLS)
    outcomes = ["", "error", "timeout", "completed", "completed", "completed"]
    return (
        table(spark, folder, "customer")
        .selectExpr("c_custkey", f"posexplode(array({names})) AS (tool_order, tool)")
        .filter("(c_custkey + tool_order) % 6 <> 0")
        .selectExpr(
            "concat('repo_', c_custkey) AS repo",
            "tool",
            f"{choose('(c_custkey + tool_order)', outcomes)} AS outcome",
            """IF((c_custkey + tool_order) % 6 > 2, CAST((c_custkey + tool_order) % 3 AS INT), NULL)
                AS exit_code""",
        )
    )


TOOLS_SQL = "tools AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, '{t[0]}', '{t[1]}', '{t[2]}')" for n, t in enumerate(V.TOOLS)
) + ") t(tool_order, tool, \"binary\", gate))"

SETTINGS_SQL = TOOLS_SQL + f""",
settings AS (
  SELECT 'repo_' || c_custkey AS repo, c_custkey AS c,
         {", ".join(f'c_custkey % {10 + n} <> 0 AS "{t}"' for n, t in enumerate(V.AUDIT_TOGGLES))},
         c_custkey % 4 = 1 AS scope_security, c_custkey % 3 = 1 AS scope_api
  FROM customer),
per_tool AS (
  SELECT repo, c, tool_order, tool, "binary", gate,
         (c % 9 = tool_order) AS disabled,
         NOT (CASE gate WHEN 'security' THEN security ELSE dependencies END) AS gated,
         CASE tool_order WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true
           WHEN 3 THEN c % 2 = 0 OR c % 3 = 0 OR c % 5 = 0 OR c % 7 = 0
           WHEN 4 THEN c % 2 = 0 WHEN 5 THEN c % 3 = 0 WHEN 6 THEN c % 5 = 0 OR c % 7 = 0
           WHEN 7 THEN c % 4 = 0 ELSE c % 6 = 0 END AS applicable,
         (c + tool_order) % 6 AS o
  FROM settings, tools),
matrix AS (
  SELECT repo, c, tool_order, tool,
         CASE WHEN disabled OR gated THEN 'skipped-disabled' WHEN NOT applicable THEN 'skipped-not-applicable'
           WHEN o = 0 THEN 'skipped-unavailable' WHEN o = 1 THEN 'error' WHEN o = 2 THEN 'timeout'
           ELSE 'completed' END AS status,
         (o <> 0 AND NOT disabled AND NOT gated) AS available,
         CASE WHEN NOT disabled AND NOT gated AND applicable AND o > 2
           THEN CAST((c + tool_order) % 3 AS INTEGER) END AS exit_code,
         CASE WHEN disabled THEN 'Disabled in config.scanners.disabled.'
           WHEN gated THEN 'Gated off (audit.' || gate || ' = false).'
           WHEN NOT applicable THEN 'Scanner does not apply to the detected stack.'
           WHEN o = 0 THEN 'Binary "' || "binary" || '" not found on PATH. Install it to enable this scan.'
           WHEN o > 2 AND (c + tool_order) % 3 <> 0 THEN 'Exited non-zero (' || ((c + tool_order) % 3)
             || '); many scanners use this to signal findings — inspect the output file.'
           ELSE '' END AS note
  FROM per_tool)"""


# --- orders as tool output documents ----------------------------------------------------------------

TOOL_SEVERITIES = ["ERROR", "WARNING", "moderate", "LOW", "info", "weird"]
LONG_DOCUMENT = 205


def tool_documents() -> dict:
    """SQL for the output document of each tool, made of the items ``i`` of order ``k``."""
    severity = choose("(k + i)", TOOL_SEVERITIES)

    def joined(*parts, keep="true"):
        item = "concat(" + ", ".join(parts) + ")"
        return f"array_join(transform(filter(indices, i -> {keep}), i -> {item}), ',')"

    semgrep = joined(
        """'{"check_id":"'""",
        "CASE (k + i) % 7 WHEN 0 THEN concat('plain', i) WHEN 1 THEN 'odd.' ELSE concat('js.rule', i) END",
        """'","path":"'""", "IF((k + i) % 5 = 0, '', concat('src/f', i, '.js'))",
        """'","start":{"line":'""", "(k + i) % 50", """'},"extra":{"severity":"'""", severity,
        """'","message":"m'""", "k", "'-'", "i", """'","metadata":{'""",
        """IF(i % 2 = 0, concat('"shortlink":"s', i, '"'), '')""", "'}}}'",
    )
    gitleaks = joined(
        """'{"RuleID":"'""", "IF(i % 3 = 2, '', concat('r', i))", """'","Description":"d'""", "i",
        """'","File":"f'""", "k", """'.env","StartLine":'""", "i", """',"Match":"'""",
        "repeat('x', i % 100 + 150)", """'"}'""",
    )
    npm = joined(
        """'"pkg'""", "i", """'":{"severity":"'""", severity, """'","range":"<'""", "k", """'","via":['""",
        """IF(i % 2 = 0, concat('"other",{"title":"t', i, '","url":"u', i, '"}'), '"only"')""",
        """'],"fixAvailable":'""", choose("i", ["true", "false", '{"name":"x"}']), "'}'",
    )
    advisories = joined(
        """'"'""", "1000 - i", """'":{"module_name":"mod'""", "i", """'","title":"t'""", "k",
        """'","severity":"'""", severity, """'","overview":"'""",
        "IF(i % 2 = 0, repeat('o', i % 100 + 250), '')", """'","url":"u'""", "i", """'"}'""",
    )
    osv = joined(
        """'{"packages":[{"package":{"ecosystem":"npm","name":"p'""", "i div 3",
        """'","version":"1"},"vulnerabilities":[{"id":"G-'""", "i % 2", """'","summary":"s'""", "i",
        """'","database_specific":{"severity":"'""", severity, """'"}}]}]}'""",
    )
    vulnerabilities = joined(
        """'{"PkgName":"p'""", "i", """'","VulnerabilityID":"CVE-'""", "k", """'","Severity":"'""", severity,
        """'","Title":"'""", "IF(i % 2 = 0, concat('t', i), '')", """'","Description":"d'""", "i",
        """'","PrimaryURL":"u'""", "i", """'"}'""",
    )
    leaked = joined(
        """'{"RuleID":"r'""", "i", """'","Title":"t'""", "i", """'","Severity":"'""", severity,
        """'","StartLine":"'""", "i", """'"}'""", keep="i % 2 = 1",
    )
    misconfigured = joined(
        """'{"ID":"DS'""", "i", """'","Title":"t'""", "i", """'","Severity":"'""", severity,
        """'","Description":"d'""", "i", """'"}'""",
    )
    return {
        "semgrep": f"""concat('{{"results":[', {semgrep}, ']}}')""",
        "gitleaks": f"concat('[', {gitleaks}, ']')",
        "npm-audit": f"""concat('{{"vulnerabilities":{{', {npm}, '}},"advisories":{{', {advisories}, '}}}}')""",
        "pnpm-audit": f"""concat('{{"advisories":{{', {advisories}, '}}}}')""",
        # Every fifth document also has elements that are no records and give no findings.
        "osv-scanner": f"""concat('{{"results":[', {osv}, IF(k % 5 = 0, concat(IF(size(indices) > 0, ',', ''),
            '"odd",null,{{"packages":["odd",7,{{"package":"odd"}}]}}'), ''), ']}}')""",
        "trivy": f"""concat('{{"Results":[{{"Target":"t', k, '","Vulnerabilities":[', {vulnerabilities},
            ']}},{{"Target":"","Secrets":[', {leaked}, '],"Misconfigurations":[', {misconfigured}, ']}}',
            IF(k % 5 = 0, ',"odd",null,{{"Target":"x","Vulnerabilities":"odd"}}', ''), ']}}')""",
        "pip-audit": "'{}'",
    }


def tool_runs(spark, folder, *tools: str) -> DataFrame:
    """One output document per order and tool, with 0 to 3 items, or 205 now and then."""
    documents = tool_documents()
    per_tool = ", ".join(
        f"""named_struct('tool', '{tool}', 'stdout',
            CASE WHEN k % 29 = 0 THEN 'not json' WHEN k % 37 = 0 THEN '  ' ELSE {documents[tool]} END)"""
        for tool in tools or documents
    )
    size = f"IF(o_orderkey % 500 = 0, {LONG_DOCUMENT}, CAST(o_orderkey % 4 AS INT))"
    return (
        spread_table(spark, folder, "orders")
        .selectExpr(
            "concat('repo_', o_custkey) AS repo",
            "o_orderkey AS k",
            f"IF({size} > 0, sequence(0, {size} - 1), CAST(array() AS ARRAY<INT>)) AS indices",
        )
        .selectExpr(
            "repo", "k AS run_id", "IF(k % 31 = 0, 'timeout', 'completed') AS status",
            f"inline(array({per_tool}))",
        )
    )


TOOL_ITEMS_SQL = f"""docs AS (
  SELECT 'repo_' || o_custkey AS repo, o_orderkey AS run_id, o_orderkey AS k,
         CASE WHEN o_orderkey % 500 = 0 THEN {LONG_DOCUMENT} ELSE o_orderkey % 4 END AS size
  FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 29 <> 0 AND o_orderkey % 37 <> 0),
items AS (
  SELECT *, {sql_list(["high", "medium", "medium", "low", "informational", "medium"])}[CAST((k + i) % 6 AS INTEGER) + 1]
    AS severity
  FROM (SELECT *, unnest(range(0, size)) AS i FROM docs) x)"""


# --- events as a stream of findings ---------------------------------------------------------------

def observed_severity() -> Column:
    return F.expr(
        """CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high'
           WHEN 'signup' THEN 'medium' WHEN 'click' THEN 'low' ELSE 'informational' END"""
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT 'repo_' || user_id AS repo, event_id, event_type, ts, CAST(ts AS DATE) AS day,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
           WHEN 'click' THEN 'low' ELSE 'informational' END AS severity
  FROM events)"""


# --- events as runs, findings and issues ------------------------------------------------------------

def audit_events(spark, folder) -> DataFrame:
    """What happened to a repository: audit runs, findings, and issues opened and closed."""
    return table(spark, folder, "events").selectExpr(
        "concat('repo_', user_id) AS repo",
        "event_id",
        "ts",
        """CASE event_type WHEN 'view' THEN 'run' WHEN 'signup' THEN 'open' WHEN 'click' THEN 'closed'
           ELSE 'finding' END AS kind""",
    )


# --- orders and line items as periods, in days ------------------------------------------------------

# Most issues are open for days or weeks, some for years, and some still are.
OPEN_DAYS = "CASE WHEN o_orderkey % 50 = 7 THEN 1500 ELSE 1 + (o_orderkey % 12) * (o_orderkey % 12) END"


def issue_periods(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "concat('repo_', o_custkey) AS repo",
        "o_orderkey AS issue",
        "CAST(unix_date(CAST(o_orderdate AS DATE)) AS LONG) AS opened",
        f"IF(o_orderkey % 23 = 0, NULL, unix_date(CAST(o_orderdate AS DATE)) + {OPEN_DAYS}) AS closed",
    )


def sighting_periods(spark, folder) -> DataFrame:
    """When a finding was first and last seen; a few were seen on no whole day, or are still there."""
    return table(spark, folder, "lineitem").selectExpr(
        "concat('repo_', l_suppkey) AS repo",
        "l_orderkey * 10 + l_linenumber AS finding",
        "CAST(unix_date(CAST(l_shipdate AS DATE)) AS LONG) AS first_seen",
        "IF(l_orderkey % 101 = 0, NULL, unix_date(CAST(l_shipdate AS DATE)) + l_linenumber * 3 - 3) AS last_seen",
    )


ISSUE_PERIODS_SQL = f"""SELECT 'repo_' || o_custkey AS repo, o_orderkey AS issue,
  CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS opened,
  CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) - DATE '1970-01-01' + {OPEN_DAYS} END AS closed
  FROM orders"""
SIGHTING_PERIODS_SQL = """SELECT 'repo_' || l_suppkey AS repo, l_orderkey * 10 + l_linenumber AS finding,
  CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS first_seen,
  CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) - DATE '1970-01-01' + l_linenumber * 3 - 3 END AS last_seen
  FROM lineitem"""


# --- orders as files with two versions ----------------------------------------------------------------

def edited_files(spark, folder, edited: bool) -> DataFrame:
    """One file per order, before or after an edit that depends on the order.

    A file is a name, then steps (unique lines), each followed by a risk (lines that repeat), then an end.
    """
    steps = "sequence(1, CAST(k % 4 + 2 AS INT))"

    def lines(keep="true", risk="j % 3"):
        return f"flatten(transform(filter({steps}, j -> {keep}), j -> array(concat('step ', j, ' of ', k), concat('risk ', {risk}))))"

    def text(*parts):
        return f"array_join(concat({', '.join(parts)}), '\\n')"

    name, end = "array(concat('name ', k))", "array('end')"
    added = "transform(sequence(1, CAST(k % 3 + 1 AS INT)), i -> concat('added ', i, ' to ', k))"
    plain = text(name, lines(), end)
    cases = {
        2: text(added, name, lines(), end),
        3: text(name, lines(keep="j > 1"), end),
        5: text(name, lines(risk="IF(j = 2, 9, j % 3)"), end),
        6: text(name, "array('risk 1')", lines(), end),
        7: text(name, lines(), end, "array('risk 7')"),
    }
    content = plain if not edited else f"CASE k % 8 {' '.join(f'WHEN {n} THEN {c}' for n, c in cases.items())} ELSE {plain} END"
    rows = table(spark, folder, "orders").selectExpr("concat('repo_', o_custkey) AS repo", "o_orderkey AS k")
    files = rows.where("k % 8 <> 4" if edited else "true").selectExpr("repo", "concat('conf/', k, '.txt') AS path", f"{content} AS content")
    fresh = rows.where("k % 16 = 1" if edited else "false").selectExpr("repo", "concat('new/', k, '.txt') AS path", "'risk 4' AS content")
    return files.unionByName(fresh)


def risk_lines(files: DataFrame) -> DataFrame:
    """A finding for every line that tells a risk."""
    return (
        files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "rule"))
        .where(F.col("rule").startswith("risk "))
        .select("repo", "path", (F.col("pos") + 1).alias("line"), "rule")
    )


EDITS_SQL = """risks AS (
  SELECT 'repo_' || o_custkey AS repo, 'conf/' || o_orderkey || '.txt' AS path, o_orderkey AS k, o_orderkey % 8 AS e, j,
         'risk ' || (j % 3) AS rule, CAST(2 * j + 1 AS INTEGER) AS line
  FROM (SELECT *, unnest(range(1, o_orderkey % 4 + 3)) AS j FROM orders)),
fates AS (
  SELECT repo, path, rule, line AS was_line,
         CASE WHEN e = 4 OR (e = 3 AND j = 1) OR (e = 5 AND j = 2) THEN NULL
              ELSE CAST(line + CASE e WHEN 2 THEN k % 3 + 1 WHEN 3 THEN -2 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) END AS now_line
  FROM risks),
fresh AS (
  SELECT 'repo_' || o_custkey AS repo, 'conf/' || o_orderkey || '.txt' AS path,
         CASE o_orderkey % 8 WHEN 5 THEN 'risk 9' WHEN 6 THEN 'risk 1' ELSE 'risk 7' END AS rule,
         CAST(CASE o_orderkey % 8 WHEN 5 THEN 5 WHEN 6 THEN 2 ELSE 2 * (o_orderkey % 4 + 2) + 3 END AS INTEGER) AS now_line
  FROM orders WHERE o_orderkey % 8 > 4
  UNION ALL SELECT 'repo_' || o_custkey, 'new/' || o_orderkey || '.txt', 'risk 4', 1 FROM orders WHERE o_orderkey % 16 = 1),
changes AS (
  SELECT repo, path, rule, was_line, now_line,
         CASE WHEN now_line IS NULL THEN 'gone' WHEN now_line = was_line THEN 'kept' ELSE 'moved' END AS change,
         CAST(1 AS BIGINT) AS n FROM fates
  UNION ALL SELECT repo, path, rule, NULL, now_line, 'new', 1 FROM fresh)"""
