"""Queries on sources and discovery."""

from functools import partial

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import basename
from ..functions.tables import fresh_path, written
from ..operators import discovery, findings, scanners
from ..operators import discovery_delta as delta
from ..sources import files as source
from . import views
from .registry import query, with_views

docs = partial(with_views, views.DOCUMENT_FILES_SQL)
manifests = partial(with_views, views.MANIFESTS_SQL)
routes = partial(with_views, views.ROUTES_SQL)
KEPT = "dir NOT IN ('node_modules/x', 'build')"


@query("file_scan", docs(select="SELECT repo, path, CAST(strlen(content) AS BIGINT) AS bytes FROM files"))
def file_scan(spark, folder):
    return views.document_files(spark, folder).select(
        "repo", "path", F.octet_length("content").cast("long").alias("bytes")
    )


@query("exclude_filter", docs(select=f"SELECT repo, path FROM files WHERE {KEPT}"))
def exclude_filter(spark, folder):
    return source.exclude(views.document_files(spark, folder).select("repo", "path"))


FILE_CAP = 20


@query(
    "file_cap",
    docs(
        select=f"""SELECT repo, path, CAST(strlen(content) AS BIGINT) AS bytes, n > {FILE_CAP} AS truncated FROM (
          SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS r,
                 count(*) OVER (PARTITION BY repo) AS n FROM files) WHERE r <= {FILE_CAP}"""
    ),
)
def file_cap(spark, folder):
    return source.cap(views.document_files(spark, folder), FILE_CAP).select(
        "repo", "path", F.octet_length("content").cast("long").alias("bytes"), "truncated"
    )


@query("text_files", docs(select="SELECT repo, path FROM files WHERE ext <> '.tf'"))
def text_files(spark, folder):
    return source.text_files(views.document_files(spark, folder)).select("repo", "path")


@query(
    "file_lines",
    r"""SELECT doc_id, CAST(n AS INTEGER) AS line_no, parts[n] AS line FROM (
      SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (
        SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS parts FROM documents))""",
)
def file_lines(spark, folder):
    return source.explode_lines(
        views.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    )


@query(
    "manifest_parse",
    manifests(
        select="""SELECT p.repo, p.path, (b.path IS NULL AND NOT (p.path = 'package.json'
             AND r.c % 19 = 0 AND r.c % 17 <> 0)) AS valid,
           CASE WHEN b.path IS NOT NULL THEN 0 WHEN p.path <> 'package.json' THEN 2
             WHEN r.c % 19 = 0 AND r.c % 17 <> 0 THEN 0
             ELSE CAST(r.c % 6 < 5 AS BIGINT) + CAST(r.c % 4 < 3 AS BIGINT) + CAST(r.c % 5 < 2 AS BIGINT)
               + CAST(r.c % 9 = 0 AS BIGINT) END AS declared
         FROM paths p LEFT JOIN bad b ON p.repo = b.repo AND p.path = b.path
           LEFT JOIN root r ON p.repo = r.repo WHERE p.path LIKE '%package.json'"""
    ),
)
def manifest_parse(spark, folder):
    parsed = discovery.package_manifests(views.manifest_files(spark, folder))
    declared = sum(
        (F.coalesce(F.cardinality(b), F.lit(0)) for b in discovery.DEPENDENCY_BLOCKS), F.lit(0)
    )
    return parsed.select("repo", "path", "valid", declared.cast("long").alias("declared"))


@query(
    "languages",
    docs(
        select="""SELECT DISTINCT repo, CASE ext WHEN '.ts' THEN 'TypeScript' WHEN '.py' THEN 'Python' ELSE 'Go' END
         AS language FROM files WHERE ext IN ('.ts', '.py', '.go')"""
    ),
)
def languages(spark, folder):
    return discovery.languages(views.document_files(spark, folder))


@query("package_managers", manifests(select="SELECT repo, package_manager FROM managers"))
def package_managers(spark, folder):
    return discovery.package_managers(views.manifest_files(spark, folder))


@query(
    "dependency_files",
    manifests(select="SELECT repo, path FROM paths WHERE path NOT IN ('cmd/main_test.go', 'tests/test_app.py')"),
)
def dependency_files(spark, folder):
    return discovery.dependency_files(views.manifest_files(spark, folder))


@query("node_deps", manifests(select="SELECT repo, dep FROM deps"))
def node_deps(spark, folder):
    return discovery.node_dependencies(views.manifest_files(spark, folder))


@query("node_frameworks", manifests(select="SELECT repo, concern, label FROM node_facts"))
def node_frameworks(spark, folder):
    manifests = discovery.package_manifests(views.manifest_files(spark, folder))
    return discovery.node_frameworks(discovery.declared_dependencies(manifests))


@query("non_node_stacks", manifests(select="SELECT repo, concern, label FROM other_facts"))
def non_node_stacks(spark, folder):
    return discovery.non_node_stacks(written(views.manifest_files(spark, folder), "files"))


@query("datastores_integrations", manifests(select="SELECT repo, concern, label FROM store_facts"))
def datastores_integrations(spark, folder):
    return discovery.stores_and_integrations(written(views.manifest_files(spark, folder), "files"))


@query("ci_files", docs(select="SELECT repo, path FROM files WHERE dir = '.github/workflows'"))
def ci_files(spark, folder):
    return discovery.paths_where(views.document_files(spark, folder), discovery.is_ci_file)


@query("infra_files", docs(select="SELECT repo, path FROM files WHERE dir = 'k8s' OR ext = '.tf'"))
def infra_files(spark, folder):
    return discovery.paths_where(views.document_files(spark, folder), discovery.is_infra_file)


@query(
    "auth_files",
    docs(select="SELECT repo, path FROM files WHERE dir = 'src/auth' AND ext IN ('.ts', '.py', '.go')"),
)
def auth_files(spark, folder):
    return discovery.paths_where(views.document_files(spark, folder), discovery.is_auth_file)


@query(
    "config_files",
    """SELECT 'repo_' || o_custkey AS repo, 'conf/' || o_orderstatus || '_' || o_orderkey || '.yaml' AS path
       FROM orders WHERE o_orderkey % 9 <> 0""",
)
def config_files(spark, folder):
    return discovery.paths_where(
        views.config_source_files(spark, folder), discovery.is_config_file
    )


@query(
    "api_endpoints",
    routes(select="SELECT repo, method, path, file, line, pos FROM calls"),
)
def api_endpoints(spark, folder):
    return discovery.endpoints(views.route_files(spark, folder)).drop("text")


def stored_application(spark, folder):
    """The generated files as a stored table, which queries with several branches read."""
    return written(views.application_files(spark, folder), "files")


def listed(*columns):
    return [F.array_join(c, ",").alias(c) for c in columns]


PROFILE_SQL = """all_facts AS (
  SELECT repo, concern, label FROM node_facts UNION SELECT repo, concern, label FROM other_facts
  UNION SELECT repo, concern, label FROM store_facts
  UNION SELECT repo, 'package_manager', package_manager FROM managers
  UNION SELECT repo, 'language', 'JavaScript' FROM root
  UNION SELECT repo, 'language', 'Python' FROM root WHERE c % 7 = 0
  UNION SELECT repo, 'language', 'Go' FROM root WHERE c % 16 = 0),
all_paths AS (SELECT repo, path FROM paths UNION ALL SELECT repo, 'src/server.js' FROM root),
counts AS (
  SELECT repo, count(*) AS file_count,
         count(*) FILTER (path NOT IN ('cmd/main_test.go', 'tests/test_app.py', 'src/server.js')) AS dependency_files,
         count(*) FILTER (path IN ('pnpm-lock.yaml', 'Cargo.toml')) AS config_files
  FROM all_paths GROUP BY repo),
wide AS (
  SELECT repo,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'language'), '') AS languages,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'framework'), '') AS frameworks,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'package_manager'), '') AS package_managers,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'api_framework'), '') AS api_frameworks,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'test_framework'), '') AS test_frameworks,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'database'), '') AS databases,
    coalesce(string_agg(label, ',' ORDER BY label) FILTER (concern = 'integration'), '') AS integrations
  FROM all_facts GROUP BY repo)"""


PROFILE_ROWS_SQL = with_views(
    views.MANIFESTS_SQL, PROFILE_SQL,
    select="""SELECT counts.repo, file_count, dependency_files, config_files,
      CAST(0 AS BIGINT) AS ci_workflows, CAST(0 AS BIGINT) AS infra_files, CAST(0 AS BIGINT) AS auth_files,
      CAST(0 AS BIGINT) AS api_endpoints, languages, frameworks, package_managers, api_frameworks,
      test_frameworks, databases, integrations
    FROM counts JOIN wide ON counts.repo = wide.repo""",
)


@query(
    "discovery_profile",
    PROFILE_ROWS_SQL,
)
def discovery_profile(spark, folder):
    files = stored_application(spark, folder)
    manifests = files.filter(basename(F.col("path")).isin(discovery.READ_MANIFESTS))
    rows = discovery.profile(files.select("repo", "path"), manifests, discovery.endpoints(files))
    return rows.select(
        "repo", "api_endpoints", *discovery.PATH_COUNTS, *listed(*discovery.PROFILE_LISTS)
    )


@query("discovery_delta", PROFILE_ROWS_SQL)
def discovery_delta(spark, folder):
    """The same profile, from an earlier state of the fleet and the files that were added, edited and removed since."""
    files = stored_application(spark, folder)
    store = fresh_path(spark, "contents")
    delta.store_contents(files, store, digits=1)
    state = delta.begun(views.earlier_files(files))
    now = delta.advanced(
        state, written(delta.digests(files), "digests"), lambda wanted: delta.stored_contents(spark, store, wanted, digits=1)
    )
    return delta.profile(now).select("repo", "api_endpoints", *discovery.PATH_COUNTS, *listed(*discovery.PROFILE_LISTS))


@query(
    "discovery_incremental",
    docs(
        select="""SELECT repo, CASE WHEN hash_even THEN 'prior' ELSE 'computed' END AS origin,
          count(*) AS file_count FROM (
            SELECT repo, max(doc_id) OVER (PARTITION BY repo) % 2 = 0 AS hash_even FROM files) GROUP BY ALL"""
    ),
)
def discovery_incremental(spark, folder):
    """Repositories whose newest document has an even id were discovered by an earlier run."""
    def counted(files, origin):
        return files.groupBy("repo").agg(F.count("*").alias("file_count")).select(
            "repo", F.lit(origin).alias("origin"), "file_count"
        )

    listing = views.document_files(spark, folder).select("repo", "path")
    earlier = (
        views.table(spark, folder, "documents")
        .groupBy(F.col("source").alias("repo"))
        .agg(F.max("doc_id").alias("newest"))
        .filter(F.col("newest") % 2 == 0)
    )
    prior = written(counted(listing.join(earlier, "repo", "left_semi"), "prior"), "prior")
    return discovery.incremental(listing, prior, lambda missing: counted(missing, "computed"))


# --- routes, manifests and posture -----------------------------------------------------------------

CONTROL_COLUMNS = "auth_required, authorization_checked, rate_limited, input_validated"


@query(
    "api_inventory",
    routes(
        select=f"""SELECT repo, method, path, file, line, pos, {CONTROL_COLUMNS}, sensitive,
          '{V.INVENTORY_NOTE}' AS notes FROM inventory"""
    ),
)
def api_inventory(spark, folder):
    return scanners.api_inventory(discovery.endpoints(views.route_files(spark, folder)))


HINTS_SQL = "|".join(V.SENSITIVE_HINTS)


@query(
    "sensitive_paths",
    f"""SELECT page_id, path, regexp_matches(lower(path), '{HINTS_SQL}') AS sensitive FROM (
      SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages)
    UNION ALL SELECT event_id, '/api/' || event_type || '/' || user_id, event_type = 'signup' FROM events""",
)
def sensitive_paths(spark, folder):
    pages = views.table(spark, folder, "pages").select(
        "page_id", F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")).alias("path")
    )
    events = views.table(spark, folder, "events").select(
        F.col("event_id").alias("page_id"),
        F.concat(F.lit("/api/"), "event_type", F.lit("/"), views.text(F.col("user_id"))).alias("path"),
    )
    return pages.unionByName(events).withColumn("sensitive", scanners.is_sensitive(F.col("path")))


GAP_COLUMNS = ["repo", "file", "line", "pos", "endpoint", "title", "severity", "category"]


def gaps_of(spark, folder):
    return scanners.route_gaps(
        scanners.api_inventory(discovery.endpoints(views.route_files(spark, folder)))
    )


@query(
    "missing_auth",
    routes(
        select=f"""SELECT repo, file, line, pos, method || ' ' || path AS endpoint,
          '{V.NO_AUTH_TITLE}' || method || ' ' || path AS title, 'high' AS severity, 'api-security' AS category
        FROM inventory WHERE sensitive AND auth_required IS NULL"""
    ),
)
def missing_auth(spark, folder):
    return gaps_of(spark, folder).filter("category = 'api-security'").select(*GAP_COLUMNS)


@query(
    "missing_rate_limit",
    routes(
        select=f"""SELECT repo, file, line, pos, method || ' ' || path AS endpoint,
          '{V.NO_RATE_TITLE}' || method || ' ' || path AS title, 'medium' AS severity, 'rate-limiting' AS category
        FROM inventory WHERE sensitive AND rate_limited IS NULL"""
    ),
)
def missing_rate_limit(spark, folder):
    return gaps_of(spark, folder).filter("category = 'rate-limiting'").select(*GAP_COLUMNS)


@query(
    "control_gaps",
    routes(
        select="""SELECT repo, file, line, pos, method || ' ' || path AS endpoint,
          CASE WHEN auth_required THEN 'yes' ELSE '?' END AS auth_required,
          CASE WHEN auth_required THEN 'yes' ELSE '?' END AS authorization_checked,
          CASE WHEN rate_limited THEN 'yes' ELSE '?' END AS rate_limited,
          CASE WHEN input_validated THEN 'yes' ELSE '?' END AS input_validated,
          CASE WHEN sensitive THEN 'yes' ELSE 'no' END AS sensitive FROM inventory"""
    ),
)
def control_gaps(spark, folder):
    return findings.control_gaps(
        scanners.api_inventory(discovery.endpoints(views.route_files(spark, folder)))
    )


@query("config_risks", with_views(views.CONFIG_SQL, select="SELECT * FROM config"))
def config_risks(spark, folder):
    lines = source.lines_matching(views.config_source_files(spark, folder), scanners.CONFIG_LINE)
    return scanners.config_hits(lines)


@query("floating_versions", manifests(select="SELECT repo, path, block_no, CAST(0 AS INTEGER) AS pos, dep, range FROM floating"))
def floating_versions(spark, folder):
    return scanners.floating_versions(
        discovery.package_manifests(views.manifest_files(spark, folder))
    )


@query("bad_manifests", manifests(select="SELECT repo, path FROM bad"))
def bad_manifests(spark, folder):
    return scanners.bad_manifests(
        discovery.package_manifests(views.manifest_files(spark, folder))
    )


@query("missing_lockfile", manifests(select="SELECT repo, path FROM unlocked"))
def missing_lockfile(spark, folder):
    return scanners.missing_lockfiles(views.manifest_files(spark, folder))


def api_labels(files):
    return discovery.manifest_facts(files).filter("concern = 'api_framework'")


@query(
    "no_authz_repos",
    manifests(
        select="""SELECT DISTINCT repo FROM (SELECT repo, concern FROM node_facts UNION ALL SELECT repo, concern FROM other_facts)
          WHERE concern = 'api_framework' AND repo NOT IN (SELECT repo FROM root WHERE c % 4 = 0)"""
    ),
)
def no_authz_repos(spark, folder):
    files = stored_application(spark, folder)
    return scanners.repos_without(
        api_labels(files), scanners.with_content_match(files, V.AUTHORIZATION_TOKEN)
    )


@query(
    "no_security_headers",
    manifests(
        select="""SELECT DISTINCT repo FROM node_facts WHERE concern = 'api_framework'
          AND label IN ('Express', 'Fastify', 'Koa') AND repo NOT IN (SELECT repo FROM root WHERE c % 5 = 0)"""
    ),
)
def no_security_headers(spark, folder):
    files = stored_application(spark, folder)
    using = api_labels(files).filter(scanners.is_header_framework(F.col("label")))
    return scanners.repos_without(using, scanners.with_content_match(files, V.HEADER_MECHANISM))


@query(
    "missing_tests",
    manifests(
        select=f"""SELECT root.repo, t.tools IS NOT NULL AS has_tests,
          CASE WHEN t.tools IS NULL THEN '{V.NO_TESTS_TEXT}'
            ELSE '{V.TESTS_TEXT_HEAD}' || t.tools || '{V.TESTS_TEXT_TAIL}' END AS posture
        FROM root LEFT JOIN (SELECT repo, string_agg(label, ', ' ORDER BY label) AS tools FROM (
          SELECT repo, label FROM node_facts WHERE concern = 'test_framework'
          UNION SELECT repo, label FROM other_facts WHERE concern = 'test_framework') GROUP BY repo) t
        ON root.repo = t.repo"""
    ),
)
def missing_tests(spark, folder):
    files = stored_application(spark, folder)
    known = discovery.manifest_facts(files).unionByName(discovery.test_conventions(files))
    return findings.missing_tests(files, known)
