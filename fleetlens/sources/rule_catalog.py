"""Rule catalogue: 14 packs with 69 checks, and the bypasses to try."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import lookup

# Fixed values: (pack_dir, pack, category, check_id, severity, title), in playbook order.
RULES = [
    ("security", "authentication", "authentication", "AUTHN-001", "high", "Protected routes verify identity on every request"),
    ("security", "authentication", "authentication", "AUTHN-002", "critical", "Passwords stored with a strong salted hash"),
    ("security", "authentication", "authentication", "AUTHN-003", "high", "JWT signature verified and algorithm pinned"),
    ("security", "authentication", "authentication", "AUTHN-004", "medium", "Sessions/tokens expire, rotate, and can be revoked"),
    ("security", "authentication", "authentication", "AUTHN-005", "high", "MFA/OTP flows are replay-safe and single-use"),
    ("security", "authentication", "authentication", "AUTHN-006", "high", "Account recovery does not enable enumeration or takeover"),
    ("security", "authorization", "authorization", "AUTHZ-001", "high", "Permission checks on every state-changing and data-reading route"),
    ("security", "authorization", "authorization", "AUTHZ-002", "high", "Object-level authorization (IDOR prevention)"),
    ("security", "authorization", "authorization", "AUTHZ-003", "high", "No privilege escalation via mass assignment"),
    ("security", "authorization", "authorization", "AUTHZ-004", "critical", "Tenant isolation enforced in multi-tenant systems"),
    ("security", "authorization", "authorization", "AUTHZ-005", "high", "Admin routes gated by admin checks"),
    ("security", "authorization", "authorization", "AUTHZ-006", "medium", "Authorization enforced server-side, never in the client"),
    ("security", "file-upload", "security", "UP-001", "high", "Upload content type and extension validated (allowlist)"),
    ("security", "file-upload", "security", "UP-002", "medium", "Upload size limits enforced"),
    ("security", "file-upload", "security", "UP-003", "high", "Stored files are not executable and served safely"),
    ("security", "file-upload", "security", "UP-004", "high", "Path traversal prevented in file paths"),
    ("security", "file-upload", "security", "UP-005", "medium", "Upload endpoints are rate limited"),
    ("security", "injection", "security", "INJ-001", "critical", "SQL/NoSQL injection"),
    ("security", "injection", "security", "INJ-002", "critical", "OS command injection"),
    ("security", "injection", "security", "INJ-003", "high", "Template / SSTI injection"),
    ("security", "injection", "security", "INJ-004", "high", "Cross-site scripting (XSS)"),
    ("security", "injection", "security", "INJ-005", "high", "Insecure deserialization"),
    ("security", "injection", "security", "INJ-006", "medium", "LDAP / XPath / header injection"),
    ("security", "sensitive-data", "security", "DATA-001", "high", "No sensitive fields over-exposed in responses"),
    ("security", "sensitive-data", "security", "DATA-002", "medium", "PII/secrets encrypted at rest where required"),
    ("security", "sensitive-data", "security", "DATA-003", "medium", "No information leakage in errors"),
    ("security", "sensitive-data", "security", "DATA-004", "high", "SSRF protection on server-side fetches"),
    ("security", "sensitive-data", "security", "DATA-005", "medium", "Safe redirects (no open redirect)"),
    ("api", "cors", "api-security", "CORS-001", "high", "No wildcard origin with credentials"),
    ("api", "cors", "api-security", "CORS-002", "medium", "Origin allowlist is explicit"),
    ("api", "cors", "api-security", "CORS-003", "low", "Allowed methods/headers are minimal"),
    ("api", "cors", "api-security", "CORS-004", "high", "CSRF protection where cookies authenticate requests"),
    ("api", "error-responses", "api-security", "ERR-001", "medium", "No stack traces or internal details in responses"),
    ("api", "error-responses", "api-security", "ERR-002", "low", "Consistent error shape and status codes"),
    ("api", "error-responses", "api-security", "ERR-003", "medium", "No user enumeration via differential errors/timing"),
    ("api", "error-responses", "api-security", "ERR-004", "medium", "Errors do not leave the system in an inconsistent state"),
    ("api", "pagination", "api-security", "PAG-001", "medium", "List endpoints enforce a maximum page size"),
    ("api", "pagination", "api-security", "PAG-002", "low", "Pagination parameters validated"),
    ("api", "pagination", "api-security", "PAG-003", "high", "Pagination respects authorization scope"),
    ("api", "pagination", "api-security", "PAG-004", "medium", "Cursor/token pagination is not guessable across users"),
    ("api", "rate-limiting", "rate-limiting", "RL-001", "high", "Sensitive operations have a server-side limiter"),
    ("api", "rate-limiting", "rate-limiting", "RL-002", "medium", "Limits keyed after caller identification"),
    ("api", "rate-limiting", "rate-limiting", "RL-003", "high", "Distributed deployments use shared storage"),
    ("api", "request-limits", "api-security", "REQ-001", "medium", "Request body size limit enforced"),
    ("api", "request-limits", "api-security", "REQ-002", "medium", "File upload size limits enforced"),
    ("api", "request-limits", "api-security", "REQ-003", "medium", "Array/collection input length bounded"),
    ("api", "request-limits", "api-security", "REQ-004", "medium", "Timeouts on inbound and outbound requests"),
    ("api", "request-limits", "api-security", "REQ-005", "low", "JSON depth / complexity bounded"),
    ("quality", "bugs", "bug", "BUG-001", "medium", "Null/undefined dereference"),
    ("quality", "bugs", "bug", "BUG-002", "medium", "Off-by-one and boundary errors"),
    ("quality", "bugs", "bug", "BUG-003", "medium", "Inverted or incorrect conditionals"),
    ("quality", "bugs", "bug", "BUG-004", "high", "Incorrect money/time/timezone/rounding handling"),
    ("quality", "bugs", "bug", "BUG-005", "medium", "Resource leaks"),
    ("quality", "bugs", "bug", "BUG-006", "low", "Serialization/type coercion mismatches"),
    ("quality", "error-handling", "bug", "EH-001", "medium", "No silently swallowed errors"),
    ("quality", "error-handling", "bug", "EH-002", "medium", "Async errors awaited and handled"),
    ("quality", "error-handling", "bug", "EH-003", "low", "Correct error mapping to responses/states"),
    ("quality", "error-handling", "bug", "EH-004", "medium", "Cleanup on failure paths"),
    ("quality", "error-handling", "bug", "EH-005", "low", "Retries are bounded and safe"),
    ("quality", "race-conditions", "bug", "RACE-001", "high", "Check-then-act on shared state"),
    ("quality", "race-conditions", "bug", "RACE-002", "high", "Non-atomic financial or inventory updates"),
    ("quality", "race-conditions", "bug", "RACE-003", "high", "TOCTOU in authorization or file access"),
    ("quality", "race-conditions", "bug", "RACE-004", "medium", "Idempotency for retried operations"),
    ("quality", "race-conditions", "bug", "RACE-005", "medium", "Shared mutable state without synchronization"),
    ("quality", "test-coverage", "test-coverage", "TEST-001", "medium", "A test framework is present and wired"),
    ("quality", "test-coverage", "test-coverage", "TEST-002", "medium", "Auth and authorization paths are tested"),
    ("quality", "test-coverage", "test-coverage", "TEST-003", "low", "Input validation and error paths are tested"),
    ("quality", "test-coverage", "test-coverage", "TEST-004", "medium", "Money/state-mutating logic is tested"),
    ("quality", "test-coverage", "test-coverage", "TEST-005", "informational", "Regression tests exist for known fixes"),
]

# Fixed values: (pack, bypass).
BYPASSES = [
    ("rate-limiting", "Changing X-Forwarded-For or other client-supplied proxy headers"),
    ("rate-limiting", "IPv6 address rotation (limiting a full /128 instead of a prefix)"),
    ("rate-limiting", "Rotating across multiple API keys or accounts"),
    ("rate-limiting", "Changing route case, trailing slash, or encoding"),
    ("rate-limiting", "Using an alternate endpoint that reaches the same handler"),
    ("rate-limiting", "Distributed deployment without shared counter storage"),
    ("rate-limiting", "Rate limits applied before user identification"),
    ("rate-limiting", "Limits enforced only in the frontend"),
    ("rate-limiting", "WebSocket messages that bypass HTTP-layer limits"),
    ("rate-limiting", "GraphQL query batching / multiple operations per request"),
    ("rate-limiting", "Multiple requests inside one batch endpoint"),
]


def catalog(spark: SparkSession, rules=None) -> DataFrame:
    """The checks as a local table with their place in the playbook."""
    rows = [(n, *rule) for n, rule in enumerate(rules or RULES)]
    fields = ["check_order", "pack_dir", "pack", "category", "check_id", "severity", "title"]
    return lookup(spark, fields, rows)


def checklist(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Every check with the number of active findings of its category and severity."""
    seen = (
        findings.filter("status <> 'rejected'")
        .groupBy("category", "severity")
        .agg(F.count("*").alias("active_findings"))
    )
    return rules.join(seen, ["category", "severity"], "left").select(
        "check_order", "pack_dir", "pack", "category", "check_id", "severity", "title",
        F.coalesce("active_findings", F.lit(0)).alias("active_findings"),
    )


def coverage(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Checks available for each category a repository has active findings in."""
    checks = rules.groupBy("category").agg(
        F.count("*").alias("checks"), F.count_distinct("pack").alias("packs")
    )
    seen = (
        findings.filter("status <> 'rejected'")
        .groupBy("repo", "category")
        .agg(F.count("*").alias("active_findings"))
    )
    return seen.join(checks, "category", "left").select(
        "repo", "category", "active_findings",
        F.coalesce("checks", F.lit(0)).alias("checks"),
        F.coalesce("packs", F.lit(0)).alias("packs"),
    )
