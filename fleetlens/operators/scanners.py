"""In-house scanners: from lines, manifests and labels to findings.

A scanner is any function ``scan(evidence) -> hits``; ``SCANNERS`` lists the built-in ones in
order and callers may append their own. ``Evidence`` holds the tables they may read. Hits are
findings without an id: they name their ``area`` and the columns ``part, file, line, k1, k2``
order them. ``identified`` numbers the hits of all scanners in one go.
"""

import re
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import any_of, basename, contains_any, explode_present
from ..functions.schemas import as_findings
from ..functions.tables import numbered, written
from ..sources.files import explode_lines, is_risky_config, is_route_file, is_text, lines_matching
from . import discovery


def union_pattern(patterns) -> str:
    """One pattern matching wherever any of the given ones does; inline flags stay local."""
    return "|".join(f"(?:{p})" for p in patterns)


SECRET_LINE = V.led_by("-AtTsSaApP", union_pattern(p for _, p in V.SECRET_RULES))
CONFIG_LINE = V.led_by("rRNAodDsShH", union_pattern(p for _, _, p, _ in V.CONFIG_RULES))


# --- one pass over file contents -------------------------------------------------------------

@dataclass
class Evidence:
    """What the scanners read. ``signals`` is small: contents were dropped in the one pass."""

    files: DataFrame
    signals: DataFrame
    extra: dict = field(default_factory=dict)

    @property
    def lines(self) -> DataFrame:
        return self.signals.filter("line IS NOT NULL").select("repo", "path", "line_no", "line")

    @property
    def manifests(self) -> DataFrame:
        return self.signals.filter("manifest IS NOT NULL").select(
            "repo", "path", F.col("manifest").alias("content")
        )

    @property
    def endpoints(self) -> DataFrame:
        return discovery.route_calls(self.lines)

    @cached_property
    def api_labels(self) -> DataFrame:
        """API frameworks per repository, written once: two scanners and the report read them."""
        known = discovery.manifest_facts(self.manifests).filter("concern = 'api_framework'")
        return written(known.select("repo", "label"), "labels")


def collect(files: DataFrame) -> Evidence:
    """Read every content once and keep only what scanners can use.

    The written table has, per file, its two whole-file marks and its text if it is a manifest,
    and per line that some line rule may hit, that line. Lines are only made for files in which
    such a rule matches.
    """
    path, content = F.col("path"), F.col("content")
    # What applies to a file is decided once, not again for each of its lines.
    kinds = files.select(
        "repo",
        "path",
        "content",
        is_text(path).alias("text"),
        is_route_file(path).alias("routes"),
        is_risky_config(path).alias("config"),
        basename(path).isin(discovery.READ_MANIFESTS).alias("manifest"),
    ).filter("text OR routes OR manifest")
    rules = {"routes": V.ROUTE_CALL, "config": CONFIG_LINE, "text": SECRET_LINE}

    def hit(column: Column) -> Column:
        return any_of(F.col(kind) & column.rlike(pattern) for kind, pattern in rules.items())

    # A filter is not pushed below a generator, so each pattern stands in the plan once.
    marks = F.struct(
        (F.col("text") & content.rlike(V.AUTHORIZATION_TOKEN)).alias("authorizes"),
        (F.col("text") & content.rlike(V.HEADER_MECHANISM)).alias("hardens"),
        F.when(F.col("manifest"), content).alias("manifest_text"),
        F.when(hit(content), F.split(content, V.LINE_BREAK)).alias("rows"),
    )
    marked = kinds.select("repo", "path", *rules, F.inline(F.array(marks))).withColumnRenamed(
        "manifest_text", "manifest"
    ).filter("authorizes OR hardens OR manifest IS NOT NULL OR rows IS NOT NULL")
    # Row 0 stands for the file itself, the others for its lines.
    rows = F.concat(F.expr("array(CAST(NULL AS STRING))"), F.coalesce("rows", F.expr("CAST(array() AS ARRAY<STRING>)")))
    fanned = marked.select(
        "repo", "path", *rules, "authorizes", "hardens", "manifest",
        F.posexplode(rows).alias("line_no", "line"),
    ).filter((F.col("line_no") == 0) | hit(F.col("line")))

    def of_file(name):
        return F.when(F.col("line_no") == 0, F.col(name)).alias(name)

    signals = fanned.select(
        "repo", "path", of_file("authorizes"), of_file("hardens"), of_file("manifest"),
        F.when(F.col("line_no") > 0, F.col("line_no")).alias("line_no"),
        "line",
    )
    return Evidence(files.select("repo", "path"), written(signals, "signals"))


# --- hits --------------------------------------------------------------------------------------

ORDER = ["part", "k1", "k2"]


def as_hits(rows: DataFrame, area: str, **fixed) -> DataFrame:
    """Lay rows out as hits of ``area``; ``fixed`` gives columns with one value for all."""
    columns = {name: F.lit(value) for name, value in {"part": 0, "k1": 0, "k2": 0, "id": ""}.items()}
    columns = {name: value for name, value in columns.items() if name not in rows.columns}
    columns.update({name: F.lit(value) for name, value in fixed.items()})
    columns["area"] = F.lit(area)
    return as_findings(rows.withColumns(columns), extra=["area", *ORDER])


def identified(hits: DataFrame) -> DataFrame:
    """Findings from hits: ids run from 1 per repository and area, in file and line order."""
    order = ["part", "file", "line", "k1", "k2"]
    ranked = numbered(written(hits, "hits"), ["repo", "area"], order)
    number = F.concat(F.lit("RG-"), "area", F.lit("-"), F.format_string("%03d", "n"))
    return as_findings(ranked.withColumn("id", number))


# --- secrets ---------------------------------------------------------------------------------

def secret_hits(lines: DataFrame) -> DataFrame:
    """Live-looking credentials per line: kind, digest and length, never the value itself."""
    keys = [c for c in lines.columns if c != "line"]

    def values(kind, pattern):
        return F.transform(
            F.regexp_extract_all("line", F.lit(pattern), F.lit(1)),
            lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value")),
        )

    found = [values(kind, pattern) for kind, pattern in V.SECRET_RULES]
    return (
        lines.filter(F.col("line").rlike(SECRET_LINE))
        .select(*keys, F.posexplode(F.concat(*found)).alias("pos", "hit"))
        .filter(~F.col("hit.value").rlike(V.SECRET_PLACEHOLDER))
        .select(
            *keys,
            "pos",
            F.col("hit.kind").alias("kind"),
            F.sha2("hit.value", 256).alias("secret_sha256"),
            F.char_length("hit.value").alias("secret_length"),
        )
    )


def secrets(evidence: Evidence) -> DataFrame:
    hits = secret_hits(evidence.lines.filter(is_text(F.col("path"))))
    return as_hits(
        hits.select(
            "repo",
            F.concat(F.lit("Possible hardcoded secret ("), "kind", F.lit(")")).alias("title"),
            F.col("path").alias("file"),
            F.col("line_no").alias("line"),
            F.col("pos").alias("k1"),
            F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("evidence"),
        ),
        "SECRET",
        severity="high",
        category="secrets",
        status="potential",
        confidence=50,
        description=V.SECRET_DESCRIPTION,
        impact=V.SECRET_IMPACT,
        recommended_fix=V.SECRET_FIX,
        source="scanner:secrets",
    )


# --- dependencies ----------------------------------------------------------------------------

def floating_versions(manifests: DataFrame) -> DataFrame:
    """Dependencies whose range is exactly ``*`` or ``latest``. Peer dependencies do not count."""
    def entries(order, block):
        found = F.coalesce(
            F.map_entries(block), F.array().cast("array<struct<key:string,value:string>>")
        )
        return F.transform(
            found,
            lambda e, i: F.struct(
                F.lit(order).alias("block_no"),
                i.alias("pos"),
                e["key"].alias("dep"),
                e["value"].alias("range"),
            ),
        )

    blocks = [entries(n, b) for n, b in enumerate(discovery.DEPENDENCY_BLOCKS[:2])]
    return (
        manifests.select("repo", "path", F.explode(F.concat(*blocks)).alias("d"))
        .select("repo", "path", "d.*")
        .filter(F.col("range").isin("*", "latest"))
    )


def bad_manifests(manifests: DataFrame) -> DataFrame:
    """package.json files with text that is not JSON. Empty files are skipped."""
    return manifests.filter((F.col("content") != "") & ~F.col("valid")).select("repo", "path")


def missing_lockfiles(paths: DataFrame) -> DataFrame:
    """Repositories with a package.json but no Node lockfile anywhere, and their first manifest."""
    base = basename(F.col("path"))
    per_repo = paths.groupBy("repo").agg(
        F.min(F.when(base == "package.json", F.col("path"))).alias("path"),
        F.bool_or(base.isin(V.NODE_LOCKFILES)).alias("locked"),
    )
    return per_repo.filter("path IS NOT NULL AND NOT locked").select("repo", "path")


def dependencies(evidence: Evidence) -> DataFrame:
    manifests = discovery.package_manifests(evidence.manifests)
    shared = {"severity": "low", "category": "dependency", "source": "scanner:dependencies"}
    bad = as_hits(
        bad_manifests(manifests).select(
            "repo",
            F.col("path").alias("file"),
            F.concat(F.lit("Unparseable manifest "), "path").alias("title"),
        ),
        "DEP",
        status="manual-verification",
        confidence=40,
        description=V.BAD_MANIFEST_DESCRIPTION,
        **shared,
    )
    floating = as_hits(
        floating_versions(manifests).select(
            "repo",
            F.col("path").alias("file"),
            F.col("block_no").alias("k1"),
            F.col("pos").alias("k2"),
            F.format_string('Floating version for "%s" (%s)', "dep", "range").alias("title"),
            F.format_string('Dependency "%s" uses an unpinned range "%s".', "dep", "range").alias(
                "description"
            ),
        ),
        "DEP",
        status="potential",
        confidence=60,
        impact=V.FLOATING_IMPACT,
        recommended_fix=V.FLOATING_FIX,
        **shared,
    )
    unlocked = as_hits(
        missing_lockfiles(evidence.files).select("repo", F.col("path").alias("file")),
        "DEP",
        part=1,
        title=V.NO_LOCKFILE_TITLE,
        status="potential",
        confidence=65,
        description=V.NO_LOCKFILE_DESCRIPTION,
        impact=V.NO_LOCKFILE_IMPACT,
        recommended_fix=V.NO_LOCKFILE_FIX,
        **shared,
    )
    return bad.unionByName(floating).unionByName(unlocked)


# --- routes ----------------------------------------------------------------------------------

def is_sensitive(path: Column) -> Column:
    return contains_any(F.lower(path), V.SENSITIVE_HINTS)


def api_inventory(route_calls: DataFrame) -> DataFrame:
    """Controls visible on the registration line: true, or NULL for "cannot tell"; never false."""
    def seen(pattern):
        return F.when(F.col("text").rlike(pattern), F.lit(True))

    return route_calls.select(
        "repo",
        "method",
        "path",
        "file",
        "line",
        "pos",
        seen(V.AUTH_CONTROL).alias("auth_required"),
        seen(V.AUTH_CONTROL).alias("authorization_checked"),
        seen(V.RATE_CONTROL).alias("rate_limited"),
        seen(V.VALIDATION_CONTROL).alias("input_validated"),
        is_sensitive(F.col("path")).alias("sensitive"),
        F.lit(V.INVENTORY_NOTE).alias("notes"),
    )


ROUTE_GAPS = [
    # kind, control, severity, category, title, description, impact, trigger, fix
    (0, "auth_required", "high", "api-security", V.NO_AUTH_TITLE, V.NO_AUTH_DESCRIPTION,
     V.NO_AUTH_IMPACT, V.NO_AUTH_TRIGGER, V.NO_AUTH_FIX),
    (1, "rate_limited", "medium", "rate-limiting", V.NO_RATE_TITLE, V.NO_RATE_DESCRIPTION,
     V.NO_RATE_IMPACT, "", V.NO_RATE_FIX),
]


def route_gaps(inventory: DataFrame) -> DataFrame:
    """Sensitive endpoints without visible authentication, or without visible rate limiting."""
    endpoint = F.concat_ws(" ", "method", "path")
    gaps = [
        F.when(
            F.col(control).isNull(),
            F.struct(
                F.lit(kind).alias("kind"),
                F.concat(F.lit(title), endpoint).alias("title"),
                F.lit(severity).alias("severity"),
                F.lit(category).alias("category"),
                F.lit(description).alias("description"),
                F.lit(impact).alias("impact"),
                F.lit(trigger).alias("trigger_condition"),
                F.lit(fix).alias("recommended_fix"),
            ),
        )
        for kind, control, severity, category, title, description, impact, trigger, fix in ROUTE_GAPS
    ]
    keep = ["repo", "file", "line", "pos", endpoint.alias("endpoint")]
    found = explode_present(inventory.filter("sensitive"), keep, gaps, "gap")
    return found.select("repo", "file", "line", "pos", "endpoint", "gap.*")


def routes(evidence: Evidence) -> DataFrame:
    gaps = route_gaps(api_inventory(evidence.endpoints))
    return as_hits(
        gaps.withColumnsRenamed({"pos": "k1", "kind": "k2"}).withColumn(
            "evidence", F.concat_ws(":", "file", F.col("line").cast("string"))
        ),
        "API",
        status="potential",
        confidence=45,
        source="scanner:routes",
    )


# --- permissions and headers -----------------------------------------------------------------

def repos_without(candidates: DataFrame, marked: DataFrame) -> DataFrame:
    """Candidate repositories that no marked row belongs to. Both sides are made distinct first."""
    return (
        candidates.select("repo").distinct().join(marked.select("repo").distinct(), "repo", "left_anti")
    )


def with_content_match(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(is_text(F.col("path")) & F.col("content").rlike(pattern)).select("repo")


def is_header_framework(label: Column) -> Column:
    return contains_any(label, V.HEADER_FRAMEWORKS)


def permissions(evidence: Evidence) -> DataFrame:
    exposed = evidence.api_labels.select("repo").unionByName(evidence.endpoints.select("repo"))
    lacking = repos_without(exposed, evidence.signals.filter("authorizes"))
    return as_hits(
        lacking,
        "AUTHZ",
        title=V.NO_AUTHZ_TITLE,
        severity="high",
        category="authorization",
        status="manual-verification",
        confidence=40,
        description=V.NO_AUTHZ_DESCRIPTION,
        impact=V.NO_AUTHZ_IMPACT,
        trigger_condition=V.NO_AUTHZ_TRIGGER,
        recommended_fix=V.NO_AUTHZ_FIX,
        source="scanner:permissions",
    )


def security_headers(evidence: Evidence) -> DataFrame:
    using = evidence.api_labels.filter(is_header_framework(F.col("label")))
    lacking = repos_without(using, evidence.signals.filter("hardens"))
    return as_hits(
        lacking,
        "HDR",
        title=V.NO_HEADERS_TITLE,
        severity="medium",
        category="security",
        status="potential",
        confidence=50,
        description=V.NO_HEADERS_DESCRIPTION,
        impact=V.NO_HEADERS_IMPACT,
        recommended_fix=V.NO_HEADERS_FIX,
        source="scanner:security-headers",
    )


# --- configuration and custom rules ------------------------------------------------------------

def rule_hits(lines: DataFrame, rules, first: int = 0) -> DataFrame:
    """Apply (label, severity, pattern, fix) rules to lines; a line may hit several.

    Each pattern is a literal, so it is compiled once per task, not once per line and rule.
    """
    keys = [c for c in lines.columns if c != "line"]
    hits = [
        F.when(
            F.col("line").rlike(pattern),
            F.struct(
                F.lit(n).alias("rule_no"),
                F.lit(label).alias("label"),
                F.lit(severity).alias("severity"),
                F.lit(fix).alias("fix"),
            ),
        )
        for n, (label, severity, pattern, fix) in enumerate(rules, first)
    ]
    return explode_present(lines, keys, hits, "hit").select(*keys, "hit.*")


def config_hits(lines: DataFrame) -> DataFrame:
    return rule_hits(lines.filter(is_risky_config(F.col("path"))), V.CONFIG_RULES)


def configuration(evidence: Evidence) -> DataFrame:
    return as_hits(
        config_hits(evidence.lines).select(
            "repo",
            "severity",
            F.concat_ws(" in ", "label", "path").alias("title"),
            F.col("path").alias("file"),
            F.col("line_no").alias("line"),
            F.col("rule_no").alias("k1"),
            F.format_string("Configuration pattern detected: %s.", "label").alias("description"),
            F.concat_ws(":", "path", F.col("line_no").cast("string")).alias("evidence"),
            F.col("fix").alias("recommended_fix"),
        ),
        "CONF",
        category="configuration",
        status="potential",
        confidence=55,
        source="scanner:configuration",
    )


#: Custom rules that one pass over the files applies.
RULES_PER_PASS = 200
CLASS = re.compile(r"\[\^?\]?[^\]]*\]")
ANCHORED = re.compile(r"[\^$]|\\[AzZG]|\(\?<?[=!]")
BACK_REFERENCE = re.compile(r"\\[1-9]|\\k<")


def load_rules(rules: DataFrame) -> list[tuple]:
    """Read a rule table (label, severity, pattern, fix) to the driver, in the order of all its columns."""
    fields = ["label", "severity", "pattern", "fix"]
    return [tuple(r) for r in rules.select(*fields).orderBy(*fields).collect()]


def custom_rules(files: DataFrame, rules) -> DataFrame:
    """Scan ``files`` with rules given as data, however many.

    Only lines that some rule of a batch matches meet the rules one by one. Where no rule of the
    batch looks at the edges of a line, files without any match are dropped before their lines are made.
    Patterns that refer back to a group can't be joined with others, so their batch goes without both.
    """
    rules = list(rules) or [("", "", "(?!)", "")]  # no rules: one that never matches
    passes = []
    for first in range(0, len(rules), RULES_PER_PASS):
        batch = rules[first : first + RULES_PER_PASS]
        patterns = [pattern for _, _, pattern, _ in batch]
        every = union_pattern(patterns)
        if any(BACK_REFERENCE.search(p) for p in patterns):
            lines = explode_lines(files)
        elif any(ANCHORED.search(CLASS.sub("", p)) for p in patterns):
            lines = explode_lines(files).filter(F.col("line").rlike(every))
        else:
            lines = lines_matching(files, every).filter(F.col("line").rlike(every))
        passes.append(rule_hits(lines, batch, first))
    return reduce(DataFrame.unionByName, passes)


# --- all scanners ------------------------------------------------------------------------------

SCANNERS = [
    ("secrets", secrets),
    ("dependencies", dependencies),
    ("routes", routes),
    ("permissions", permissions),
    ("configuration", configuration),
    ("security-headers", security_headers),
]


def seed_findings(evidence: Evidence, ingested=(), scanners=None) -> DataFrame:
    """Findings of all scanners, then of the ingested tool outputs."""
    hits = [scan(evidence) for _, scan in (scanners or SCANNERS)]
    found = identified(reduce(DataFrame.unionByName, hits))
    return reduce(DataFrame.unionByName, ingested, found)


def scanner_summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings per repository and source; the in-house scanners show even with none."""
    counts = findings.groupBy("repo", "source").agg(F.count("*").alias("findings"))
    names = F.array(*[F.lit(f"scanner:{n}") for n, _ in SCANNERS])
    expected = repos.select("repo").distinct().select("repo", F.explode(names).alias("source"))
    external = counts.filter(~F.col("source").startswith("scanner:"))
    return (
        expected.join(counts, ["repo", "source"], "left")
        .select("repo", "source", F.coalesce("findings", F.lit(0)).alias("findings"))
        .unionByName(external)
    )
