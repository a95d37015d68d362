"""External tool JSON to findings, one ingest function per tool.

A document is one row and its findings are numbered by their place in it. Slicing, removal of
repeats and numbering therefore happen inside the row with array functions: ingesting needs no
shuffle and does not care how many documents a repository has. A document that is not JSON, or
not of the expected shape, gives no rows.

Input rows have ``repo``, ``stdout`` and any further key columns, which are kept.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import filled, finding_id, line_number, normal_severity, text_or_empty
from ..functions.schemas import as_findings
from ..functions.tables import numbered, written
from ..sources.tool_output import outputs_of
from .discovery import STRICT_JSON


@dataclass(frozen=True)
class Limits:
    """How much of a document is taken; everything where a limit is None."""

    findings: int | None = None
    evidence_chars: int | None = None
    description_chars: int | None = None


UNLIMITED = Limits()
#: The limits that single audits customarily have.
CUSTOMARY = Limits(V.MAX_FINDINGS_PER_TOOL, V.EVIDENCE_CHARS, V.DESCRIPTION_CHARS)


def _first(items, most: int | None) -> Column:
    items = F.col(items) if isinstance(items, str) else items
    return items if most is None else F.slice(items, 1, most)


def _cut(text, most: int | None) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text if most is None else F.substring(text, 1, most)


def _keys(runs: DataFrame):
    return [c for c in runs.columns if c in ("repo", "run_id")]


def _parsed(text, schema) -> Column:
    return F.from_json(text, schema, STRICT_JSON)


def _opened(runs: DataFrame, keys, schema) -> DataFrame:
    """Documents parsed once into the columns of ``schema``, however often those are used."""
    return runs.select(*keys, F.inline(F.array(_parsed("stdout", schema))))


def _elements(items: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(items, F.array().cast(kind))


def _js_entries(mapping: str) -> Column:
    """Entries of a JSON object in JavaScript order: integer keys ascending, then as written."""
    return F.expr(
        f"""transform(array_sort(transform(map_entries({mapping}), (e, i) -> named_struct(
              'k', IF(e.key RLIKE '^(?:0|[1-9][0-9]{{0,8}})$', CAST(e.key AS LONG), 9223372036854775807),
              'i', i, 'e', e))), x -> x.e)"""
    )


def _findings(items: DataFrame, area: str, tool: str, keys, number: Column, **fields) -> DataFrame:
    """Lay parsed items out as findings with the shared defaults."""
    columns = {
        "status": F.lit("potential"),
        "confidence": F.lit(60),
        "source": F.lit(f"tool:{tool}"),
        **fields,
    }
    rows = items.select(
        *keys,
        number.cast("long").alias("ordinal"),
        finding_id(area, number).alias("id"),
        *[value.alias(name) for name, value in columns.items()],
    )
    return as_findings(rows, extra=[*[k for k in keys if k != "repo"], "ordinal"])


def semgrep(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    keys = _keys(runs)
    results = _parsed("stdout", "results array<string>")["results"]
    items = runs.select(*keys, F.posexplode(_first(results, limits.findings)).alias("pos", "item")).select(
        *keys,
        "pos",
        _parsed(
            "item",
            "check_id string, path string, start struct<line:string>, extra struct<severity:string, "
            "message:string, metadata:struct<shortlink:string>>",
        ).alias("r"),
    )
    check, message = F.col("r.check_id"), F.col("r.extra.message")
    short = F.substring_index(check, ".", -1)
    return _findings(
        items, "SEMGREP", "semgrep", keys, F.col("pos") + 1,
        title=F.concat(F.lit("semgrep: "), F.coalesce(filled(short), check, F.lit(""))),
        severity=normal_severity(F.col("r.extra.severity")),
        category=F.lit("security"),
        file=filled(F.col("r.path")),
        line=line_number(F.col("r.start.line")),
        description=F.coalesce(filled(F.col("r.extra.metadata.shortlink")), message, F.lit("")),
        evidence=text_or_empty(message),
    )


def gitleaks(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    keys = _keys(runs)
    leaks = _parsed("stdout", "array<string>")
    items = runs.select(*keys, F.posexplode(_first(leaks, limits.findings)).alias("pos", "item")).select(
        *keys,
        "pos",
        _parsed(
            "item", "RuleID string, Description string, File string, StartLine string, Match string"
        ).alias("r"),
    )
    rule, text = F.col("r.RuleID"), F.col("r.Description")
    return _findings(
        items, "GITLEAKS", "gitleaks", keys, F.col("pos") + 1,
        title=F.concat(F.lit("Secret: "), F.coalesce(filled(rule), filled(text), F.lit("leak"))),
        severity=F.lit("high"),
        category=F.lit("secrets"),
        file=filled(F.col("r.File")),
        line=line_number(F.col("r.StartLine")),
        description=text_or_empty(text),
        evidence=_cut(text_or_empty(F.col("r.Match")), limits.evidence_chars),
        impact=F.lit(V.LEAK_IMPACT),
        recommended_fix=F.lit(V.LEAK_FIX),
    )


ADVISORY = "module_name string, title string, severity string, overview string, url string"


def _advisory_title(r: str) -> Column:
    return F.concat(
        F.lit("Vulnerable dependency: "),
        text_or_empty(F.col(f"{r}.module_name")),
        F.lit(" — "),
        text_or_empty(F.col(f"{r}.title")),
    )


def npm_vulnerabilities(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    """Packages of the version 7 layout. The first object in ``via`` names the advisory."""
    keys = _keys(runs)
    packages = _opened(runs, keys, "vulnerabilities map<string,string>")
    entries = _first(_js_entries("vulnerabilities"), limits.findings)
    items = packages.select(*keys, F.posexplode(entries).alias("pos", "e")).select(
        *keys,
        "pos",
        F.col("e.key").alias("name"),
        _parsed(
            "e.value", "severity string, range string, via array<string>, fixAvailable string"
        ).alias("r"),
    )
    # ``via`` mixes plain names with objects, so its elements are kept as text until here.
    objects = F.filter(_elements(F.col("r.via")), lambda v: v.isNull() | v.rlike(r"^[{\[]"))
    via = _parsed(F.get(objects, F.lit(0)), "title string, url string")
    items = items.withColumn("via", via)
    title = filled(F.col("via.title"))
    fixable = F.coalesce(~F.col("r.fixAvailable").isin("false", "0", ""), F.lit(False))
    return _findings(
        items, "NPM", "npm-audit", keys, F.col("pos") + 1,
        title=F.concat(
            F.lit("Vulnerable dependency: "),
            "name",
            F.coalesce(F.concat(F.lit(" — "), title), F.lit("")),
        ),
        severity=normal_severity(F.col("r.severity")),
        category=F.lit("dependency"),
        description=F.concat(
            F.lit('npm audit flagged "'), "name", F.lit('" (range: '),
            text_or_empty(F.col("r.range")), F.lit(")."),
        ),
        evidence=text_or_empty(F.col("via.url")),
        recommended_fix=F.when(fixable, F.lit(V.FIX_AVAILABLE)).otherwise(F.lit(V.NO_FIX_AVAILABLE)),
    )


def npm_advisories(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    """Advisories of the version 6 layout, limited on their own, numbered after version 7 rows."""
    keys = _keys(runs)
    both = _opened(runs, keys, "vulnerabilities map<string,string>, advisories map<string,string>")
    before = F.coalesce(F.cardinality("vulnerabilities"), F.lit(0))
    if limits.findings is not None:
        before = F.least(before, F.lit(limits.findings))
    items = both.select(
        *keys,
        before.alias("before"),
        F.posexplode(_first(_js_entries("advisories"), limits.findings)).alias("pos", "e"),
    ).select(*keys, "before", "pos", _parsed("e.value", ADVISORY).alias("r"))
    return _findings(
        items, "NPM", "npm-audit", keys, F.col("before") + F.col("pos") + 1,
        title=_advisory_title("r"),
        severity=normal_severity(F.col("r.severity")),
        category=F.lit("dependency"),
        description=_cut(text_or_empty(F.col("r.overview")), limits.description_chars),
        evidence=text_or_empty(F.col("r.url")),
    )


def npm_audit(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    return npm_vulnerabilities(runs, limits).unionByName(npm_advisories(runs, limits))


def pnpm_audit(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    keys = _keys(runs)
    advisories = _opened(runs, keys, "advisories map<string,string>")
    items = advisories.select(
        *keys, F.posexplode(_first(_js_entries("advisories"), limits.findings)).alias("pos", "e")
    ).select(*keys, "pos", _parsed("e.value", ADVISORY).alias("r"))
    text = F.coalesce(filled(F.col("r.overview")), F.col("r.title"), F.lit(""))
    return _findings(
        items, "PNPM", "pnpm-audit", keys, F.col("pos") + 1,
        title=_advisory_title("r"),
        severity=normal_severity(F.col("r.severity")),
        category=F.lit("dependency"),
        description=_cut(text, limits.description_chars),
        evidence=text_or_empty(F.col("r.url")),
    )


OPTIONS = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in STRICT_JSON.items()) + ")"


def _each(items: str, schema: str) -> str:
    """SQL of the elements of a JSON text array, each parsed on its own: an odd one becomes NULL and the others stay."""
    return f"transform({items}, x -> from_json(x, '{schema}', {OPTIONS}))"


# Vulnerabilities of all packages in document order, each with the key that makes it unique.
OSV_LISTED = f"""flatten(transform({_each("results", "packages array<string>")}, r -> coalesce(flatten(transform(
    transform({_each("r.packages", "package string, vulnerabilities array<string>")}, p -> named_struct(
      'of', from_json(p.package, 'ecosystem string, name string, version string', {OPTIONS}),
      'vulnerabilities', p.vulnerabilities)),
    p -> coalesce(transform(
      {_each("p.vulnerabilities", "id string, summary string, database_specific struct<severity:string>")},
      v -> named_struct(
        'key', concat_ws(':', coalesce(p.of.ecosystem, ''), coalesce(p.of.name, ''),
                         coalesce(p.of.version, ''), coalesce(v.id, '')),
        'name', coalesce(p.of.name, ''), 'version', coalesce(p.of.version, ''),
        'id', coalesce(v.id, ''), 'summary', coalesce(v.summary, ''),
        'severity', v.database_specific.severity)), array()))), array())))"""
# The first of each key. Sorting by (key, place) puts repeats next to each other, so a document
# of n vulnerabilities costs n log n and stays in its row.
OSV_SORTED = "array_sort(transform(listed, (v, i) -> named_struct('key', v.key, 'i', i, 'v', v)))"
OSV_FIRSTS = """array_sort(transform(
    filter(placed, (s, n) -> n = 0 OR s.key <> get(placed, n - 1).key),
    s -> named_struct('i', s.i, 'v', s.v)))"""


def osv_scanner(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    """Vulnerabilities per package; the same advisory for the same package version counts once."""
    keys = _keys(runs)

    def opened(rows: DataFrame, expression: str, name: str) -> DataFrame:
        # Behind a generator, so that a later reference to it (Spark infers one from every explode) is not computed anew.
        return rows.selectExpr(*keys, f"inline(array(named_struct('{name}', {expression})))")

    listed = opened(_opened(runs, keys, "results array<string>"), OSV_LISTED, "listed")
    firsts = opened(opened(listed, OSV_SORTED, "placed"), OSV_FIRSTS, "firsts")
    items = firsts.select(
        *keys, F.posexplode(_first("firsts", limits.findings)).alias("pos", "s")
    ).selectExpr(*keys, "pos", "s.v AS r")
    return _findings(
        items, "OSV", "osv-scanner", keys, F.col("pos") + 1,
        title=F.concat("r.name", F.lit("@"), "r.version", F.lit(": "), "r.id"),
        severity=normal_severity(F.col("r.severity")),
        category=F.lit("dependency"),
        description=_cut("r.summary", limits.description_chars),
        evidence=F.col("r.id"),
    )


TRIVY_RESULT = "Target string, Vulnerabilities array<string>, Secrets array<string>, Misconfigurations array<string>"
TRIVY_ITEMS = {
    "Vulnerabilities": "PkgName string, VulnerabilityID string, Severity string, Title string, Description string, "
    "PrimaryURL string",
    "Secrets": "RuleID string, Title string, Severity string, StartLine string",
    "Misconfigurations": "ID string, Title string, Severity string, Description string",
}


def trivy(runs: DataFrame, limits: Limits = UNLIMITED) -> DataFrame:
    """Per result: vulnerabilities, then secrets, then misconfigurations, under one shared limit."""
    keys = _keys(runs)
    none = F.lit(None).cast("string")

    def row(title, severity, category, target, line, description, evidence):
        return F.struct(
            title.alias("title"),
            severity.alias("severity"),
            F.lit(category).alias("category"),
            target.alias("file"),
            line.alias("line"),
            description.alias("description"),
            evidence.alias("evidence"),
        )

    kind = (
        "array<struct<title:string,severity:string,category:string,file:string,line:string,"
        "description:string,evidence:string>>"
    )

    def items_of(result):
        target = result["Target"]

        def items(name):
            return F.transform(result[name], lambda x: _parsed(x, TRIVY_ITEMS[name]))

        vulnerable = F.transform(
            items("Vulnerabilities"),
            lambda v: row(
                F.concat(text_or_empty(v["PkgName"]), F.lit(": "), text_or_empty(v["VulnerabilityID"])),
                v["Severity"], "dependency", target, none,
                F.coalesce(filled(v["Title"]), v["Description"], F.lit("")),
                text_or_empty(v["PrimaryURL"]),
            ),
        )
        leaked = F.transform(
            items("Secrets"),
            lambda s: row(
                F.concat(F.lit("Secret: "), F.coalesce(filled(s["RuleID"]), s["Title"], F.lit(""))),
                s["Severity"], "secrets", target, s["StartLine"],
                text_or_empty(s["Title"]), F.lit(""),
            ),
        )
        misconfigured = F.transform(
            items("Misconfigurations"),
            lambda m: row(
                F.trim(
                    F.concat(
                        F.lit("Misconfig: "), text_or_empty(m["ID"]), F.lit(" "), text_or_empty(m["Title"])
                    )
                ),
                m["Severity"], "configuration", target, none,
                text_or_empty(m["Description"]), F.lit(""),
            ),
        )
        return F.concat(
            _elements(vulnerable, kind), _elements(leaked, kind), _elements(misconfigured, kind)
        )

    # Level by level, so that an odd element costs itself and not the document.
    results = F.transform(
        _parsed("stdout", "Results array<string>")["Results"], lambda x: _parsed(x, TRIVY_RESULT)
    )
    flat = F.flatten(F.transform(results, items_of))
    items = runs.select(*keys, F.posexplode(_first(flat, limits.findings)).alias("pos", "r"))
    cut = F.when(
        F.col("r.category") == "secrets", F.col("r.description")
    ).otherwise(_cut("r.description", limits.description_chars))
    return _findings(
        items, "TRIVY", "trivy", keys, F.col("pos") + 1,
        title=F.col("r.title"),
        severity=normal_severity(F.col("r.severity")),
        category=F.col("r.category"),
        file=filled(F.col("r.file")),
        line=F.when(F.col("r.category") == "secrets", line_number(F.col("r.line"))),
        description=cut,
        evidence=F.col("r.evidence"),
    )


# Tool name to ingest function; callers may add their own.
INGESTERS = {
    "semgrep": semgrep,
    "gitleaks": gitleaks,
    "npm-audit": npm_audit,
    "pnpm-audit": pnpm_audit,
    "osv-scanner": osv_scanner,
    "trivy": trivy,
}


def ingest_all(scan_runs: DataFrame, ingesters=None, limits: Limits = UNLIMITED) -> DataFrame:
    """Findings of every completed run of every known tool; other tools give no rows.

    With ``limits``, every ingest function must take them as its second argument.
    """
    known = ingesters or INGESTERS
    more = () if limits == UNLIMITED else (limits,)
    return reduce(
        DataFrame.unionByName,
        [ingest(outputs_of(scan_runs, tool), *more) for tool, ingest in known.items()],
    )


def with_unique_ids(found: DataFrame) -> DataFrame:
    """Ids that run on over all documents of a tool in a repository, by run and place.

    Without a ``run_id`` documents can't be told apart, and their findings are taken in turn.
    """
    keys = [c for c in ("run_id", "ordinal") if c in found.columns]
    order = [*keys, "title", "severity", "file", "line", "description", "evidence"]
    ranked = numbered(written(found, "ingested"), ["repo", "source"], order, "_number")
    prefix = F.regexp_replace("id", "[0-9]+$", "")
    return ranked.withColumn("id", F.concat(prefix, F.format_string("%03d", "_number"))).drop("_number")
