"""What ingestion passes over, with the reason: documents that are no JSON, lists that are none, elements that are no records.

A document is parsed once, into a VARIANT. Its lists are opened level by level as arrays of variants within its row, so
an odd element is told by its place and costs nothing else. Together with the findings, the rejects account for every
element that a tool wrote.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

#: For each tool its lists of records, the lists within those, and so on: (path, how it is written, lists within).
LAYOUTS = {
    "semgrep": [("results", "ARRAY", [])],
    "gitleaks": [("", "ARRAY", [])],
    "npm-audit": [("vulnerabilities", "OBJECT", []), ("advisories", "OBJECT", [])],
    "pnpm-audit": [("advisories", "OBJECT", [])],
    "osv-scanner": [("results", "ARRAY", [("packages", "ARRAY", [("vulnerabilities", "ARRAY", [])])])],
    "trivy": [("Results", "ARRAY", [(name, "ARRAY", []) for name in ("Vulnerabilities", "Secrets", "Misconfigurations")])],
}


#: The place of a whole document, and no rejects, as SQL.
_WHOLE = "''"
NONE = "CAST(array() AS ARRAY<STRUCT<place: STRING, reason: STRING>>)"


def _reject(place: str, reason: str) -> str:
    return f"array(named_struct('place', {place}, 'reason', '{reason}'))"


def _let(name: str, value: str, then: str) -> str:
    """SQL of the array ``then``, in which ``value`` is computed once and called ``name``."""
    return f"flatten(transform(array({value}), {name} -> {then}))"


def _below(record: str, place: str, lists, depth: int = 0) -> str:
    """SQL for the array of rejects among the ``lists`` of a record."""
    found = []
    for path, kind, within in lists:
        held, items, x, at = (f"{name}{depth}" for name in ("held", "items", "x", "at"))
        steps, named = (f"$.{path}", f"concat({place}, '/{path}')") if path else ("$", place)
        below = f"concat({named}, '/', {at})"
        deeper = _below(x, below, within, depth + 1) if within else NONE
        each = f"IF(coalesce(startswith(schema_of_variant({x}), 'OBJECT'), false), {deeper}, {_reject(below, 'not a record')})"
        if kind == "ARRAY":
            opened = f"try_variant_get({held}, '$', 'array<variant>')"
            elements = f"flatten(transform({items}, ({x}, {at}) -> {each}))"
        else:
            opened = f"try_variant_get({held}, '$', 'map<string,variant>')"
            elements = f"flatten(map_values(transform_values({items}, ({at}, {x}) -> {each})))"
        listed = _let(items, opened, f"IF({items} IS NULL, {_reject(named, 'not a list')}, {elements})")
        absent = f"{held} IS NULL OR is_variant_null({held})"
        found.append(_let(held, f"try_variant_get({record}, '{steps}', 'variant')", f"IF({absent}, {NONE}, {listed})"))
    return f"concat({', '.join(found)})"


def rejects(scan_runs: DataFrame, layouts=None) -> DataFrame:
    """(repo, run_id, tool, place, reason) for the completed runs of known tools.

    ``place`` is the path within the document, empty for the whole; reasons are empty, not json, not a list and not a record. A
    list that is absent or null is none, and nothing is rejected. The runs are read once and each document gives its
    rejects inside its row, so more tools or deeper lists cost no more passes.
    """
    layouts = layouts or LAYOUTS
    runs = scan_runs.where((F.col("status") == "completed") & F.col("tool").isin(*layouts))
    # Behind a generator, so that the document is parsed once.
    docs = runs.selectExpr("repo", "run_id", "tool", "inline(array(named_struct('stdout', stdout, 'v', try_parse_json(stdout))))")
    blank = "trim(coalesce(stdout, '')) = ''"
    by_tool = " ".join(f"WHEN {quoted(tool)} THEN {_below('v', _WHOLE, lists)}" for tool, lists in layouts.items())
    found = f"CASE WHEN v IS NULL THEN IF({blank}, {_reject(_WHOLE, 'empty')}, {_reject(_WHOLE, 'not json')}) ELSE CASE tool {by_tool} END END"
    return docs.selectExpr("repo", "run_id", "tool", f"inline({found})")
