import json

import pytest

from fleetlens.functions import fixed_values as V
from fleetlens.functions.schemas import as_findings
from fleetlens.operators import coverage, reports
from fleetlens.operators import findings as ops
from fleetlens.sources import rule_catalog, sinks

FIELDS = "repo string, ordinal long, id string, title string, severity string, category string, status string, confidence int, file string, line int, endpoint string, recommended_fix string"
BASE = ("a", 1, "RG-SEC-001", "Unsafe", "high", "security", "confirmed", 90, "src/x.ts", 7, None, "Replace it")


@pytest.fixture
def make(spark):
    def findings(*changes):
        names = [f.split()[0] for f in FIELDS.split(", ")]
        rows = []
        for n, change in enumerate(changes, start=1):
            row = dict(zip(names, BASE, strict=True)) | {"ordinal": n} | change
            rows.append(tuple(row[k] for k in names))
        return as_findings(spark.createDataFrame(rows, FIELDS), extra=["ordinal"])

    return findings


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_validity_rules(make):
    rows = make(
        {}, {"severity": "urgent"}, {"status": "maybe"}, {"id": "auth-1"}, {"confidence": 150}, {"id": "RG-A-12"},
        {"id": "RG-A-123\n"}, {"title": ""}, {"line": 0}, {"file": None, "line": None}, {"category": None},
    )
    broken = {(r.ordinal, r.violation) for r in ops.violations(rows).collect()}
    assert broken == {
        (2, "severity"), (3, "status"), (4, "id"), (5, "confidence"), (6, "id"), (7, "id"), (8, "title"), (9, "line"),
        (11, "category"),
    }


def test_one_bad_finding_rejects_the_file(make):
    reviewed = make({"repo": "a"}, {"repo": "a", "severity": "urgent"}, {"repo": "b", "id": "RG-B-001"})
    seeds = make({"repo": "a", "id": "RG-S-001"}, {"repo": "b", "id": "RG-S-002"}, {"repo": "c", "id": "RG-S-003"})
    assert ids(ops.with_fallback(reviewed, seeds)) == ["RG-B-001", "RG-S-001", "RG-S-003"]


GATE = [
    {"id": "RG-A-001", "severity": "critical"}, {"id": "RG-A-002", "severity": "high"},
    {"id": "RG-A-003", "severity": "medium"}, {"id": "RG-A-004", "severity": "high", "status": "rejected"},
]


def test_gate(make):
    rows = make(*GATE)
    assert ids(ops.at_or_above(rows, "HIGH")) == ["RG-A-001", "RG-A-002"]
    assert ops.at_or_above(rows, "none").count() == 0
    assert ops.gate_verdict(rows, "critical").first().failed is True
    with pytest.raises(ValueError, match="unknown failure threshold"):
        ops.parse_threshold("severe")


def test_confidence_pass(make):
    rows = make({"status": "potential", "confidence": 74}, {"status": "potential", "confidence": 75}, {"confidence": 1})
    counts = ops.status_counts(rows).first()
    assert (counts.manual_verification, counts.potential, counts.confirmed, counts.reclassified) == (1, 1, 1, 1)


def test_top_risks_leave_out_rejected_and_break_ties_by_order(make):
    rows = make(
        {"id": "RG-A-001", "severity": "low"}, {"id": "RG-A-002", "confidence": 80}, {"id": "RG-A-003", "confidence": 90},
        {"id": "RG-A-004", "confidence": 90}, {"id": "RG-A-005", "severity": "critical", "status": "rejected"},
        {"id": "RG-A-006", "severity": "medium"}, {"id": "RG-A-007", "severity": "informational"},
    )
    top = [r.id[-1] for r in ops.top_risks(rows).orderBy("place").collect()]
    assert top == ["3", "4", "2", "6", "1"]


def test_delta_verdicts(make):
    before = make({"repo": "cleared", "severity": "critical"}, {"repo": "worse", "severity": "high"}, {"repo": "same"}, {"repo": "gone"})
    after = make({"repo": "cleared"}, {"repo": "worse", "severity": "critical"}, {"repo": "same"}, {"repo": "new", "severity": "low"})
    rows = {r.repo: (r.before, r.after, r.result) for r in ops.audit_delta(before, after).collect()}
    assert rows == {
        "cleared": ("1/0", "0/1", V.DELTA_CLEARED),
        "worse": ("0/1", "1/0", "1" + V.DELTA_REMAIN),
        "same": ("0/1", "0/1", V.DELTA_APPLIED),
        "gone": ("0/1", "?/?", "?" + V.DELTA_REMAIN),
        "new": ("?/?", "0/0", V.DELTA_CLEARED),
    }


def test_issue_rows_hide_evidence_and_escape(make):
    from pyspark.sql import functions as F

    rows = make({"title": "a|b\r\nc", "file": None}, {"severity": "low"}).withColumn("evidence", F.lit("SECRET_VALUE"))
    (row,) = ops.issue_rows(rows).collect()
    assert row.title == "a\\|b c" and row.location == V.REPOSITORY_WIDE
    assert "SECRET_VALUE" not in repr(row)


def test_issue_life_cycle(spark, make):
    rows = make({"repo": "new"}, {"repo": "kept"}, {"repo": "fixed", "status": "rejected"}, {"repo": "calm", "severity": "low"})
    repos = rows.select("repo").distinct()
    issues = spark.createDataFrame([("kept", 12), ("fixed", 13), ("vanished", 14)], "repo string, issue_number long")
    got = {r.repo: r.mutation for r in ops.issue_mutations(repos, rows, issues).collect()}
    assert got == {"new": "create", "kept": "update", "fixed": "close", "calm": "noop", "vanished": "close"}


def test_plan_fills_absent_values(make, spark):
    rows = make({"file": None, "line": None, "recommended_fix": ""})
    wanted = spark.createDataFrame([("a", "RG-SEC-001"), ("a", "RG-NO-001")], "repo string, id string")
    (row,) = ops.remediation_plans(rows, wanted).collect()
    assert f"{V.NO_FILE}:{V.NO_LINE}" in row.plan and V.NO_FIX in row.plan and V.NO_TRIGGER in row.plan


def test_duplicates_collapse_to_the_worst(make):
    rows = make(
        {"id": "RG-A-001", "severity": "low", "confidence": 99}, {"id": "RG-A-002", "confidence": 10},
        {"id": "RG-A-003", "confidence": 20}, {"id": "RG-A-004", "line": 8},
    )
    got = {(r.id, r.copies) for r in ops.collapse_duplicates(rows).collect()}
    assert got == {("RG-A-003", 3), ("RG-A-004", 1)}


REPORT = [
    {"id": "RG-A-001"}, {"id": "RG-B-001", "severity": "medium", "category": "dependency", "status": "potential", "file": None},
    {"id": "RG-C-001", "severity": "low", "status": "rejected"},
]


def test_sarif(make):
    (row,) = reports.sarif_documents(make(*REPORT)).collect()
    document = json.loads(row.text)
    run = document["runs"][0]
    assert document["version"] == "2.1.0" and document["$schema"] == V.SARIF_SCHEMA
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["RG-A-001", "RG-B-001"]
    first, second = run["results"]
    assert first["level"] == "error" and second["level"] == "warning"
    assert first["message"]["text"] == "Unsafe Fix: Replace it"
    place = first["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": "src/x.ts"}, "region": {"startLine": 7}}
    assert second["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "."
    assert "endpoint" not in first["properties"]


def test_json_chunks_hold_every_finding(make, monkeypatch):
    monkeypatch.setattr(reports, "CHUNK_FINDINGS", 2)
    rows = make(*[{"id": f"RG-A-{n:03d}", "endpoint": None} for n in range(5)])
    chunks = [json.loads(r.text) for r in reports.json_documents(rows).orderBy("chunk").collect()]
    assert [len(c["findings"]) for c in chunks] == [2, 2, 1]
    assert [f["id"] for c in chunks for f in c["findings"]] == [f"RG-A-{n:03d}" for n in range(5)]
    assert chunks[0]["findings"][0]["endpoint"] is None and chunks[0]["repository"] == "a"


def test_markdown_sections_in_order(make, spark, tmp_path):
    rows = make(*REPORT)
    report = reports.markdown_rows(rows.select("repo").distinct(), rows)
    sinks.write_markdown(report, str(tmp_path / "md"))
    text = "\n".join(
        line for part in sorted((tmp_path / "md" / "repo=a").glob("part-*.txt")) for line in part.read_text().splitlines()
    )
    headings = [line[3:] for line in text.splitlines() if line.startswith("## ")]
    assert headings == V.REPORT_SECTIONS
    top = text.split("## Top Five Risks")[1].split("## ")[0]
    assert "1. **[HIGH] RG-A-001** Unsafe — `src/x.ts:7` · _confirmed_, confidence 90%" in top and "RG-C-001" not in top
    assert "### critical (0)" in text and "- **RG-C-001** Unsafe — rejected" in text
    assert "**Total findings:** 3 (2 active, 1 rejected)" in text


def test_findings_table_round_trip(make, spark, tmp_path):
    rows = make(*REPORT)
    sinks.write_findings(rows, str(tmp_path / "f"))
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "f")).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_rule_catalogue(spark, make):
    rules = rule_catalog.catalog(spark)
    assert rules.count() == 69 and rules.select("pack_dir", "pack").distinct().count() == 14
    assert len(rule_catalog.BYPASSES) == 11
    first = rule_catalog.checklist(rules, make({}, {"status": "rejected"})).orderBy("check_order").collect()
    assert {r.active_findings for r in first if r.category == "security" and r.severity == "high"} == {1}


REPO = "repo string, disabled array<string>, security boolean, dependencies boolean, package_managers array<string>, dependency_files int"


def test_status_precedence_and_limitations(spark):
    repos = spark.createDataFrame(
        [("a", ["trivy"], True, True, ["pip"], 1), ("b", [], False, True, [], 0)], REPO
    )
    seen = spark.createDataFrame(
        [("a", "trivy", "completed", 0), ("a", "semgrep", "timeout", None), ("a", "pip-audit", "completed", 1),
         ("a", "npm-audit", "completed", 0)],
        "repo string, tool string, outcome string, exit_code int",
    )
    matrix = coverage.status_matrix(repos, seen)
    status = {(r.repo, r.tool): r for r in matrix.collect()}
    assert len(status) == 18
    assert status["a", "trivy"].status == "skipped-disabled" and status["a", "trivy"].available is False
    assert status["a", "semgrep"].status == "timeout"
    assert status["a", "gitleaks"].status == "skipped-unavailable"
    assert status["a", "npm-audit"].status == "skipped-not-applicable" and status["a", "npm-audit"].available
    assert status["a", "pip-audit"].status == "completed" and "non-zero (1)" in status["a", "pip-audit"].note
    assert status["b", "gitleaks"].note == "Gated off (audit.security = false)."
    tested = spark.createDataFrame([("a", True), ("b", False)], "repo string, has_tests boolean")
    lines = {}
    for r in coverage.limitations(matrix, tested).orderBy("ordinal").collect():
        lines.setdefault(r.repo, []).append(r.limitation)
    assert lines["a"] == [*V.LIMITATIONS, V.UNAVAILABLE_LIMITATION + "gitleaks, osv-scanner."]
    assert lines["b"] == [*V.LIMITATIONS, V.NO_TESTS_LIMITATION]


def test_host_scans_are_not_broadcast(spark, tmp_path):
    """Rows that a small table fans out to look small to Spark; the joins with them hold at any size."""
    spark.range(1000).write.parquet(str(tmp_path / "c"))
    repos = spark.read.parquet(str(tmp_path / "c")).selectExpr(
        "concat('r', id) AS repo", "array('trivy') AS disabled", "true AS security", "true AS dependencies",
        "array('npm') AS package_managers", "1 AS dependency_files", "id % 2 = 0 AS has_tests",
    )
    seen = repos.selectExpr("repo", "explode(array('semgrep', 'trivy')) AS tool", "'completed' AS outcome", "0 AS exit_code")
    matrix = coverage.status_matrix(repos, seen)
    limits = coverage.limitations(matrix, repos.select("repo", "has_tests"))
    for rows, joins in ((matrix, 1), (coverage.completion(matrix), 1), (limits, 2)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= joins
    assert matrix.where("status = 'completed'").count() == 1000


def test_fallback_sorts_and_broadcasts_nothing(spark, make):
    rows = make({"repo": "a", "id": "RG-A-001"}, {"repo": "b", "id": "bad"})
    plan = ops.with_fallback(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "Sort" not in plan and "Broadcast" not in plan
