import json

import pytest

from fleetlens.operators import ingest
from fleetlens.operators.findings import violations

RUNS = "repo string, run_id long, tool string, status string, stdout string"


@pytest.fixture
def run(spark):
    def ingested(tool, *documents, status="completed", limits=ingest.UNLIMITED):
        rows = [
            ("a", n, tool, status, d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(documents)
        ]
        found = ingest.ingest_all(spark.createDataFrame(rows, RUNS), limits=limits)
        assert violations(found).count() == 0
        return found.orderBy("run_id", "ordinal").collect()

    return ingested


@pytest.mark.parametrize("tool", [*ingest.INGESTERS, "unknown-tool"])
def test_bad_output_gives_no_rows(run, tool):
    assert run(tool, "", "  ", "not json", "[]", "{}", "3", "null", '"x"', '{"results": 3, "advisories": []}') == []


def test_unfinished_runs_are_ignored(run):
    assert run("gitleaks", [{"RuleID": "x"}], status="timeout") == []


def test_semgrep(run):
    item = {
        "check_id": "javascript.lang.security.audit.xss", "path": "src/a.js", "start": {"line": 10},
        "extra": {"message": "XSS risk", "severity": "ERROR", "metadata": {}},
    }
    odd = {"check_id": "ends.with.", "start": {"line": "x"}, "extra": {"metadata": {"shortlink": "https://s"}}}
    first, second, third = run("semgrep", {"results": [item, odd, 5]})
    assert (first.id, first.severity, first.file, first.line) == ("RG-SEMGREP-001", "high", "src/a.js", 10)
    assert (first.title, first.description, first.evidence) == ("semgrep: xss", "XSS risk", "XSS risk")
    assert first.status == "potential" and first.confidence == 60 and first.source == "tool:semgrep"
    assert (second.title, second.severity, second.line) == ("semgrep: ends.with.", "medium", None)
    assert second.description == "https://s" and second.file is None
    assert (third.id, third.title) == ("RG-SEMGREP-003", "semgrep: ")


def test_gitleaks(run):
    leak = {"RuleID": "aws-access-key", "Description": "AWS key", "File": "config.js", "StartLine": 3, "Match": "x" * 300}
    first, second = run("gitleaks", [leak, {"Description": "only text"}])
    assert (first.title, first.category, first.severity) == ("Secret: aws-access-key", "secrets", "high")
    assert len(first.evidence) == 300 and first.line == 3
    assert len(run("gitleaks", [leak], limits=ingest.CUSTOMARY)[0].evidence) == 200
    assert second.title == "Secret: only text" and second.line is None


def test_npm_both_layouts_share_numbering(run):
    lodash = {
        "severity": "high", "range": "<4.17.21", "fixAvailable": True,
        "via": ["minimist", {"title": "Prototype Pollution", "url": "https://x"}],
    }
    document = {
        "vulnerabilities": {"lodash": lodash, "plain": {"severity": "odd", "via": ["lodash"], "fixAvailable": False}},
        "advisories": {
            "200": {"module_name": "late", "title": "t2", "severity": "low"},
            "30": {"module_name": "early", "title": "t1", "severity": "moderate", "overview": "o" * 400, "url": "u"},
        },
    }
    rows = run("npm-audit", document)
    assert [r.id for r in rows] == [f"RG-NPM-00{n}" for n in range(1, 5)]
    assert rows[0].title == "Vulnerable dependency: lodash — Prototype Pollution"
    assert rows[0].recommended_fix.startswith("A fix is available") and rows[0].evidence == "https://x"
    assert rows[1].title == "Vulnerable dependency: plain" and rows[1].severity == "medium"
    assert rows[1].recommended_fix.startswith("No automatic fix")
    assert [r.title for r in rows[2:]] == ["Vulnerable dependency: early — t1", "Vulnerable dependency: late — t2"]
    assert len(rows[2].description) == 400
    assert len(run("npm-audit", document, limits=ingest.CUSTOMARY)[2].description) == 300


def test_pnpm(run):
    (row,) = run("pnpm-audit", {"advisories": {"1": {"module_name": "m", "title": "t", "severity": "critical"}}})
    assert (row.id, row.severity, row.description) == ("RG-PNPM-001", "critical", "t")


def osv(name, *ids):
    return {
        "package": {"ecosystem": "npm", "name": name, "version": "1.0.0"},
        "vulnerabilities": [{"id": i, "summary": f"{name} {n}", "database_specific": {"severity": "LOW"}} for n, i in enumerate(ids)],
    }


def test_osv_keeps_first_of_each_advisory_in_order(run):
    document = {
        "results": [
            {"packages": [osv("z", "G-2", "G-1", "G-2"), osv("z", "G-1")]},
            {"packages": [osv("a", "G-1"), {"package": None}]},
            {},
        ]
    }
    rows = run("osv-scanner", document)
    assert [(r.id, r.title, r.description) for r in rows] == [
        ("RG-OSV-001", "z@1.0.0: G-2", "z 0"), ("RG-OSV-002", "z@1.0.0: G-1", "z 1"), ("RG-OSV-003", "a@1.0.0: G-1", "a 0"),
    ]
    assert {r.severity for r in rows} == {"low"}


def test_osv_cap_comes_after_removal_of_repeats(run):
    ids = [f"G-{n // 2}" for n in range(500)]
    document = {"results": [{"packages": [osv("p", *ids)]}]}
    assert len(run("osv-scanner", document)) == 250
    rows = run("osv-scanner", document, limits=ingest.CUSTOMARY)
    assert len(rows) == 200 and rows[-1].title == "p@1.0.0: G-199" and rows[-1].id == "RG-OSV-200"


def test_trivy_kinds_and_shared_cap(run):
    result = {
        "Target": "package-lock.json",
        "Vulnerabilities": [{"PkgName": "minimist", "VulnerabilityID": "CVE-2021-1", "Severity": "CRITICAL", "Title": "pp", "PrimaryURL": "http://x"}],
        "Secrets": [{"Title": "key", "Severity": "HIGH", "StartLine": 4}],
        "Misconfigurations": [{"ID": "DS002", "Title": "root user", "Severity": "LOW"}],
    }
    rows = run("trivy", {"Results": [result, {"Target": "x", "Secrets": None}]})
    assert [(r.category, r.severity, r.title, r.line) for r in rows] == [
        ("dependency", "critical", "minimist: CVE-2021-1", None),
        ("secrets", "high", "Secret: key", 4),
        ("configuration", "low", "Misconfig: DS002 root user", None),
    ]
    many = {"Results": [{"Vulnerabilities": [{}] * 150, "Secrets": [{}] * 100, "Misconfigurations": [{}]}]}
    assert len(run("trivy", many)) == 251
    rows = run("trivy", many, limits=ingest.CUSTOMARY)
    assert len(rows) == 200 and [r.category for r in rows].count("secrets") == 50


def test_odd_elements_cost_only_themselves(run):
    good = osv("p", "G-1")
    odd = {"results": ["odd", None, 3, {"packages": "odd"}, {"packages": ["odd", None, {"package": "x"}, good]}]}
    assert [r.title for r in run("osv-scanner", odd)] == ["p@1.0.0: G-1"]
    vulnerable = {"PkgName": "m", "VulnerabilityID": "C-1", "Severity": "LOW"}
    odd = {"Results": ["odd", None, {"Target": "t", "Vulnerabilities": ["odd", vulnerable], "Secrets": "odd"}]}
    assert [(r.title, r.severity) for r in run("trivy", odd)] == [(": ", "medium"), ("m: C-1", "low")]


def test_ids_are_unique_over_documents(spark):
    document = json.dumps({"results": [{"check_id": "a.x"}, {"check_id": "a.y"}]})
    rows = [("a", n, "semgrep", "completed", document) for n in (7, 3)] + [("b", 1, "semgrep", "completed", document)]
    found = ingest.with_unique_ids(ingest.ingest_all(spark.createDataFrame(rows, RUNS))).collect()
    assert sorted((r.repo, r.run_id, r.id[-3:], r.title[-1]) for r in found) == [
        ("a", 3, "001", "x"), ("a", 3, "002", "y"), ("a", 7, "003", "x"), ("a", 7, "004", "y"),
        ("b", 1, "001", "x"), ("b", 1, "002", "y"),
    ]


def test_no_limit_by_default(run):
    many = [{"check_id": f"a.r{n}"} for n in range(205)]
    assert len(run("semgrep", {"results": many})) == 205


def test_lines_are_positive_whole_numbers(spark):
    from pyspark.sql import functions as F

    from fleetlens.functions.columns import line_number

    cases = {"10": 10, "10.0": 10, "1e1": 10, " 7 ": 7, "0": None, "-3": None, "2.5": None, "": None, "x": None, "10d": None, "NaN": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", line_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == cases


def test_rejects_tell_place_and_reason(spark):
    from fleetlens.operators.ingest_rejects import rejects

    docs = [
        ("semgrep", '{"results":[{"check_id":"a"},3,null,[]]}', "completed"), ("semgrep", "{bad", "completed"), ("semgrep", " ", "completed"),
        ("semgrep", None, "completed"), ("semgrep", "[]", "completed"), ("semgrep", '{"results":{}}', "completed"), ("semgrep", "{bad", "error"),
        ("gitleaks", '[{"a":1},"x"]', "completed"), ("gitleaks", "{}", "completed"), ("npm-audit", '{"vulnerabilities":{"p":1,"q":{}},"advisories":null}', "completed"),
        ("osv-scanner", '{"results":[{"packages":[{"vulnerabilities":[{},"v"]},{"vulnerabilities":"x"}]}]}', "completed"), ("other", "{bad", "completed"),
    ]
    runs = spark.createDataFrame([("r", n, *d) for n, d in enumerate(docs)], "repo string, run_id int, tool string, stdout string, status string")
    got = sorted((r.run_id, r.place, r.reason) for r in rejects(runs).collect())
    assert got == [
        (0, "/results/1", "not a record"), (0, "/results/2", "not a record"), (0, "/results/3", "not a record"), (1, "", "not json"),
        (2, "", "empty"), (3, "", "empty"), (5, "/results", "not a list"), (7, "/1", "not a record"), (8, "", "not a list"),
        (9, "/vulnerabilities/p", "not a record"), (10, "/results/0/packages/0/vulnerabilities/1", "not a record"),
        (10, "/results/0/packages/1/vulnerabilities", "not a list"),
    ]


def test_osv_document_is_parsed_once(spark):
    """The list of results is parsed in one place of the plan, however often its elements are looked at."""
    runs = spark.createDataFrame([("r", "{}")], "repo string, stdout string")
    plan = ingest.osv_scanner(runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(results,") <= 1 and plan.count("array_sort") <= 2


def test_rejects_read_the_runs_once(spark, tmp_path):
    from fleetlens.operators.ingest_rejects import rejects

    spark.createDataFrame(
        [("r", 1, "trivy", "completed", '{"Results":[7,{"Secrets":{"a":1}}]}'), ("r", 2, "npm-audit", "completed", '{"advisories":{"a":1,"b":{}}}'),
         ("r", 3, "gitleaks", "completed", None), ("r", 4, "gitleaks", "completed", "{}"), ("r", 5, "semgrep", "completed", '{"results":null}'),
         ("r", 6, "osv-scanner", "completed", '{"results":[{"packages":[null,{"vulnerabilities":[[]]}]}]}')],
        "repo string, run_id long, tool string, status string, stdout string",
    ).write.parquet(str(tmp_path / "runs"))
    found = rejects(spark.read.parquet(str(tmp_path / "runs")))
    assert sorted((r.run_id, r.place, r.reason) for r in found.collect()) == [
        (1, "/Results/0", "not a record"), (1, "/Results/1/Secrets", "not a list"), (2, "/advisories/a", "not a record"), (3, "", "empty"),
        (4, "", "not a list"), (6, "/results/0/packages/0", "not a record"), (6, "/results/0/packages/1/vulnerabilities/0", "not a record"),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
