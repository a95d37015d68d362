import json

import pytest

from fleetlens.functions import fixed_values as V
from fleetlens.plans import audit

REPO = {
    "package.json": json.dumps({"dependencies": {"express": "*"}, "devDependencies": {"vitest": "1"}}),
    "src/routes/auth.ts": "router.post('/api/login', h)\nrouter.get('/api/items', authenticate, h)\n",
    "node_modules/x/config.json": "debug: true",
    "conf/app.yaml": "debug: true\n",
}
LEAKS = json.dumps([{"RuleID": "aws", "File": "a.env", "StartLine": 2}])


@pytest.fixture(scope="module")
def result(spark, fleet, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("audit"))
    outputs = spark.createDataFrame(
        [("a", "gitleaks", "completed", LEAKS)], "repo string, tool string, status string, stdout string"
    )
    observed = spark.createDataFrame(
        [("a", "gitleaks", "completed", 1)], "repo string, tool string, outcome string, exit_code int"
    )
    issues = spark.createDataFrame([("b", 5)], "repo string, issue_number long")
    files = fleet({"a": REPO, "b": {"notes.txt": "nothing"}})
    audit.audit(files, outputs, observed, issues, target)
    return lambda name: spark.read.parquet(f"{target}/{name}"), target


def test_findings_of_scanners_and_tools(result):
    load, _ = result
    rows = load("findings").orderBy("ordinal").collect()
    assert [r.id for r in rows if r.repo == "a"] == [
        "RG-DEP-001", "RG-DEP-002", "RG-API-001", "RG-API-002", "RG-AUTHZ-001", "RG-CONF-001", "RG-HDR-001",
        "RG-GITLEAKS-001",
    ]
    assert {r.status for r in rows} == {"manual-verification"}
    assert [r.file for r in rows if r.id == "RG-CONF-001"] == ["conf/app.yaml"]


def test_path_lists_are_saved(result):
    load, _ = result
    assert {(r.repo, r.concern, r.path) for r in load("discovery_paths").collect()} >= {
        ("a", "dependency_files", "package.json"), ("a", "config_files", "conf/app.yaml"), ("a", "auth_files", "src/routes/auth.ts"),
    }


def test_gate_and_issues(result):
    load, _ = result
    gate = {(r.repo, r.blocking, r.failed) for r in load("gate").collect()}
    assert gate == {("a", 3, True), ("b", 0, False)}  # a clean repository passes
    assert {(r.repo, r.mutation) for r in load("issue_mutations").collect()} == {("a", "create"), ("b", "close")}


def test_coverage_lists_every_tool(result):
    load, _ = result
    assert load("scans").count() == 18
    status = {(r.repo, r.tool): r.status for r in load("scans").collect()}
    assert status["a", "gitleaks"] == "completed" and status["b", "npm-audit"] == "skipped-not-applicable"


def test_report_lines_in_order(spark, result):
    _, target = result
    rows = spark.read.json(f"{target}/report_lines")
    titles = [r.text[3:] for r in rows.filter("repo = 'a' AND text LIKE '## %'").orderBy("section_no").collect()]
    assert titles == V.REPORT_SECTIONS
    text = "\n".join(r.text for r in rows.filter("repo = 'a'").collect())
    assert "- **API frameworks:** Express" in text
    assert "| `GET /api/items` | yes | yes | ? | ? | no |" in text
    assert "Detected test frameworks: Vitest" in text
    assert "not installed and did not run: semgrep, trivy, osv-scanner, npm-audit." in text
    documents = [json.loads(r.text) for r in spark.read.json(f"{target}/report_json").collect()]
    assert sum(len(d["findings"]) for d in documents) == 8


def test_reviewed_findings_replace_seeds_only_when_valid(spark, result, tmp_path):
    load, target = result
    seeds = load("seed_findings")
    audit.save(seeds, str(tmp_path), "seed_findings")
    good = seeds.limit(1).replace({"potential": "confirmed"}, subset=["status"])
    audit.review(spark, str(tmp_path), audit.Settings(), good)
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 1
    audit.review(spark, str(tmp_path), audit.Settings(), good.withColumn("id", good["title"]))
    assert spark.read.parquet(f"{tmp_path}/findings").count() == seeds.count()
