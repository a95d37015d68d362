import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import fixed_values as V
from fleetlens.operators import findings as F_
from fleetlens.operators import scanners
from fleetlens.sources import files as source

FAKE_KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def findings(fleet, repos):
    return scanners.seed_findings(scanners.collect(fleet(repos))).collect()


EVIDENCE = {
    "package.json": json.dumps({"dependencies": {"express": "^4.18.0"}}),
    "config.js": f'const credential = "{FAKE_KEY}";\nmodule.exports = {{ credential }};\n',
    "src/routes/auth.ts": "router.post('/api/login', (req, res) => res.end())\n",
}


def test_evidence_of_a_small_repository(fleet):
    rows = findings(fleet, {"a": EVIDENCE})
    assert all(r.status != "confirmed" for r in rows)
    secret = [r for r in rows if r.category == "secrets"]
    assert [(r.file, r.line, r.source) for r in secret] == [("config.js", 1, "scanner:secrets")]
    by_id = {r.id: r for r in rows}
    assert by_id["RG-DEP-001"].title == V.NO_LOCKFILE_TITLE
    assert by_id["RG-API-001"].severity == "high" and by_id["RG-API-002"].category == "rate-limiting"
    assert by_id["RG-AUTHZ-001"].status == "manual-verification"
    assert by_id["RG-HDR-001"].severity == "medium"
    assert FAKE_KEY not in repr(rows)


def test_findings_are_valid_and_ids_unique(spark, fleet):
    evidence = scanners.collect(fleet({"a": EVIDENCE, "b": EVIDENCE}))
    rows = scanners.seed_findings(evidence).selectExpr("*", "0 AS ordinal")
    assert F_.violations(rows).count() == 0
    assert rows.count() == rows.select("repo", "id").distinct().count()


def test_placeholder_is_no_secret(fleet):
    rows = findings(fleet, {"a": {".env.example": 'API_KEY="your-api-key-here"\n'}})
    assert [r for r in rows if r.category == "secrets"] == []


def test_authorization_and_headers_found_anywhere_silence_the_scanners(fleet):
    guarded = {**EVIDENCE, "src/guard.js": "if (isAdmin(user)) helmet()"}
    ids = {r.id for r in findings(fleet, {"a": guarded})}
    assert not ids & {"RG-AUTHZ-001", "RG-HDR-001"}


def test_dependency_findings_order(fleet):
    manifest = {
        "dependencies": {"z": "*", "a": "latest", "ok": "^1"},
        "devDependencies": {"d": "*"},
        "peerDependencies": {"p": "*"},
    }
    rows = findings(fleet, {"a": {"package.json": json.dumps(manifest), "b/package.json": "{bad", "c/package.json": ""}})
    dep = sorted((r.id, r.title) for r in rows if r.category == "dependency")
    assert dep == [
        ("RG-DEP-001", "Unparseable manifest b/package.json"),
        ("RG-DEP-002", 'Floating version for "z" (*)'),
        ("RG-DEP-003", 'Floating version for "a" (latest)'),
        ("RG-DEP-004", 'Floating version for "d" (*)'),
        ("RG-DEP-005", V.NO_LOCKFILE_TITLE),
    ]


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("rejectUnauthorized: false", ["TLS certificate verification disabled"]),
        ("NODE_TLS_REJECT_UNAUTHORIZED='0'", ["TLS certificate verification disabled"]),
        ("rejectunauthorized: false", []),
        ("'Access-Control-Allow-Origin': '*'", ["Wildcard CORS origin"]),
        ("DEBUG=TRUE", ["Debug mode enabled"]),
        ("xdebug: true", []),
        ("debug: trueish", []),
        ("secure : False, httponly: false", ["Insecure cookie flag"]),
        ("origin: '*', debug: true", ["Wildcard CORS origin", "Debug mode enabled"]),
    ],
)
def test_config_rules(spark, line, labels):
    rows = spark.createDataFrame([("a", "x.yaml", 1, line)], "repo string, path string, line_no int, line string")
    hits = scanners.config_hits(rows).orderBy("rule_no").collect()
    assert [r.label for r in hits] == labels
    assert rows.filter(rows.line.rlike(scanners.CONFIG_LINE)).count() == bool(labels)


@pytest.mark.parametrize(
    ("pattern", "text", "expected"),
    [
        (V.VALIDATION_CONTROL, "x, body(schema)", True),
        (V.VALIDATION_CONTROL, "x, body('schema')", False),
        (V.VALIDATION_CONTROL, "schema.parse(req)", True),
        (V.VALIDATION_CONTROL, "(.parse(req)", False),
        (V.RATE_CONTROL, "/api/limiter", True),
        (V.RATE_CONTROL, "élimiter", True),
        (V.RATE_CONTROL, "unlimiter", False),
        (V.AUTHORIZATION_TOKEN, "can(user)", True),
        (V.AUTHORIZATION_TOKEN, "can('x')", False),
        (V.AUTHORIZATION_TOKEN, "authorize", False),
        (V.AUTHORIZATION_TOKEN, "Authoriz", True),
        (V.HEADER_MECHANISM, "x@fastify/helmet", True),
        (V.HEADER_MECHANISM, "require('@fastify/helmet')", True),
        (V.HEADER_MECHANISM, "res.setHeader('X-Thing'", True),
        (V.HEADER_MECHANISM, "shelmet", False),
    ],
)
def test_word_boundaries_are_ascii_and_dead_alternatives_stay_dead(spark, pattern, text, expected):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(text).rlike(pattern)).first()
    assert row[0] is expected


def test_leading_lookahead_changes_nothing(spark):
    """The patterns behind a look at the first character match what they match without it."""
    from pyspark.sql import functions as F

    pieces = ["role", "Gate", "can(", "x", " ", "helmet", "X-Frame-Options", "@fastify/helmet", "token", "=", ":",
              "'abcdefghijklmnop1234'", "AKIA" + "Q" * 16, "debug", "true", "secure", "false", "app", ".get(", "'/a'", "app.get('/b'",
              "NODE_TLS_REJECT_UNAUTHORIZED", "=0", "é", "_", "\n", "-----BEGIN RSA PRIVATE KEY-----"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(pieces, k=6)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (V.AUTHORIZATION_TOKEN, V.HEADER_MECHANISM, V.ROUTE_CALL, scanners.SECRET_LINE, scanners.CONFIG_LINE):
        bare = re.sub(r"^\(\?=\[[^\]]*\]\)", "", pattern)
        assert bare != pattern
        assert df.filter(F.col("t").rlike(pattern) != F.col("t").rlike(bare)).count() == 0
        assert df.filter(F.col("t").rlike(pattern)).count() > 0


def test_file_prefilter_loses_no_line(spark, fleet):
    """Dropping files without a match gives the same lines as testing every line."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = ["token", "=", '"', "abcdefghijklmnop", "\n", "\r\n", " ", "password:", "'", "qrstuvwxyz012345"]
    files = fleet({"a": {f"f{n}.ts": "".join(rng.choices(words, k=30)) for n in range(400)}})
    hit = F.col("line").rlike(scanners.SECRET_LINE)
    every = source.explode_lines(files).filter(hit)
    quick = source.lines_matching(files, scanners.SECRET_LINE).filter(hit)
    assert every.count() > 0
    assert every.exceptAll(quick).count() == 0 and quick.exceptAll(every).count() == 0


def test_custom_rules_from_a_table(spark, fleet):
    rules = spark.createDataFrame(
        [("todo", "low", r"^\s*TODO", "do it"), ("fixme", "low", "FIXME$", "fix it")],
        "label string, severity string, pattern string, fix string",
    )
    files = fleet({"a": {"x.ts": "TODO one\nx TODO\nFIXME\n"}})
    rows = scanners.custom_rules(files, scanners.load_rules(rules)).collect()
    assert sorted((r.line_no, r.label) for r in rows) == [(1, "todo"), (3, "fixme")]


def test_custom_rules_in_batches(fleet, monkeypatch):
    monkeypatch.setattr(scanners, "RULES_PER_PASS", 2)
    rules = [
        ("a", "low", "TODO", ""), ("b", "low", "[^a]FIX", ""), ("c", "low", r"(x)\1", ""), ("d", "low", "end$", ""), ("e", "low", "(?i)todo", ""),
    ]
    files = fleet({"a": {"x.ts": "TODO one\naFIX bFIX\nxx the end\ntodo"}})
    rows = scanners.custom_rules(files, rules).collect()
    assert sorted((r.line_no, r.rule_no, r.label) for r in rows) == [
        (1, 0, "a"), (1, 4, "e"), (2, 1, "b"), (3, 2, "c"), (3, 3, "d"), (4, 4, "e"),
    ]
    assert scanners.custom_rules(files, []).count() == 0


def test_plug_in_scanner(spark, fleet):
    from pyspark.sql import functions as F

    def readme(evidence):
        rows = evidence.files.filter("path = 'README.md'").select("repo", F.col("path").alias("file"))
        return scanners.as_hits(
            rows, "DOC", title="readme", severity="low", category="other", status="potential", confidence=1,
            source="scanner:readme",
        )

    evidence = scanners.collect(fleet({"a": {"README.md": ""}, "b": EVIDENCE}))
    rows = scanners.seed_findings(evidence, scanners=[*scanners.SCANNERS, ("readme", readme)])
    assert [(r.repo, r.id) for r in rows.filter("category = 'other'").collect()] == [("a", "RG-DOC-001")]


def test_scanner_summary_shows_empty_scanners(spark, fleet):
    files = fleet({"a": EVIDENCE})
    rows = scanners.scanner_summary(scanners.seed_findings(scanners.collect(files)), files).collect()
    counts = {r.source: r.findings for r in rows}
    assert counts["scanner:configuration"] == 0 and counts["scanner:routes"] == 2 and len(counts) == 6


def test_each_content_pattern_stands_in_the_plan_once(fleet, monkeypatch):
    """A filter over the marks must not make the scan match the patterns a second time."""
    from fleetlens.functions import fixed_values as V
    from fleetlens.operators import discovery, scanners

    seen = {}

    def written(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    monkeypatch.setattr(scanners, "written", written)
    files = fleet({"a": {"x.py": "os", "requirements.txt": "flask"}})
    scanners.collect(files)
    assert seen["signals"].count(V.AUTHORIZATION_TOKEN[:40]) == 1
    assert seen["signals"].count(V.HEADER_MECHANISM[:40]) == 1
    facts = discovery._text_facts(files)._jdf.queryExecution().optimizedPlan().toString()
    assert facts.count("lower(") == 1 and facts.count("concat_ws") == 1


def test_long_row_groups_are_dealt_out(spark, tmp_path, monkeypatch):
    from fleetlens.plans import views

    monkeypatch.setattr(views, "PIECE_ROWS", 100)
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "long.parquet"))
    rows = views.spread_table(spark, str(tmp_path), "long")
    most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 200 and rows.count() == 4000
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    assert views.spread_table(spark, str(tmp_path), "none").count() == 0
