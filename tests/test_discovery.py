import json

import pytest

from fleetlens.functions import fixed_values as V
from fleetlens.operators import discovery
from fleetlens.sources import files as source
from fleetlens.sources import repo_tree


def labels(rows, concern):
    return sorted(r.label for r in rows.collect() if r.concern == concern)


def profile(files):
    rows = discovery.profile(files, files, discovery.endpoints(files)).collect()
    return {r.repo: r for r in rows}


EXPRESS = {
    "package.json": json.dumps({"dependencies": {"express": "^4"}, "devDependencies": {"vitest": "^1"}}),
    "pnpm-lock.yaml": "lockfileVersion: 9",
    "src/routes/auth.ts": "router.post('/api/login', h);\nrouter.get('/api/users/:id', h);\n",
}


def test_express_repository(fleet):
    files = fleet({"a": EXPRESS})
    row = profile(files)["a"]
    assert row.languages == ["TypeScript"]
    assert row.package_managers == ["pnpm"]
    assert row.api_frameworks == ["Express"] and row.frameworks == ["Express"]
    assert row.test_frameworks == ["Vitest"]
    assert (row.api_endpoints, row.file_count, row.auth_files) == (2, 3, 1)
    calls = {(r.method, r.path, r.line) for r in discovery.endpoints(files).collect()}
    assert calls == {("POST", "/api/login", 1), ("GET", "/api/users/:id", 2)}


def test_fastapi_and_empty_repository(fleet):
    files = fleet(
        {"py": {"requirements.txt": "fastapi\npytest\n", "app/main.py": "x"}, "empty": {"notes.txt": "hi"}}
    )
    rows = profile(files)
    assert rows["py"].languages == ["Python"] and rows["py"].package_managers == ["pip"]
    assert rows["py"].api_frameworks == ["FastAPI"] and rows["py"].test_frameworks == ["pytest"]
    assert rows["empty"].languages == [] and rows["empty"].api_endpoints == 0
    assert rows["empty"].file_count == 1


def test_excluded_names_hide_any_path_part(fleet):
    files = fleet({"a": {"node_modules/dep/index.js": "", "src/build": "", "src/builder.js": "", "dist/x.js": ""}})
    assert [r.path for r in source.exclude(files).collect()] == ["src/builder.js"]


@pytest.mark.parametrize(
    ("extra", "managers"), [({}, ["npm"]), ({"pnpm-lock.yaml": ""}, ["pnpm"]), ({"bun.lockb": ""}, ["bun"])]
)
def test_npm_is_implied_only_without_a_node_lockfile(fleet, extra, managers):
    files = fleet({"a": {"sub/package.json": "{}", **extra}})
    assert [r.package_manager for r in discovery.package_managers(files).collect()] == managers


def test_stores_by_prefix_and_by_substring(fleet):
    deps = {"dependencies": {"pg-pool": "1", "stripe": "1", "@aws-sdk/client-s3": "1", "express": "1"}}
    files = fleet(
        {"node": {"package.json": json.dumps(deps)}, "py": {"Pipfile": "Upgrade = 1\nSQLAlchemy = 2"}}
    )
    rows = discovery.stores_and_integrations(files)
    assert labels(rows.filter("repo = 'node'"), "database") == ["PostgreSQL"]
    assert labels(rows.filter("repo = 'node'"), "integration") == ["AWS SDK", "Stripe"]
    assert labels(rows.filter("repo = 'py'"), "database") == ["PostgreSQL", "SQLAlchemy"]


def test_only_first_go_manifest_counts_and_rust_always_has_tests(fleet):
    files = fleet(
        {
            "g": {"a/go.mod": "labstack/echo", "b/go.mod": "gin-gonic/gin", "x_test.go": ""},
            "r": {"Cargo.toml": "AXUM = 1"},
            "lone": {"x_test.go": ""},
        }
    )
    rows = discovery.non_node_stacks(files)
    assert labels(rows.filter("repo = 'g'"), "api_framework") == ["Echo"]
    assert labels(rows.filter("repo = 'g'"), "test_framework") == ["go test"]
    assert labels(rows.filter("repo = 'r'"), "api_framework") == ["Axum"]
    assert labels(rows.filter("repo = 'r'"), "test_framework") == ["cargo test"]
    assert rows.filter("repo = 'lone'").count() == 0


def test_next_is_one_framework_label(fleet):
    files = fleet({"a": {"package.json": '{"peerDependencies": {"next": "1", "vue": "1"}}'}})
    rows = discovery.node_frameworks(discovery.node_dependencies(files))
    assert labels(rows, "framework") == ["Next.js (API routes)", "Vue"]
    assert labels(rows, "api_framework") == ["Next.js (API routes)"]


def test_route_lines_and_skipped_files(fleet):
    files = fleet(
        {
            "a": {
                "r.js": "\napp.delete('/api/item/:id', h)\n",
                "r.test.js": "app.get('/skipped', h)",
                "two.ts": "app.get('/x', h); Server . PATCH ( `/y`, h)\r\nmyapp.get('/no', h)",
                "not.py": "app.get('/z', h)",
            }
        }
    )
    got = {(r.file, r.line, r.pos, r.method, r.path) for r in discovery.endpoints(files).collect()}
    assert got == {
        ("r.js", 2, 0, "DELETE", "/api/item/:id"),
        ("two.ts", 1, 0, "GET", "/x"),
        ("two.ts", 1, 1, "PATCH", "/y"),
    }


def test_path_predicates(fleet):
    paths = [
        ".github/workflows/ci.yml", ".gitlab-ci.yml", "sub/Jenkinsfile", "Jenkinsfile", "Dockerfile.dev",
        "main.tf", "deploy/k8s/pod.yaml", "src/author.ts", "src/author.md", ".env", "x/.env.local",
        "vite.config.ts", "config.json", "a.ini",
    ]
    files = fleet({"a": dict.fromkeys(paths, "")})

    def where(test):
        return sorted(r.path for r in discovery.paths_where(files, test).collect())

    assert where(discovery.is_ci_file) == [".github/workflows/ci.yml", ".gitlab-ci.yml", "Jenkinsfile"]
    assert where(discovery.is_infra_file) == ["Dockerfile.dev", "deploy/k8s/pod.yaml", "main.tf"]
    assert where(discovery.is_auth_file) == ["src/author.ts"]
    assert where(discovery.is_config_file) == sorted(
        [".env", ".github/workflows/ci.yml", ".gitlab-ci.yml", "a.ini", "config.json",
         "deploy/k8s/pod.yaml", "vite.config.ts", "x/.env.local"]
    )


def test_text_files_follow_node_extensions(fleet):
    paths = [".env", ".env.local", ".gitignore", "a.TS", "Makefile", "x.tf", "b.md"]
    kept = source.text_files(fleet({"a": dict.fromkeys(paths, "")}))
    assert sorted(r.path for r in kept.collect()) == [".env", ".env.local", "a.TS", "b.md"]


def test_cap_keeps_first_paths_and_flags(fleet):
    files = fleet({"big": {f"f{n}": "" for n in range(7)}, "small": {"f": ""}})
    rows = source.cap(files, 5).collect()
    assert sorted(r.path for r in rows if r.repo == "big") == [f"f{n}" for n in range(5)]
    assert {(r.repo, r.truncated) for r in rows} == {("big", True), ("small", False)}


def test_read_tree(spark, tmp_path):
    tree = {
        "one/src/a b+c.ts": b"x\ny", "one/.env": b"K=1", "two/deep/er/f.bin": b"\xffok",
        "one/.github/workflows/ci.yml": b"on: push", "one/.github/.hidden/x/.y": b"y",
        "two/deep/__init__.py": b"", ".dotrepo/a.py": b"a", "two/__pycache__/m.pyc": b"m",
    }
    for name, content in tree.items():
        path = tmp_path / "fleet" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    root = str(tmp_path / "fleet")
    expected = {
        (*name.split("/", 1), content.decode("utf-8", "replace"))
        for name, content in tree.items()
        if not name.startswith(".dotrepo")
    }
    rows = source.read_tree(spark, root).collect()
    hidden_or_empty = {r for r in expected if r[1].split("/")[-1][0] in "._" or not r[2]}
    assert {(r.repo, r.path, r.content) for r in rows} == expected - hidden_or_empty
    assert len(rows) == len(expected - hidden_or_empty)
    short = source.read_tree(spark, root, max_bytes=2)
    assert {r.path for r in short.collect()} == {"__pycache__/m.pyc"}

    (tmp_path / "fleet/one/link.ts").symlink_to(tmp_path / "fleet/one/src/a b+c.ts")
    repo_tree.register(spark)
    for units in (1, 1000):
        reader = spark.read.format("repo_tree").option("units", units).option("exclude", "")
        mounted = reader.load(root).collect()
        assert {(r.repo, r.path, r.content) for r in mounted} >= expected
        assert len(mounted) == len(tree)
    pruned = spark.read.format("repo_tree").option("exclude", "__pycache__,.hidden,deep").load(root)
    assert {r.path for r in pruned.filter("repo IN ('one', 'two')").collect()} == {
        "src/a b+c.ts", ".env", ".github/workflows/ci.yml"
    }


def test_stored_files_table(spark, fleet, tmp_path):
    files = fleet({"a": {"x.ts": "one\ntwo"}})
    files.write.parquet(str(tmp_path / "files"))
    stored = source.read_table(spark, str(tmp_path / "files"))
    assert stored.collect() == files.collect()
    capped = source.text_files(stored, V.MAX_TEXT_FILES)
    assert [r.path for r in capped.collect()] == ["x.ts"]


def test_lines_keep_trailing_empties_and_split_crlf(fleet):
    files = fleet({"a": {"f": "x\r\ny\n\n"}})
    rows = sorted((r.line_no, r.line) for r in source.explode_lines(files).collect())
    assert rows == [(1, "x"), (2, "y"), (3, ""), (4, "")]


def test_incremental_reuses_prior_rows(spark, fleet):
    files = fleet({"a": {"x": ""}, "b": {"y": ""}, "c": {"z": ""}})
    prior = spark.createDataFrame([("a", 7), ("gone", 1), ("c", None)], "repo string, file_count long")
    result = discovery.incremental(
        files, prior, lambda missing: missing.groupBy("repo").count().withColumnRenamed("count", "file_count")
    )
    assert sorted((r.repo, r.file_count) for r in result.collect()) == [("a", 7), ("b", 1), ("c", 1)]
