"""Profiles brought up to date equal profiles made anew, and only changed contents are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.columns import basename
from fleetlens.operators import discovery
from fleetlens.operators import discovery_delta as delta

POOL = {
    "package.json": ['{"dependencies":{"express":"1","pg":"1"}}', '{"devDependencies":{"vitest":"1"}}', "{bad", "null"],
    "go.mod": ["require github.com/gin-gonic/gin v1", "module x"],
    "Cargo.toml": ['axum = "0.7"', "[package]"],
    "requirements.txt": ["Django==4\npytest", "flask\npsycopg2\nstripe"],
    "a.ts": ["router.get('/api/x', h)\nrouter.post('/api/y', h)", "noop()"],
    "yarn.lock": [""], "main_test.go": ["package main"], "test_app.py": ["assert True"], "Dockerfile": ["FROM x"],
}


def fleet_of(rng):
    out = {}
    for repo in ("hot", "a", "b", "c"):
        for _ in range(40 if repo == "hot" else 4):
            name = rng.choice(list(POOL))
            out[repo, f"{rng.choice(['', 'x/', 'y/src/routes/'])}{name}"] = rng.choice(POOL[name])
    return out


def frame(spark, files):
    rows = [(r, p, c) for (r, p), c in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def full(files):
    manifests = files.where(basename(F.col("path")).isin(discovery.READ_MANIFESTS))
    rows = discovery.profile(files.select("repo", "path"), manifests, discovery.endpoints(files))
    return sorted(repr(sorted(r.asDict().items())) for r in rows.collect())


def shown(state):
    return sorted(repr(sorted(r.asDict().items())) for r in delta.profile(state).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_delta_equals_full_profile(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = fleet_of(rng)
    state = delta.begun(frame(spark, files))
    assert shown(state) == full(frame(spark, files))
    for turn in range(2):
        for place in rng.sample(sorted(files), len(files) // 4):  # removed, edited, renamed
            kind = rng.randrange(3)
            content = files.pop(place)
            if kind == 1:
                files[place] = rng.choice(POOL.get(place[1].rpartition("/")[2], ["x"]))
            elif kind == 2:
                files[place[0], "z/" + place[1]] = content
        files |= {k: v for k, v in fleet_of(rng).items() if rng.random() < 0.3}
        now, store = frame(spark, files), str(tmp_path / f"{turn}")
        delta.store_contents(now, store, digits=1)
        read = lambda wanted, store=store: delta.stored_contents(spark, store, wanted, digits=1)
        state = delta.advanced(state, delta.digests(now), read)
        assert shown(state) == full(now)


def test_only_changed_contents_are_read(spark, tmp_path):
    files = {("r", f"f{n}.py"): f"text {n}" for n in range(200)}
    before = frame(spark, files)
    state = delta.begun(before)
    files["r", "f7.py"] = "another text"
    del files["r", "f9.py"]
    now, store = frame(spark, files), str(tmp_path / "store")
    delta.store_contents(now, store, digits=2)
    asked, plans = [], []

    def read(wanted):
        asked.extend((r.repo, r.path) for r in wanted.collect())
        found = delta.stored_contents(spark, store, wanted, digits=2)
        plans.append(found)
        return found

    after = delta.advanced(state, delta.digests(now), read)
    assert asked == [("r", "f7.py")]
    assert plans[0].collect()[0].content == "another text"
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*shard", plan)
    assert [r.file_count for r in delta.profile(after).collect()] == [199]


def test_same_listing_changes_nothing(spark):
    before = frame(spark, {("r", "go.mod"): "module x", ("r", "empty"): None})
    state = delta.begun(before)
    assert delta.changes(state.digests, delta.digests(before)).count() == 0
    gone = delta.advanced(state, delta.digests(before).limit(0), lambda wanted: wanted.selectExpr("repo", "path", "'' AS content"))
    assert delta.profile(gone).collect() == [] and gone.totals.count() == 0


def told(state):
    return sorted(state.facts.groupBy("repo", "path", "fact").agg(F.sum("n").alias("n")).collect())


def test_facts_of_a_file_are_those_of_the_full_discovery(spark):
    """Labels and calls told inside a row equal those found by the rows of the full discovery."""
    contents = [
        '{"dependencies":{"express":"1","\\u0070g":"1","exp":"2"},"peerDependencies":{"vue":"*"}}',
        '{"dependencies":{"pg-pool":"1"},"dependencies":{"stripe":"1"}}', '{"dependencies":["express"]}', '{"name":"express"}',
        "{'dependencies':{'koa':'1'}}", '{"dependencies":{"koa":"1"}} django', '{"dependencies":{"koa":"1"}', "null", "", None,
        "Django==4\nflask\nstripe\npsycopg2", "gin-gonic/gin gofiber/fiber axum", 'ROCKET = "1"\nredis',
        "router.get('/a', h); app.all('/b', h)\r\napi\n.post('/c', h)", "x.get('/a')",
    ]
    names = ["package.json", "requirements.txt", "go.mod", "Cargo.toml", "composer.json", "a.ts", "a.test.ts", "x.py"]
    rows = [(f"r{k}", f"{n}/{name}", text) for k, name in enumerate(names) for n, text in enumerate(contents)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    alone = files.withColumn("repo", F.concat_ws(":", "repo", "path"))
    found = delta.facts_of(alone)
    manifests = alone.where(basename(F.col("path")).isin(discovery.READ_MANIFESTS))
    lines = found.select("repo", F.explode(F.split("by_content", "\n")).alias("fact")).where("fact <> ''")
    seen = sorted((r.repo, r.fact.removeprefix("first:")) for r in lines.collect())
    assert seen == sorted((r.repo, f"{r.concern}:{r.label}") for r in discovery.manifest_facts(manifests).collect())
    calls = {r["repo"]: r["count"] for r in discovery.endpoints(alone).groupBy("repo").count().collect()}
    assert calls and calls == {r.repo: r.routes for r in found.where("routes <> 0").collect()}


def test_a_state_is_read_and_shuffled_once_a_listing(spark):
    """A file is one row of the state, and meets the listing in one shuffle."""
    files = {("r", f"{n}/package.json"): '{"dependencies":{"express":"1","pg":"1"}}' for n in range(30)}
    state = delta.begun(frame(spark, files))
    assert state.files.count() == 30
    plan = delta.compared(state.files, state.digests)._jdf.queryExecution().sparkPlan().toString()
    plan += delta.facts_of(frame(spark, files))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert delta.facts_of(frame(spark, files)).count() == 30
    assert len(told(state)) == 30 * 6 and told(state)[0].n == 1


def test_files_listed_twice_or_without_a_repository(spark):
    """Each row of a listing is compared with each of the state; a null key equals no other."""
    rows = [("r", "a", "1"), ("r", "a", "2"), ("r", "b", "1"), ("r", "c", "1"), (None, "n", "1")]
    listing = [("r", "a", "1"), ("r", "b", "1"), ("r", "d", "1"), (None, "n", "1")]
    before, now = (spark.createDataFrame(x, "repo string, path string, digest string") for x in (rows, listing))
    found = [tuple(r) for r in delta.changes(before, now).collect()]
    assert sorted(found, key=repr) == sorted(
        [("r", "a", "1", "edited"), ("r", "c", None, "gone"), ("r", "d", "1", "new"), (None, "n", "1", "new"), (None, "n", None, "gone")], key=repr
    )
    stale = {(r.repo, r.path) for r in delta.compared(before, now).where("stale").collect()}
    assert stale == {("r", "a"), ("r", "c")}
