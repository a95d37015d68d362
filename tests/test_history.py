"""As-of and overlap joins, and findings of two runs side by side."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.operators import history, versions


# --- as-of ------------------------------------------------------------------------------------------

def plain_as_of(left, right):
    out = []
    for n, repo, t in left:
        earlier = [(u, x) for r, u, x in right if r == repo and u is not None and repo is not None and t is not None and u <= t]
        out.append((n, repo, t, max(earlier)[1] if earlier else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def moments():
    """A third of all rows, on both sides, belong to one repository."""
    rng = random.Random(2)
    repo = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
    left = [(n, repo(), rng.choice([None, *range(300)])) for n in range(1500)] + [(9999, "none", 5), (1, "hot", -1)]
    right = [(repo(), rng.choice([None, *range(0, 300, 7)]), n) for n in range(300)]
    return left, right


def test_as_of_equals_plain(spark, moments):
    left, right = moments
    found = spark.createDataFrame(left, "n int, repo string, t int").repartition(5)
    states = spark.createDataFrame(right, "repo string, u int, run int").repartition(3)
    got = history.as_of(found, states, ["repo"], "t", "u", ["run"], tie="run").collect()
    assert sorted(map(tuple, got), key=repr) == plain_as_of(left, right)


def test_as_of_spreads_a_hot_repository(spark, moments, monkeypatch):
    """No window goes over a whole repository: its rows lie in several slices."""
    seen = []
    plain = history.written
    monkeypatch.setattr(history, "written", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    left, right = moments
    found = spark.createDataFrame(left, "n int, repo string, t int").repartition(5)
    states = spark.createDataFrame(right, "repo string, u int, run int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else small slices become one
    try:
        history.as_of(found, states, ["repo"], "t", "u", ["run"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].where("_key0 = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) > 2 and max(sizes) < sum(sizes) / 2


def test_as_of_edges(spark):
    none = spark.createDataFrame([], "repo string, u int, run int")
    found = spark.createDataFrame([("a", 1, 7), (None, 1, 8), ("a", None, 9)], "repo string, t int, _side int")
    got = history.as_of(found, none, ["repo"], "t", "u", ["run"]).collect()
    assert sorted((r["_side"], r.run) for r in got) == [(7, None), (8, None), (9, None)]
    assert history.as_of(found.limit(0), none, ["repo"], "t", "u", ["run"]).collect() == []
    with pytest.raises(ValueError):
        history.as_of(found, none, ["repo"], "t", "u", ["t"])


# --- overlaps ----------------------------------------------------------------------------------------

def plain_overlaps(left, right):
    top = history.FOREVER
    out = []
    for repo, a, s, e in left:
        for other, b, u, v in right:
            if repo is not None and repo == other and s is not None and u is not None:
                ends = (top if e is None else e, top if v is None else v)
                if s < ends[0] and u < ends[1] and max(s, u) < min(ends):
                    out.append((repo, a, b, max(s, u), None if min(ends) == top else min(ends)))
    return sorted(map(repr, out))


def paired(spark, left, right, **options):
    a = spark.createDataFrame(left, "repo string, a int, opened long, closed long").repartition(4)
    b = spark.createDataFrame(right, "repo string, b int, seen long, last long")
    rows = history.overlaps(a, b, ["repo"], ("opened", "closed"), ("seen", "last"), **options)
    return sorted(repr((r.repo, r.a, r.b, r.start, r.stop)) for r in rows.collect())


@pytest.fixture(scope="module")
def periods():
    rng = random.Random(4)

    def side(n):
        out = []
        for k in range(n):
            start = rng.randrange(-500, 500)
            length = rng.choice([0, 1, 1, 2, 3, 7, 8, 9, 60, 100_000, -5])
            repo = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
            out.append((repo, k, rng.choice([start] * 9 + [None]), rng.choice([start + length] * 9 + [None])))
        return out

    return side(150), side(200)


@pytest.mark.parametrize("hot_bin", [10_000, 3])
def test_overlaps_equal_plain(spark, periods, hot_bin):
    """Long and open periods, both ways round; each pair once, also where bins are split."""
    left, right = periods
    assert paired(spark, left, right, hot_bin=hot_bin) == plain_overlaps(left, right)


def test_a_long_period_takes_no_more_rows(spark):
    left = [("r", 1, 0, 10**15)]
    right = [("r", n, n * 10**12, n * 10**12 + 1) for n in range(50)]
    assert paired(spark, left, right) == plain_overlaps(left, right)
    level = history._level(F.col("s"), F.col("e"))
    frame = spark.createDataFrame([(5, 6), (0, 10**15), (-3, history.FOREVER), (7, 15), (7, 16)], "s long, e long")
    bins = frame.select(F.size(F.sequence(F.call_function("shiftright", F.col("s"), level), F.call_function("shiftright", F.col("e") - 1, level))).alias("n"))
    assert max(r.n for r in bins.collect()) <= 2


def test_overlaps_of_nothing(spark):
    assert paired(spark, [], [("r", 1, 0, 5)]) == []
    a = spark.createDataFrame([("r", 1)], "repo string, x long")
    with pytest.raises(ValueError):
        history.overlaps(a, a, ["repo"], ("x", "x"), ("x", "x"))


# --- two versions of a file ---------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=25))
def test_alignment_keeps_order_and_content(old, new):
    became = versions.aligned(old, new)
    hits = [(n, m) for n, m in enumerate(became) if m]
    assert all(old[n] == new[m - 1] for n, m in hits)
    assert [m for _, m in hits] == sorted({m for _, m in hits})


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(12)))
def test_longest_increasing_run(numbers):
    places = versions.increasing(list(numbers))
    run = [numbers[p] for p in places]
    assert run == sorted(run) and places == sorted(places)
    best = [1] * 12
    for i in range(12):
        best[i] = 1 + max([best[j] for j in range(i) if numbers[j] < numbers[i]], default=0)
    assert len(run) == max(best)


def test_unique_lines_hold_moved_blocks():
    old = ["head", "x", "one", "x", "two", "x", "tail"]
    new = ["new", "head", "x", "one", "two", "x", "x", "tail"]
    assert versions.aligned(old, new) == [2, 3, 4, 0, 5, 7, 8]


def test_diff(spark):
    def files(rows):
        return spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string")

    def found(rows):
        return spark.createDataFrame([("r", p, n, x) for p, n, x in rows], "repo string, path string, line int, rule string")

    before = files([("same", "a\nb"), ("moved", "a\nb\nc"), ("cut", "a\nb\nc"), ("lost", "x"), ("empty", None), ("many", "k")])
    after = files([("same", "a\nb"), ("moved", "0\na\nb\nc"), ("cut", "a\nc"), ("fresh", "z"), ("empty", "q"), ("many", "0\nk")])
    old = found(
        [("same", 2, "B"), ("moved", 2, "B"), ("moved", 3, "fixed"), ("cut", 2, "B"), ("cut", None, "whole"), ("lost", 1, "X")]
        + [("lost", None, "whole"), (None, None, "repo"), ("many", 1, "K"), ("many", 1, "K"), ("moved", 99, "past"), ("empty", 1, "E")]
    )
    new = found(
        [("same", 2, "B"), ("moved", 3, "B"), ("cut", None, "whole"), ("fresh", 1, "Z"), (None, None, "repo")]
        + [("many", 2, "K"), ("many", 2, "K"), ("many", 2, "K")]
    )
    got = versions.finding_diff(before, after, old, new).collect()
    assert sorted((r.path or "", r.rule, r.was_line or 0, r.now_line or 0, r.change, r.n) for r in got) == sorted(
        [
            ("same", "B", 2, 2, "kept", 1), ("moved", "B", 2, 3, "moved", 1), ("moved", "fixed", 3, 0, "gone", 1),
            ("cut", "B", 2, 0, "gone", 1), ("cut", "whole", 0, 0, "kept", 1), ("lost", "X", 1, 0, "gone", 1),
            ("lost", "whole", 0, 0, "gone", 1), ("", "repo", 0, 0, "kept", 1), ("fresh", "Z", 0, 1, "new", 1),
            ("many", "K", 1, 2, "moved", 2), ("many", "K", 0, 2, "new", 1), ("moved", "past", 99, 0, "gone", 1),
            ("empty", "E", 1, 0, "gone", 1),
        ]
    )


def test_unchanged_contents_are_not_moved(spark):
    """The texts that are joined are those of changed files with findings."""
    schema = "repo string, path string, content string"
    before = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y")], schema)
    after = spark.createDataFrame([("r", "a", "x"), ("r", "b", "z\ny")], schema)
    found = spark.createDataFrame([("r", "a", 1, "A")], "repo string, path string, line int, rule string")
    assert [r.change for r in versions.finding_diff(before, after, found, found).collect()] == ["kept"]


# --- ages -----------------------------------------------------------------------------------------------

def test_ages(spark):
    rows = [("a", "x", d) for d in (1, 2, 2, 2, 5, 9, 10)] + [("a", "y", d) for d in (2, 5, 20)] + [(None, "x", 1), ("a", "x", None), ("b", None, 3)]
    seen = spark.createDataFrame(rows, "repo string, rule string, day long")
    got = {(r.repo, r.rule, r.streak): tuple(r)[3:] for r in history.ages(seen, days=4).collect()}
    assert got == {
        # runs of a: 1, 2, 5, 9, 10, 20
        ("a", "x", 1): (1, 10, 5, False, 19, 4),
        ("a", "y", 1): (2, 5, 2, False, 7, 2),
        ("a", "y", 2): (20, 20, 1, True, None, 1),
        ("b", None, 1): (3, 3, 1, True, None, 1),
    }
    assert history.ages(seen.limit(0)).collect() == []


def test_overlaps_shuffle_each_side_once(spark, tmp_path, monkeypatch):
    """Looking up crowded bins moves no rows, neighbouring levels share their bins, and nothing fanned out is broadcast."""
    spark.range(3000).selectExpr("id % 7 AS repo", "id", "id % 500 AS s").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    left = rows.selectExpr("repo", "id AS issue", "s AS opened", "s + 1 + id % 90 AS closed")
    right = rows.selectExpr("repo", "id AS finding", "s AS seen", "s + 1 + id % 9 AS last")
    found = history.overlaps(left, right, ["repo"], ("opened", "closed"), ("seen", "last"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 4
    levels = left.select(history._level(history.F.col("opened"), history.F.col("closed")).alias("n")).distinct().collect()
    assert {r.n for r in levels} == {0, 4, 8}
    last = spark.range(1).select(history._level(history.F.lit(0), history.F.lit(history.FOREVER)).alias("n")).first().n
    assert last <= 63
