import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import tables
from fleetlens.operators import scanners


def skewed(spark, rows=6000):
    """A third of all rows belong to one repository, the rest to many small ones."""
    rng = random.Random(11)
    data = [
        ("hot" if n % 3 == 0 else f"r{rng.randrange(200)}", f"src/{rng.randrange(900):04d}.ts", n) for n in range(rows)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "repo string, path string, k int").repartition(6)


def test_numbering_of_small_and_huge_groups(spark):
    got = tables.numbered(skewed(spark), ["repo"], ["path", "k"]).collect()
    assert len(got) == 6000
    expected = {}
    for row in sorted(got, key=lambda r: (r.repo, r.path, r.k)):
        expected[row.repo] = expected.get(row.repo, 0) + 1
        assert row.n == expected[row.repo]


def test_huge_group_is_cut_into_slices(spark):
    """With slicing, no single task numbers more than a part of the hot repository."""
    rows = skewed(spark)
    sliced = rows.repartitionByRange(8, "repo", "path", "k").withColumn("s", F.spark_partition_id())
    sizes = [r["count"] for r in sliced.filter("repo = 'hot'").groupBy("s").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 1200


def test_rows_with_a_null_key_are_a_group(spark):
    rows = spark.createDataFrame([(None, 2), ("a", 1), (None, 1), ("a", 3)], "repo string, k int")
    got = tables.numbered(rows, ["repo"], ["k"]).collect()
    assert sorted((r.repo or "", r.k, r.n) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 3, 2)]


def test_ids_of_a_huge_repository(spark, fleet):
    config = "debug: true\norigin: '*'\n"
    repos = {"hot": {f"c{n:03d}.yaml": config for n in range(120)}, "b": {"x.yaml": config}}
    rows = scanners.seed_findings(scanners.collect(fleet(repos))).collect()
    hot = sorted((r for r in rows if r.repo == "hot"), key=lambda r: (r.file, r.line))
    assert [r.id[-3:] for r in hot] == [f"{n:03d}" for n in range(1, 241)] and len(rows) == 242


def test_numbering_of_nothing(spark):
    assert tables.numbered(skewed(spark).filter("k < 0"), ["repo"], ["path"]).count() == 0


def test_written_table_is_computed_once(spark):
    rows = tables.written(spark.range(5).withColumn("r", F.rand()))
    assert rows.collect() == rows.collect()


def test_recorded_tables_can_be_removed(spark):
    with tables.recorded() as outer:
        first = tables.written(spark.range(3), "first")
        with tables.recorded() as inner:
            second = tables.written(spark.range(4), "second")
    tables.written(spark.range(5), "third")
    assert len(outer) == 2 and inner == outer[1:]
    tables.removed(spark, inner)
    assert first.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        second.collect()


class Session:
    """Stands for a session in which spark.checkpoint.dir is unset."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda self, name, default=None: default})()


def test_unset_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session("spark://host:7077"))
    assert tables.shared_folder(Session("local[8]")) == tables.shared_folder(Session("local[2]"))


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is not None:
        assert tables.fresh_path(spark, "x").startswith(configured.rstrip("/") + "/fleetlens/x-")


def test_groups_beyond_the_limit_are_numbered_in_slices(spark, monkeypatch):
    """Small groups by a window and large ones, one of them with a null key, in slices: the same numbers."""
    monkeypatch.setattr(tables, "GROUP_ROWS", 100)
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    rows = skewed(spark).unionByName(spark.range(300).selectExpr("CAST(NULL AS STRING) AS repo", "'p' AS path", "CAST(id AS INT) AS k"))
    got = tables.numbered(rows, ["repo"], ["path", "k"]).collect()
    assert len(got) == 6300
    expected = {}
    for row in sorted(got, key=lambda r: (r.repo or "", r.path, r.k)):
        expected[row.repo] = expected.get(row.repo, 0) + 1
        assert row.n == expected[row.repo]


def test_numbering_shuffles_only_the_columns_that_are_read(spark):
    """One shuffle, and no join; a long text that nobody reads stays where it is."""
    rows = tables.written(skewed(spark).withColumn("description", F.repeat(F.lit("long "), 90)))
    plan = tables.numbered(rows, ["repo"], ["path", "k"]).select("repo", "k", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "description" not in plan
