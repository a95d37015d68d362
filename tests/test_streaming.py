import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import jobs


@pytest.fixture
def batches(spark, tmp_path):
    """Stream whose micro-batches are the given lists of rows, one file each."""

    def stream(schema, *parts):
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
            # A later modification time makes the file source take the parts in this order.
            for file in (tmp_path / f"in/p{n}").glob("part-*.parquet"):
                stamp = 1_700_000_000 + n * 10
                os.utime(file, (stamp, stamp))
        return (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        )

    return stream


def day(n):
    return dt.date(2024, 1, n)


def test_issue_state_is_carried_across_batches(batches):
    runs = batches(
        "repo string, day date, active boolean",
        [("a", day(2), True), ("a", day(1), False), ("b", day(1), True)],
        [("a", day(3), True), ("b", day(2), False)],
        [("a", day(4), False), ("b", day(3), False), ("c", day(1), False)],
    )
    rows = jobs.run_to_table(jobs.issue_states(runs), "issues").collect()
    assert {(r.repo, r.day.day, r.mutation) for r in rows} == {
        ("a", 1, "noop"), ("a", 2, "create"), ("a", 3, "update"), ("a", 4, "close"),
        ("b", 1, "create"), ("b", 2, "close"), ("b", 3, "noop"), ("c", 1, "noop"),
    }


def at(day_no, hour=0):
    return dt.datetime(2024, 1, day_no, hour)


def test_dedup_emits_a_hot_key_once(batches):
    hot = [("a", "x", n, at(1)) for n in range(500)]
    parts = [hot + [("b", "y", 1, at(1))], hot, [("a", "z", n, at(2)) for n in range(40)]]
    stream = batches("repo string, rule string, n int, run_ts timestamp", *parts)
    rows = jobs.run_to_table(jobs.dedup(stream, ["repo", "rule"], "n", "30 days"), "dedup").collect()
    assert sorted((r.repo, r.rule) for r in rows) == [("a", "x"), ("a", "z"), ("b", "y")]


def test_daily_counts_drop_late_rows_and_hold_open_days(batches):
    schema = "severity string, run_ts timestamp"
    stream = batches(
        schema,
        [("high", at(1)), ("high", at(1, 5))],
        [("high", at(3)), ("low", at(3))],
        [("high", at(5))],
        # A batch judges lateness by the watermark its predecessor started with.
        [("high", at(1, 6))],
    )
    rows = jobs.run_to_table(jobs.daily_counts(stream, "1 hour"), "daily").collect()
    assert {(r.day.day, r.severity, r.findings) for r in rows} == {(1, "high", 2), (3, "high", 1), (3, "low", 1)}


def test_stream_scan_equals_batch(spark, batches):
    texts = [[(n, f'x\ntoken = "{"ab12" * 5}{n}"')] for n in range(3)]
    stream = batches("doc_id int, content string", *texts)
    rows = jobs.run_to_table(jobs.scan(stream), "scan")
    batch = jobs.scan(spark.createDataFrame([r for part in texts for r in part], "doc_id int, content string"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, batch.collect()))
    assert rows.filter(F.col("line_no") == 2).count() == 3


def test_a_late_day_corrects_the_next(spark, batches, tmp_path):
    """Several micro-batches, a restart from the checkpoint, and a day that comes last."""
    schema = "repo string, day date, active boolean"
    parts = [[("a", day(1), True), ("b", day(1), False)], [("a", day(3), True), ("b", day(4), True)], [("a", day(4), False)]]
    stream = batches(schema, *parts)
    path = str(tmp_path / "run")
    first = jobs.run_to_table(jobs.issue_corrections(stream), "corrections", path)
    assert {(r.repo, r.day.day, r.mutation) for r in jobs.latest(first).collect()} == {
        ("a", 1, "create"), ("a", 3, "update"), ("a", 4, "close"), ("b", 1, "noop"), ("b", 4, "create"),
    }
    late = [("a", day(2), False), ("b", day(2), True), ("a", day(4), False)]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / "in/late"))
    told = jobs.run_to_table(jobs.issue_corrections(stream), "corrections", path)
    assert {(r.repo, r.day.day, r.mutation) for r in jobs.latest(told).collect()} == {
        ("a", 1, "create"), ("a", 2, "close"), ("a", 3, "create"), ("a", 4, "close"), ("b", 1, "noop"), ("b", 2, "create"), ("b", 4, "update"),
    }
    assert told.where("version > 0").count() == 2


def test_corrections_equal_a_recount():
    import random

    rng = random.Random(3)
    for _ in range(50):
        known, last = {}, {}
        days = [(rng.randrange(30), rng.random() < 0.5) for _ in range(25)]
        for k in range(0, 25, 5):
            rows, known = jobs.corrected(known, dict(days[k : k + 5]))
            last |= {d: (a, m) for d, a, m, _ in rows}
        final = dict(days)
        was = False
        for d in sorted(final):
            want = ("update" if was else "create") if final[d] else ("close" if was else "noop")
            assert last[d] == (final[d], want)
            was = final[d]


def test_runs_with_and_without_findings(batches):
    schema = "kind string, repo string, n int, ts timestamp"
    parts = [
        [("run", "a", 1, at(1)), ("found", "a", 10, at(1, 2)), ("run", "b", 2, at(1))],
        [("found", "b", 11, at(1, 7)), ("run", "a", 3, at(2)), ("found", "a", 12, at(1, 3))],
        [("run", "end", -1, at(20)), ("found", "end", -1, at(20))],
    ]
    stream = batches(schema, *parts)
    runs = stream.where("kind = 'run'").selectExpr("repo", "n AS run_id", "ts AS run_ts")
    found = stream.where("kind = 'found'").selectExpr("repo", "n AS finding", "ts AS found_ts")
    rows = jobs.run_to_table(jobs.run_findings(runs, found, "6 HOURS", "2 days"), "run-findings").where("run_id > 0").collect()
    assert sorted((r.run_id, r.finding or 0) for r in rows) == [(1, 10), (1, 12), (2, 0), (3, 0)]


def test_kept_table_survives_a_failure_between_write_and_commit(spark, batches, tmp_path):
    schema = "repo string, n int"
    stream = batches(schema, [("a", 1), ("b", 2)], [("a", 3)], [("c", 4)])
    path, failed = str(tmp_path / "kept"), []

    def broken(session, at, batch, rows):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost before the commit")
        jobs.commit(session, at, batch, rows)

    with pytest.raises(Exception, match="lost before the commit"):
        jobs.keep_table(stream, path, broken)
    kept = "repo string, n int, batch long"
    assert sorted(r.n for r in jobs.kept_table(spark, path, kept).collect()) == [1, 2]
    jobs.keep_table(stream, path, broken)
    assert sorted(r.n for r in jobs.kept_table(spark, path, kept).collect()) == [1, 2, 3, 4]
    jobs.keep_table(stream, path)  # nothing new
    assert jobs.committed(spark, path) == {0, 1, 2}


def test_parts_have_files_of_bounded_size_and_one_batch_each(spark, tmp_path, monkeypatch):
    from fleetlens.plans import stream_queries as queries

    monkeypatch.setattr(queries, "FILE_ROWS", 50)
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 990 THEN id % 50 ELSE 99 + id % 2 END AS at")
    path = queries.dealt(rows, "at", str(tmp_path / "parts"))
    files = [queries.file_count(rows, f"{path}/part={k}") for k in range(queries.PARTS)]
    assert files == [7] * queries.PARTS  # also the last part, of ten rows
    seen = {}

    def note(batch, number):
        seen[number] = sorted(r["at"] for r in batch.collect())

    stream = queries.part_stream(spark, path, rows.schema)
    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [len(seen[k]) for k in sorted(seen)] == [len([1 for i in range(990) if i % 50 < 100 / 3]), len([1 for i in range(990) if i % 50 > 100 / 3]), 10]
