"""Streaming queries. Each drains its source and gives the sink as a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import fresh_path, written
from ..streaming import jobs
from . import views
from .registry import SQL, query, with_views
from .scanner_queries import SECRET_SQL


PARTS = 3


#: Rows in a file of a part, about; a part with more has several files, so no task writes or reads it whole.
FILE_ROWS = 100_000


def dealt(rows: DataFrame, by: str, path: str, first: int = 0, parts: int = PARTS) -> str:
    """Write ``rows`` as ``parts`` parts in the order of ``by``, each later than the one before and of as many files as the others."""
    low, high, total = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    files = max(1, -(-total // (parts * FILE_ROWS)))
    borders = [low + (high - low) * k / parts for k in range(1, parts)] if low is not None else []
    for k in range(parts):
        part = rows
        if k and borders:
            part = part.where(F.col(by) >= F.lit(borders[k - 1]))
        if k < len(borders):
            part = part.where(F.col(by) < F.lit(borders[k]))
        name = f"{path}/part={first + k}"
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(name)
        # Files without rows make up the number where a part has too few rows to fill them.
        for _ in range(files - file_count(rows, name) if parts > 1 else 0):
            rows.limit(0).coalesce(1).write.mode("append").parquet(name)
    return path


def file_count(rows: DataFrame, path: str) -> int:
    return len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


def part_stream(spark, path: str, schema) -> DataFrame:
    """One micro-batch per part."""
    files = len(spark.read.schema(schema).parquet(f"{path}/part=0").inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).drop("part")


def streamed(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` as a stream that comes in several micro-batches, in the order of ``by``."""
    path = dealt(rows, by, fresh_path(rows.sparkSession, name))
    return part_stream(rows.sparkSession, path, rows.schema)


def event_stream(spark, folder):
    return streamed(views.table(spark, folder, "events"), "ts", "events").select(
        views.repo_of(F.col("user_id")).alias("repo"),
        "event_id",
        "event_type",
        views.observed_severity().alias("severity"),
        jobs.utc_instant(F.col("ts")).alias("run_ts"),
    )


@query(
    "stream_scan",
    with_views(
        SECRET_SQL,
        select="""SELECT doc_id, line_no, kind, sha256(value) AS secret_sha256,
          CAST(length(value) AS INTEGER) AS secret_length FROM secrets""",
    ),
)
def stream_scan(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    texts = streamed(docs, "doc_id", "documents")
    return jobs.run_to_table(jobs.scan(texts).drop("pos"), "stream-scan")


@query(
    "stream_dedup",
    with_views(views.OBSERVATIONS_SQL, select="SELECT DISTINCT repo, event_type, severity FROM observations"),
)
def stream_dedup(spark, folder):
    """The watermark delay spans the whole table, so every repeat is removed."""
    distinct = jobs.dedup(
        event_stream(spark, folder), ["repo", "event_type", "severity"], "event_id", "400 days"
    )
    return jobs.run_to_table(distinct, "stream-dedup")


@query(
    "stream_issue_state",
    with_views(
        views.OBSERVATIONS_SQL,
        select="""SELECT repo, day, active, CASE WHEN active AND was THEN 'update' WHEN active THEN 'create'
            WHEN was THEN 'close' ELSE 'noop' END AS mutation FROM (
          SELECT *, coalesce(lag(active) OVER (PARTITION BY repo ORDER BY day), false) AS was FROM (
            SELECT repo, day, bool_or(severity IN ('critical', 'high')) AS active FROM observations GROUP BY ALL))""",
    ),
)
def stream_issue_state(spark, folder):
    """Observations are counted into one run per repository and day, and the runs are streamed."""
    observed = views.table(spark, folder, "events").select(
        views.repo_of(F.col("user_id")).alias("repo"),
        F.to_date("ts").alias("day"),
        views.observed_severity().alias("severity"),
    )
    counted = written(jobs.audit_runs(observed).withColumn("n", F.unix_date("day")), "counted")
    runs = streamed(counted, "n", "runs").drop("n")
    return jobs.run_to_table(jobs.issue_states(runs), "stream-issues")


@query(
    "stream_daily_counts",
    with_views(
        views.OBSERVATIONS_SQL,
        select="""SELECT day, severity, count(*) AS findings FROM observations
          WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    ),
)
def stream_daily_counts(spark, folder):
    return jobs.run_to_table(jobs.daily_counts(event_stream(spark, folder), "1 hour"), "stream-daily")


ISSUE_STATE_SQL = SQL["stream_issue_state"]


@query("stream_issue_corrections", ISSUE_STATE_SQL)
def stream_issue_corrections(spark, folder):
    """The issue life cycle where some days come last, in two runs of which the second goes on from the first's checkpoint."""
    observed = views.table(spark, folder, "events").select(
        views.repo_of(F.col("user_id")).alias("repo"), F.to_date("ts").alias("day"), views.observed_severity().alias("severity")
    )
    runs = written(jobs.audit_runs(observed).withColumn("n", F.unix_date("day")), "runs")
    late = F.pmod(F.xxhash64("repo", "day"), F.lit(11)) == 0
    path = dealt(runs.where(~late), "n", fresh_path(spark, "runs"))
    sink = fresh_path(spark, "corrections")
    for more in (None, runs.where(late)):
        if more is not None:
            dealt(more, "n", path, first=PARTS, parts=1)
        stream = part_stream(spark, path, runs.schema).drop("n")
        told = jobs.run_to_table(jobs.issue_corrections(stream), "corrections", sink)
    return jobs.latest(told)


@query(
    "stream_run_findings",
    with_views(
        views.OBSERVATIONS_SQL,
        select="""SELECT r.repo, r.event_id AS run_id, f.event_id AS finding
          FROM (SELECT * FROM observations WHERE event_type = 'view') r
          LEFT JOIN (SELECT * FROM observations WHERE event_type IN ('error', 'purchase')) f
          ON r.repo = f.repo AND f.ts >= r.ts AND f.ts < r.ts + INTERVAL 6 HOUR""",
    ),
)
def stream_run_findings(spark, folder):
    """Findings within six hours of each run; a last row far ahead moves the watermark past all others."""
    events = views.audit_events(spark, folder).withColumn("ts", jobs.utc_instant(F.col("ts")))
    last = events.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    ends = [last.selectExpr("'end' AS repo", "-1L AS event_id", "ts + INTERVAL 30 DAYS AS ts", f"'{kind}' AS kind") for kind in ("run", "finding")]
    path = dealt(events, "ts", fresh_path(spark, "audit-events"))
    dealt(ends[0].unionByName(ends[1]), "ts", path, first=PARTS, parts=1)
    stream = part_stream(spark, path, events.schema)
    runs = stream.where("kind = 'run'").select("repo", F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"))
    found = stream.where("kind = 'finding'").select("repo", F.col("event_id").alias("finding"), F.col("ts").alias("found_ts"))
    return jobs.run_to_table(jobs.run_findings(runs, found, "6 HOURS", "1 hour"), "run-findings").where("run_id >= 0")


@query(
    "stream_findings_table",
    with_views(views.OBSERVATIONS_SQL, select="SELECT repo, event_id AS finding, severity FROM observations WHERE severity <> 'informational'"),
)
def stream_findings_table(spark, folder):
    """A findings table kept batch by batch with a ledger."""
    found = event_stream(spark, folder).where("severity <> 'informational'").select("repo", F.col("event_id").alias("finding"), "severity")
    path = fresh_path(spark, "findings-table")
    jobs.keep_table(found, path)
    return jobs.kept_table(spark, path, "repo string, finding long, severity string, batch long")
