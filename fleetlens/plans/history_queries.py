"""Queries on findings over runs and time."""

from pyspark.sql import functions as F

from ..operators import history, versions
from . import views
from .registry import query, with_views

HISTORY_SQL = """seen AS (SELECT 'repo_' || user_id AS repo, event_id, ts, event_type FROM events),
latest AS (
  SELECT repo, ts, max(event_id) FILTER (event_type = 'view') AS run_id,
         max(struct_pack(e := event_id, s := CASE event_type WHEN 'signup' THEN 'open' ELSE 'closed' END))
           FILTER (event_type IN ('signup', 'click')) AS issue
  FROM seen GROUP BY repo, ts),
runs AS (SELECT repo, ts, run_id FROM latest WHERE run_id IS NOT NULL),
issues AS (SELECT repo, ts, issue.e AS issue_event, issue.s AS issue_state FROM latest WHERE issue IS NOT NULL)"""


@query(
    "finding_as_of_run",
    with_views(
        HISTORY_SQL,
        select="""SELECT f.repo, f.event_id AS finding, r.run_id, i.issue_event, coalesce(i.issue_state, 'none') AS issue_state
          FROM (SELECT * FROM seen WHERE event_type IN ('error', 'purchase')) f
          ASOF LEFT JOIN runs r ON f.repo = r.repo AND f.ts >= r.ts
          ASOF LEFT JOIN issues i ON f.repo = i.repo AND f.ts >= i.ts""",
    ),
)
def finding_as_of_run(spark, folder):
    """Findings with the latest run of their repository and the state of its issue at that moment."""
    seen = views.audit_events(spark, folder)
    found = seen.where("kind = 'finding'").select("repo", F.col("event_id").alias("finding"), "ts")
    runs = seen.where("kind = 'run'").select("repo", F.col("event_id").alias("run_id"), "ts")
    issues = seen.where("kind IN ('open', 'closed')").select(
        "repo", F.col("event_id").alias("issue_event"), F.col("kind").alias("issue_state"), "ts"
    )
    at_run = history.as_of(found, runs, ["repo"], "ts", "ts", ["run_id"])
    at_issue = history.as_of(at_run, issues, ["repo"], "ts", "ts", ["issue_event", "issue_state"], tie="issue_event")
    return at_issue.select("repo", "finding", "run_id", "issue_event", F.coalesce("issue_state", F.lit("none")).alias("issue_state"))


@query(
    "issue_finding_overlap",
    f"""WITH issues AS ({views.ISSUE_PERIODS_SQL}), sightings AS ({views.SIGHTING_PERIODS_SQL}),
        pairs AS MATERIALIZED (
          SELECT i.repo, issue, finding, greatest(opened, first_seen) AS start,
                 least(coalesce(closed, 1000000), coalesce(last_seen, 1000000)) AS stop
          FROM issues i JOIN sightings s ON i.repo = s.repo)
        SELECT repo, issue, finding, start, nullif(stop, 1000000) AS stop FROM pairs WHERE start < stop""",
)
def issue_finding_overlap(spark, folder):
    """Findings seen while an issue of their repository was open, and from when to when (days)."""
    return history.overlaps(
        views.issue_periods(spark, folder),
        views.sighting_periods(spark, folder),
        ["repo"],
        ("opened", "closed"),
        ("first_seen", "last_seen"),
    ).select("repo", "issue", "finding", "start", "stop")


@query("finding_diff", with_views(views.EDITS_SQL, select="SELECT * FROM changes"))
def finding_diff(spark, folder):
    """What became of the findings of a run after the edits that the view plants."""
    before, after = (views.edited_files(spark, folder, edited) for edited in (False, True))
    return versions.finding_diff(before, after, *(views.risk_lines(files) for files in (before, after)))


@query(
    "finding_ages",
    with_views(
        views.OBSERVATIONS_SQL,
        """sightings AS (SELECT repo, event_type AS rule, CAST(day - DATE '1970-01-01' AS BIGINT) AS day, count(*) AS seen
          FROM observations GROUP BY ALL),
        runs AS (SELECT repo, day, row_number() OVER w AS run, lead(day) OVER w AS next_run
          FROM (SELECT DISTINCT repo, day FROM sightings) WINDOW w AS (PARTITION BY repo ORDER BY day)),
        islands AS (
          SELECT s.*, next_run, run - row_number() OVER (PARTITION BY s.repo, rule ORDER BY s.day) AS island,
                 sum(seen) OVER (PARTITION BY s.repo, rule ORDER BY s.day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent
          FROM sightings s JOIN runs r ON s.repo = r.repo AND s.day = r.day),
        streaks AS (
          SELECT repo, rule, min(day) AS first_day, max(day) AS last_day, count(*) AS runs, max(recent)::BIGINT AS most_seen,
                 CASE WHEN count(next_run) < count(*) THEN NULL ELSE max(next_run) END AS gone_day
          FROM islands GROUP BY repo, rule, island)""",
        select="""SELECT repo, rule, row_number() OVER (PARTITION BY repo, rule ORDER BY first_day) AS streak, first_day, last_day, runs,
          gone_day IS NULL AS "open", gone_day - first_day AS repair_days, most_seen FROM streaks""",
    ),
)
def finding_ages(spark, folder):
    """How long findings lasted, how often they came back, and how long they took to go."""
    seen = views.table(spark, folder, "events").select(
        views.repo_of(F.col("user_id")).alias("repo"),
        F.col("event_type").alias("rule"),
        F.unix_date(F.to_date("ts")).cast("long").alias("day"),
    )
    return history.ages(seen)
