"""Structured Streaming jobs: line scan, re-observation removal, issue life cycle, daily counts.

Each job takes a streaming DataFrame and gives one back; ``run_to_table`` drains what is
available into parquet. Checkpoints and sinks live in the shared folder.
"""

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as V
from ..functions.tables import fresh_path
from ..operators.scanners import SECRET_LINE, secret_hits
from ..sources.files import lines_matching

DEDUP_SALTS = 32


def stream_table(spark: SparkSession, folder: str, file_name: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream the parquet files called ``file_name`` in ``folder`` with their stored schema."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process everything available, then read the sink as a batch table.

    With the ``path`` of an earlier run, goes on from its checkpoint and adds to its sink.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/sink")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/sink")


def utc_instant(ts):
    """A zone-less wall-clock time as the instant at which UTC clocks show it."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def scan(texts: DataFrame) -> DataFrame:
    """Secrets in arriving texts (key columns and ``content``). Stateless."""
    return secret_hits(lines_matching(texts, SECRET_LINE))


def dedup(observations: DataFrame, keys, spread: str, delay: str) -> DataFrame:
    """First sight of every key within the watermark delay.

    A finding seen again and again would send all its rows to one state store. They are first
    reduced within salts taken from ``spread``, a column that varies among copies, so the second
    step sees at most one row per salt.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(DEDUP_SALTS)).alias("_salt")
    timed = observations.select(*keys, "run_ts", salt).withWatermark("run_ts", delay)
    return (
        timed.dropDuplicatesWithinWatermark([*keys, "_salt"])
        .dropDuplicatesWithinWatermark(list(keys))
        .select(*keys)
    )


def daily_counts(observations: DataFrame, delay: str) -> DataFrame:
    """Observations per day and severity; a day appears once the watermark has passed it."""
    return (
        observations.withWatermark("run_ts", delay)
        .groupBy(F.window("run_ts", "1 day").alias("w"), "severity")
        .agg(F.count("*").alias("findings"))
        .select(
            F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("day"),
            "severity",
            "findings",
        )
    )


MUTATIONS = "repo string, day date, active boolean, mutation string"
OPEN_STATE = "is_open boolean"
#: Change of an issue by whether it was and is open.
CHANGES = {(False, False): "noop", (False, True): "create", (True, True): "update", (True, False): "close"}
EPOCH = date(1970, 1, 1).toordinal()


def issue_states(runs: DataFrame) -> DataFrame:
    """Issue changes of arriving audit runs, one (repo, day, active) row per run.

    Findings are counted into runs before they get here, so a repository brings one small row
    per day whatever its size.
    """

    def advance(key, batches, state: GroupState):
        """Walk a repository's runs in day order, carrying whether its issue is open."""
        rows = [row for batch in batches for row in zip(batch["day"].tolist(), batch["active"].tolist(), strict=True)]
        rows.sort(key=lambda row: (row[0] is None, row[0]))
        is_open = bool(state.get[0]) if state.exists else False
        out = []
        # Plain lists: a repository has few days in a batch, and pandas costs more than the walk.
        for day, active in rows:
            was_open, is_open = is_open, bool(active)
            out.append((key[0], day, is_open, CHANGES[was_open, is_open]))
        state.update((is_open,))
        yield pd.DataFrame(out, columns=["repo", "day", "active", "mutation"])

    return runs.groupBy("repo").applyInPandasWithState(
        advance, MUTATIONS, OPEN_STATE, "append", GroupStateTimeout.NoTimeout
    )


def audit_runs(observations: DataFrame) -> DataFrame:
    """Batch: one run per repository and day, active when it has a critical or high finding."""
    urgent = F.col("severity").isin(V.SEVERITIES[:2])
    return observations.groupBy("repo", "day").agg(F.bool_or(urgent).alias("active"))


# --- issue life cycle with late days ----------------------------------------------------------------

#: Days of a repository that stay in the state, counted back from its last one; a day that comes later than that is new.
KEPT_DAYS = 400
CORRECTIONS = "repo string, day date, active boolean, mutation string, version long"
DAY_STATE = "days array<int>, actives array<boolean>, versions array<long>"


def corrected(known: dict[int, tuple[bool, int]], fresh: dict[int, bool]):
    """Rows (day, active, mutation, version) that ``fresh`` days bring about, and the days known after them.

    A day's change depends on itself and the day before it, so only new days and the ones after them can differ.
    """
    active = {day: a for day, (a, _) in known.items()} | fresh
    versions = {day: version for day, (_, version) in known.items()}
    order = sorted(active)
    before = dict(zip(order[1:], order, strict=False))
    touched = {d for d in fresh if d not in known or known[d][0] != fresh[d]}
    touched |= {d for d in order if before.get(d) in touched}
    out = []
    for day in sorted(touched):
        was = day in before and active[before[day]]
        mutation = CHANGES[bool(was), bool(active[day])]
        versions[day] = versions.get(day, -1) + 1
        out.append((day, active[day], mutation, versions[day]))
    first = order[-1] - KEPT_DAYS if order else 0
    return out, {day: (active[day], versions[day]) for day in order if day >= first}


def issue_corrections(runs: DataFrame) -> DataFrame:
    """Issue changes of arriving (repo, day, active) runs in any order of days, one per repository and day.

    A day that comes late is put in its place and the day after it told again, with a higher version.
    """

    def advance(key, batches, state: GroupState):
        known = {d: (a, v) for d, a, v in zip(*state.get, strict=True)} if state.exists else {}
        fresh = {}
        for batch in batches:
            fresh |= {d.toordinal() - EPOCH: bool(a) for d, a in zip(batch["day"].tolist(), batch["active"].tolist(), strict=True)}
        rows, known = corrected(known, fresh)
        days = sorted(known)
        state.update((days, [known[d][0] for d in days], [known[d][1] for d in days]))
        out = [(key[0], date.fromordinal(day + EPOCH), *rest) for day, *rest in rows]
        yield pd.DataFrame(out, columns=["repo", "day", "active", "mutation", "version"])

    return runs.groupBy("repo").applyInPandasWithState(
        advance, CORRECTIONS, DAY_STATE, "append", GroupStateTimeout.NoTimeout
    )


def latest(corrections: DataFrame) -> DataFrame:
    """The last version of every day."""
    row = F.max_by(F.struct("active", "mutation"), "version").alias("row")
    return corrections.groupBy("repo", "day").agg(row).select("repo", "day", "row.*")


# --- runs and the findings that follow them ---------------------------------------------------------

def run_findings(runs: DataFrame, found: DataFrame, within: str, delay: str) -> DataFrame:
    """Findings (repo, finding, found_ts) of each run (repo, run_id, run_ts): those ``within`` a time after it.

    A run that stays without findings gives one row without a finding, once the watermark of both sides is past its time.
    """
    return runs.withWatermark("run_ts", delay).join(
        found.withColumnRenamed("repo", "_repo").withWatermark("found_ts", delay),
        F.expr(f"repo = _repo AND found_ts >= run_ts AND found_ts < run_ts + INTERVAL {within}"),
        "left_outer",
    ).select("repo", "run_id", "finding")


# --- a table kept by batches ------------------------------------------------------------------------

def committed(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches that the ledger holds."""
    rows = spark.read.schema("batch long, row_count long").parquet(f"{path}/ledger") if _exists(spark, f"{path}/ledger") else None
    return set() if rows is None else {r["batch"] for r in rows.select("batch").collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def commit(spark: SparkSession, path: str, batch: int, rows: int) -> None:
    """One ledger file per batch, whole or not there."""
    line = spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(rows).cast("long").alias("row_count"))
    line.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/of={batch}")


def keep_table(stream: DataFrame, path: str, commit: Callable = commit) -> None:
    """Add everything available to the table at ``path``, each row once whatever fails.

    A batch overwrites its own partition and is then entered in the ledger. A batch that is replayed after a
    failure finds itself in the ledger, or writes the same partition again; readers see entered batches only.
    """
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int):
        if batch in committed(spark, path):
            return
        (
            rows.withColumn("batch", F.lit(batch).cast("long"))
            .write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
        )
        written_rows = spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{path}/rows").where(F.col("batch") == batch).count()
        commit(spark, path, batch, written_rows)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def kept_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the entered batches."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.where(F.col("batch").isin(sorted(committed(spark, path)))).drop("batch")
