"""Joins over time: the last state before a moment, and periods that overlap.

Both take keys that may own a large part of all rows. Neither puts all rows of a key in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

#: Rows that share a key and a moment are dealt over this many places of the order.
TIES = 64
#: Rows of one key and bin beyond which the bin is split.
HOT_BIN = 10_000
#: Levels are rounded up to a multiple of this: fewer levels to look on, and bins at most 2^(this - 1) times as long as their periods.
LEVEL_STEP = 4
#: Rows are first counted by hashes of their bins to so many cells; only bins in crowded cells are counted one by one.
CELLS = 1 << 18
#: Where a period without an end stops; far behind any day, second or microsecond.
FOREVER = 1 << 62


def as_of(
    left: DataFrame, right: DataFrame, by, left_time: str, right_time: str, values, tie: str | None = None
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` that has its key, at its time or before.

    Of right rows with the same key and time the one with the greatest ``tie`` counts (else the greatest
    values). A left row without an earlier right row, or with a null key or time, gets nulls; right rows
    with a null key or time match nothing. Columns of ``left`` that are called like one of ``values`` are not allowed.

    Rows are range-partitioned over (key, time), so a hot key spreads over many slices. A slice carries
    the last right row forward on its own; what is known before a slice begins comes from one row per key and slice.
    """
    by, values = list(by), list(values)
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = [f"_key{n}" for n in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    state = F.struct(*[F.col(tie).alias("_tie")] if tie else [], *[F.col(v) for v in values])
    states = (
        right.select(*named, F.col(right_time).alias("_time"), state.alias("_state"))
        .dropna(subset=[*keys, "_time"])
        .groupBy(*keys, "_time")
        .agg(F.max("_state").alias("_state"))
    )
    rows = left.select(F.struct(*left.columns).alias("_row"), *named, F.col(left_time).alias("_time"))
    whole = ~F.greatest(*[F.col(k).isNull() for k in [*keys, "_time"]]) if keys else F.col("_time").isNotNull()
    salt = F.pmod(F.xxhash64("_row"), F.lit(TIES)).cast("int")
    both = (
        rows.where(whole)
        .select(*keys, "_time", F.lit(1).alias("_side"), salt.alias("_salt"), "_row")
        .unionByName(
            states.select(*keys, "_time", F.lit(0).alias("_side"), F.lit(-1).alias("_salt"), "_state"),
            allowMissingColumns=True,
        )
    )
    order = [*keys, "_time", "_side", "_salt"]
    # The slice of a row must not change between the two reads below, so it is written out.
    sliced = written(both.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy(*keys, "_slice").agg(
        F.max_by("_state", F.when(F.col("_side") == 0, F.col("_time"))).alias("_end")
    )
    carried = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_earlier"))
    known = (
        sliced.withColumn("_last", F.last("_state", ignorenulls=True).over(inside))
        .where("_side = 1")
        .join(carried, [*keys, "_slice"])
        .select("_row", F.coalesce("_last", "_earlier").alias("_state"))
    )
    none = F.lit(None).cast(sliced.schema["_state"].dataType)
    found = known.unionByName(rows.where(~whole).select("_row", none.alias("_state")))
    return found.select("_row.*", *[F.col("_state")[v].alias(v) for v in values])


def _level(start: Column, stop: Column) -> Column:
    """Least level in use whose bins, of 2^level, are as long as the period; it then lies in two bins at most."""
    length = stop - start
    least = F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin(length - 1)))
    return F.least(F.ceil(least / LEVEL_STEP) * LEVEL_STEP, F.lit(63)).cast("int")


def _bins(level: Column) -> Column:
    return F.sequence(
        F.call_function("shiftright", F.col("_start"), level), F.call_function("shiftright", F.col("_stop") - 1, level)
    )


def overlaps(
    left: DataFrame, right: DataFrame, by, left_period, right_period, hot_bin: int = HOT_BIN
) -> DataFrame:
    """Pairs of rows with the same key whose periods share a moment, each pair once.

    Periods are (start, stop) pairs of long columns, stop excluded; a null stop is open-ended. Rows with a
    null key or start, or an empty period, pair with nothing. The result has the columns of both sides,
    keys once, and the shared period as ``start`` and ``stop``; all those names must differ.

    A period is filed in the one or two bins of the level that fits its length, and looks for longer ones in
    the one or two bins of every level above that occurs. So a long period costs no more rows than a short
    one. A pair belongs to the bin in which the later of both starts. A bin with many rows is split; such bins are
    few and written first, so the rows are shuffled once, with the join.
    """
    by = list(by)
    names = [*by, *(c for c in left.columns if c not in by), *(c for c in right.columns if c not in by), "start", "stop"]
    if len(set(names)) < len(names):
        raise ValueError("columns of both sides must differ")

    def side(rows: DataFrame, period) -> DataFrame:
        start, stop = F.col(period[0]).cast("long"), F.coalesce(F.col(period[1]).cast("long"), F.lit(FOREVER))
        return (
            rows.select(*by, F.struct(*[c for c in rows.columns if c not in by]).alias("_row"), start.alias("_start"), stop.alias("_stop"))
            .dropna(subset=[*by, "_start"])
            .where("_start < _stop")
            .withColumn("_level", _level(F.col("_start"), F.col("_stop")))
        )

    sides = side(left, left_period), side(right, right_period)
    pairs = []
    for n, longer in enumerate(sides):
        shorter = sides[1 - n]
        levels = sorted(r["_level"] for r in longer.select("_level").distinct().collect())  # at most 63
        # Of two periods on one level, the left one is the longer.
        above = F.filter(F.lit(levels).cast("array<int>"), lambda x: (x >= F.col("_level")) if n == 0 else (x > F.col("_level")))
        filed = longer.withColumn("_bin", F.explode(_bins(F.col("_level"))))
        asked = (
            shorter.withColumn("_at", F.explode(above))
            .withColumn("_bin", F.explode(_bins(F.col("_at"))))
            .select(*by, F.col("_at").alias("_level"), "_bin", *[F.col(c).alias(f"{c}2") for c in ("_row", "_start", "_stop")])
        )
        place = [*by, "_level", "_bin"]
        cell = F.pmod(F.xxhash64(*place), F.lit(CELLS)).alias("_cell")
        full = written(filed.groupBy(cell).count().where(F.col("count") > hot_bin).select("_cell"), "cells")
        crowded = written(
            filed.select(*place, cell).join(full, "_cell", "left_semi")
            .groupBy(*place).count().where(F.col("count") > hot_bin)
            .select(*place, F.ceil(F.col("count") / hot_bin).cast("int").alias("_chunks")),
            "crowded",
        )
        chunk = F.pmod(F.xxhash64("_row", "_start", "_stop"), F.coalesce("_chunks", F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)
        filed = filed.join(crowded, place, "left").withColumn("_chunk", chunk).drop("_chunks")
        asked = asked.join(crowded, place, "left").withColumn("_chunk", F.explode(every)).drop("_chunks")
        later = F.greatest("_start", "_start2")
        # Both sides are fanned out, which Spark's estimates leave out, so neither may be broadcast.
        met = filed.join(asked.hint("merge"), [*place, "_chunk"]).where(
            (later < F.least("_stop", "_stop2")) & (F.col("_bin") == F.call_function("shiftright", later, F.col("_level")))
        )
        mine, other = ("_row", "_row2") if n == 0 else ("_row2", "_row")
        stop = F.least("_stop", "_stop2")
        pairs.append(
            met.select(
                *by, f"{mine}.*", f"{other}.*", later.alias("start"),
                F.when(stop < FOREVER, stop).alias("stop"),
            )
        )
    return pairs[0].unionByName(pairs[1])


def ages(observations: DataFrame, rule: str = "rule", days: int = 7) -> DataFrame:
    """Streaks of every finding over the runs of its repository.

    ``observations`` are (repo, rule, day) sightings, day a whole number; a repository is run on the days on which
    it has any. A streak is a finding's unbroken series of those runs. One row per streak: its number, first and
    last day, runs in it, whether it is still open, days until the run that found it gone, and the most sightings within
    any ``days`` days of it. Sightings of a day are counted first, so windows hold a row per day, however many sightings there are.
    """
    daily = observations.dropna(subset=["repo", "day"]).groupBy("repo", rule, "day").agg(F.count("*").alias("seen"))
    by_day = Window.partitionBy("repo").orderBy("day")
    runs = (
        observations.dropna(subset=["repo", "day"]).select("repo", "day").distinct()
        .withColumn("run", F.row_number().over(by_day))
        .withColumn("next_run", F.lead("day").over(by_day))
    )
    finding = Window.partitionBy("repo", rule)
    recent = finding.orderBy("day").rangeBetween(1 - days, 0)
    numbered = (
        daily.join(runs, ["repo", "day"])
        .withColumn("island", F.col("run") - F.row_number().over(finding.orderBy("day")))
        .withColumn("recent", F.sum("seen").over(recent))
    )
    streaks = numbered.groupBy("repo", rule, "island").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("runs"),
        F.max_by(F.struct("next_run"), "day").getField("next_run").alias("gone_day"),
        F.max("recent").alias("most_seen"),
    )
    return streaks.select(
        "repo",
        rule,
        F.row_number().over(finding.orderBy("first_day")).cast("long").alias("streak"),
        "first_day",
        "last_day",
        "runs",
        F.col("gone_day").isNull().alias("open"),
        (F.col("gone_day") - F.col("first_day")).alias("repair_days"),
        "most_seen",
    )
