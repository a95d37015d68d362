"""Findings of two runs set side by side: kept, moved with their line, gone, new.

A line number means little once a file was edited. The two versions of a changed file are aligned by
patience: lines that occur once in either version and keep their order are anchors, equal lines
next to anchors go with them, and what lies between is aligned the same way. A finding of the earlier
run is carried to the line that its line became.
"""

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["repo", "path"]


def increasing(numbers: list[int]) -> list[int]:
    """Places of a longest increasing run of distinct numbers, by patience: each number goes on the first pile it fits."""
    tops, last_on, before = [], [], []
    for place, number in enumerate(numbers):
        pile = bisect_left(tops, number)
        before.append(last_on[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(number)
            last_on.append(place)
        else:
            tops[pile], last_on[pile] = number, place
    out, place = [], last_on[-1] if last_on else -1
    while place >= 0:
        out.append(place)
        place = before[place]
    return out[::-1]


def aligned(old: list[str], new: list[str]) -> list[int]:
    """For every old line the number of its new line, from 1; 0 where it is gone."""
    became = [0] * len(old)
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and old[a] == new[b]:
            became[a] = b + 1
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and old[a_end - 1] == new[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            became[a_end] = b_end + 1
        if a == a_end or b == b_end:
            continue
        in_old, in_new = Counter(old[a:a_end]), Counter(new[b:b_end])
        place = {line: n for n, line in enumerate(new[b:b_end], b) if in_new[line] == 1}
        once = [n for n in range(a, a_end) if in_old[old[n]] == 1 and old[n] in place]
        anchors = [once[n] for n in increasing([place[old[n]] for n in once])]
        if not anchors:
            continue
        for n in anchors:
            became[n] = place[old[n]] + 1
        ends = [(a - 1, b - 1), *((n, place[old[n]]) for n in anchors), (a_end, b_end)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:], strict=False)]
    return became


def lines_now(old: pd.Series, new: pd.Series, asked: pd.Series) -> pd.Series:
    """Pandas UDF: where the asked lines of a file's old content are in its new one; 0 for lines that are gone or never were."""

    def of_file(was, now, lines):
        became = aligned(was.split("\n"), now.split("\n"))
        return [became[n - 1] if 0 < n <= len(became) else 0 for n in lines]

    return pd.Series([of_file(*file) for file in zip(old, new, asked, strict=True)])


def carried(files_before: DataFrame, files_after: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` (repo, path, line, ...) of the earlier run with ``now_line`` and whether their place is ``gone``.

    Unchanged files are told by digests, so only contents of changed files with findings are moved. A
    finding of a whole file or repository (null line, null path) goes with the file.
    """
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    old = files_before.select(*PLACE, digest.alias("_old"))
    new = files_after.select(*PLACE, digest.alias("_new"))
    state = old.join(new, PLACE, "left").select(
        *PLACE, F.when(F.col("_new").isNull(), "gone").when(F.col("_new") == F.col("_old"), "same").otherwise("changed").alias("_state")
    )
    asked = (
        found.where("line IS NOT NULL")
        .join(state.where("_state = 'changed'").select(*PLACE), PLACE, "left_semi")
        .groupBy(*PLACE)
        .agg(F.sort_array(F.collect_set("line")).alias("_lines"))
    )
    texts = asked.join(files_before.select(*PLACE, F.coalesce("content", F.lit("")).alias("_was")), PLACE).join(
        files_after.select(*PLACE, F.coalesce("content", F.lit("")).alias("_now")), PLACE
    )
    moves = texts.select(*PLACE, "_lines", F.pandas_udf(lines_now, "array<int>")("_was", "_now", "_lines").alias("_at")).select(
        *PLACE, F.inline(F.arrays_zip(F.col("_lines").alias("line"), F.col("_at").alias("_at")))
    )
    lost = (F.col("_state") == "gone") | ((F.col("_state") == "changed") & F.col("line").isNotNull() & (F.coalesce("_at", F.lit(0)) == 0))
    # A path that no file has is a place outside the tree and stays as it is.
    return (
        found.join(state, PLACE, "left")
        .join(moves, [*PLACE, "line"], "left")
        .select(
            *found.columns,
            F.when(F.col("_state") == "changed", F.nullif("_at", F.lit(0))).otherwise(F.col("line")).cast("int").alias("now_line"),
            F.coalesce(lost, F.lit(False)).alias("gone"),
        )
    )


def finding_diff(
    files_before: DataFrame, files_after: DataFrame, found_before: DataFrame, found_after: DataFrame, rule: str = "rule"
) -> DataFrame:
    """(repo, path, rule, was_line, now_line, change, n): what became of the findings of a run.

    Files have (repo, path, content), findings (repo, path, line, rule). Findings are the same if they are of
    one rule and one place. Where a place has several of one rule, as many are kept as either run has, so
    rows are counted and never numbered. ``change`` is kept, moved, gone or new.
    """
    before = carried(files_before, files_after, found_before)
    kept = before.where("NOT gone").select(
        *PLACE, rule, F.col("line").alias("was_line"), "now_line", F.lit(1).alias("_b"), F.lit(0).alias("_a")
    )
    after = found_after.select(
        *PLACE, rule, F.lit(None).cast("int").alias("was_line"), F.col("line").cast("int").alias("now_line"),
        F.lit(0).alias("_b"), F.lit(1).alias("_a"),
    )
    counted = (
        kept.unionByName(after)
        .groupBy(*PLACE, rule, "now_line")
        .agg(F.max("was_line").cast("int").alias("was_line"), F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    )
    none = F.lit(None).cast("int")
    moved = F.when(F.col("was_line").eqNullSafe(F.col("now_line")), "kept").otherwise("moved")

    def part(change, was, now, n):
        return F.struct(was.alias("was_line"), now.alias("now_line"), change.alias("change"), n.cast("long").alias("n"))

    parts = F.array(
        part(moved, F.col("was_line"), F.col("now_line"), F.least("_b", "_a")),
        part(F.lit("gone"), F.col("was_line"), none, F.col("_b") - F.col("_a")),
        part(F.lit("new"), none, F.col("now_line"), F.col("_a") - F.col("_b")),
    )
    met = counted.select(*PLACE, rule, F.inline(parts)).where("n > 0")
    gone = (
        before.where("gone")
        .groupBy(*PLACE, rule, F.col("line").cast("int").alias("was_line"))
        .agg(F.count("*").alias("n"))
        .select(*PLACE, rule, "was_line", none.alias("now_line"), F.lit("gone").alias("change"), "n")
    )
    return met.unionByName(gone)
