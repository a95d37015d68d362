"""Licence scans with DataFrame operations only: sparse TF-IDF cosine, then inheritance along paths.

Units are the lines of every file, windows of two to four neighbouring lines (for statements that are
wrapped) and, for licence files, the whole text as well. Units and
templates are TF-IDF vectors over tokens, with document frequencies from the templates; the tokens
of a unit are joined to the postings of the templates, and dot products summed per unit and
template. A file's licence is the template with the highest cosine of its units, if that reaches
a threshold. A file without one takes that of the nearest directory above it that holds a
licence file: every directory is joined with its ancestors by path.

Before tokens are joined, a unit must pass three bounds. The first needs no template: what its tokens weigh at most in
any template, over the root of the sum of their squared weights. Each line is cut into tokens once; this bound of
windows and whole texts adds up from those of their lines. The second takes the squares of what a token's copies weigh
together, also over several lines; the third the greatest dot product with one statement. No cosine is above its bounds,
so no unit is lost, and only units that are all but sure to be statements become rows: lists of tokens and windows stay inside their row.

Edge cases: null and empty texts have no units but inherit. A null path has no directory and the
result of all null paths together. Rows with the same path
are one file, whose licence is the best of any of them; their lines are never put together. Ties go to the first licence by name. An empty
path part counts as a directory. Other columns pass through, except those named like results.
"""

import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import lookup, written

#: Licences named by an SPDX line, and the text of one licence that has no title in many files. Fixed values.
SPDX = ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0")
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: (licence, statement), fixed values. Several statements may stand for one licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved. Proprietary and confidential. Unauthorized copying is prohibited"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying is prohibited"),
    # Titles, some with their date, which keeps versions apart. One without a version counts as the closest one.
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    # Notices and whole texts.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MIT", MIT_TEXT),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
]
THRESHOLD = 0.75
#: Most neighbouring lines that are compared as one unit.
LINES = 4
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"


def vectors(templates=TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, statement number, token, weight) with unit length, idf per token, idf of other tokens."""
    bags = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    spread = Counter(token for bag in bags for token in bag)
    total = len(bags)
    idf = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in spread.items()}
    rows = []
    for k, ((licence, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(licence, k, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return rows, idf, math.log(1 + total) + 1


def bounds(rows, idf: dict[str, float]) -> dict[str, tuple[float, float, list[float]]]:
    """For each template token what one occurrence adds at most to a dot product, the square of its idf, and what it adds to each statement's."""
    each = {t: [0.0] * (1 + max(k for _, k, _, _ in rows)) for t in idf}
    for _, k, token, weight in rows:
        each[token][k] = weight * idf[token]
    return {t: (max(dots), idf[t] ** 2, dots) for t, dots in each.items()}


def candidates(files: DataFrame, rows, idf: dict[str, float], other: float, threshold: float) -> DataFrame:
    """(row, path, line, unit): units whose bounds reach the threshold."""
    table = bounds(rows, idf)
    weights = F.from_json(F.lit(json.dumps({t: {"d": d, "s": s} for t, (d, s, _) in table.items()})), "map<string,struct<d:double,s:double>>")
    dots_of = F.from_json(F.lit(json.dumps({t: dots for t, (_, _, dots) in table.items()})), "map<string,array<double>>")
    nothing = F.array_repeat(F.lit(0.0), len(next(iter(table.values()))[2]))

    def weighed(unknown, known):
        """Bounds of a unit from the number of its other tokens and its template tokens, sorted: k copies of one add k * k squares."""

        def step(x, t):
            copy, w = F.when(x["last"] == t, x["copy"] + 1).otherwise(1), F.try_element_at(weights, t)
            return F.struct(t.alias("last"), copy.alias("copy"), (x["d"] + w["d"]).alias("d"), (x["s"] + (2 * copy - 1) * w["s"]).alias("s"))

        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("copy"), F.lit(0.0).alias("d"), (unknown * other**2).alias("s"))
        return F.aggregate(known, start, step)

    def reached(x):
        return (x["s"] > 0) & (x["d"] >= (threshold - 1e-9) * F.sqrt(x["s"]))

    def close(x):
        """The greatest dot product with one statement, over the same length."""
        dots = F.aggregate(x["known"], nothing, lambda sums, t: F.zip_with(sums, F.try_element_at(dots_of, t), lambda u, v: u + v))
        return F.array_max(dots) >= (threshold - 1e-9) * F.sqrt(x["sum"]["s"])

    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    # Each list is made by a step of its own, so that it is made once though later steps look at it more than once.
    lines = F.split("text", "\n")
    tokens = F.transform(lines, lambda line: F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0)))
    split = F.transform(tokens, lambda t: F.struct(F.size(t).alias("n"), F.sort_array(F.filter(t, lambda x: x.isin(list(idf)))).alias("known")))
    counted = F.transform(split, lambda x: F.struct((x["n"] - F.size(x["known"])).alias("unknown"), x["known"].alias("known")))
    parts = F.transform(
        counted, lambda x: F.struct(x["unknown"].alias("unknown"), x["known"].alias("known"), weighed(x["unknown"], x["known"]).alias("sum"))
    )
    cut = files.where("text IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"),
        "path",
        named.alias("named"),
        F.inline(F.array(F.struct(lines.alias("lines"), parts.alias("parts")))),
    )
    n = F.size("lines")

    def passing(places, size):
        """``places`` where a unit of ``size`` lines may reach the threshold: by what its lines add up to, then by its own copies, then by one statement."""

        def added(i):
            none = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))
            return F.aggregate(
                F.slice("parts", i, size), none, lambda x, y: F.struct((x["d"] + y["sum"]["d"]).alias("d"), (x["s"] + y["sum"]["s"]).alias("s"))
            )

        def merged(i):
            held = F.slice("parts", i, size)
            return F.struct(
                i.alias("at"),
                F.aggregate(held, F.lit(0), lambda x, y: x + y["unknown"]).alias("unknown"),
                F.sort_array(F.flatten(F.transform(held, lambda y: y["known"]))).alias("known"),
            )

        units = F.transform(F.filter(places, lambda i: reached(added(i))), merged)
        whole = F.transform(units, lambda x: F.struct(x["at"].alias("at"), x["known"].alias("known"), weighed(x["unknown"], x["known"]).alias("sum")))
        near = F.filter(whole, lambda x: reached(x["sum"]))
        return F.transform(F.filter(near, close), lambda x: F.struct(x["at"].alias("at"), F.lit(size).alias("size")))

    def windows(size: int):
        """Windows of ``size`` lines; shorter ones at the end are units of a smaller size."""
        return passing(F.when(n >= size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>")), size)

    whole = passing(F.when(F.col("named"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), n)
    units = F.concat(*[windows(k) for k in range(1, LINES + 1)], whole)
    return cut.select("row", "path", "lines", F.explode(units).alias("u")).select(
        "row",
        "path",
        F.struct("u.at", "u.size").alias("line"),
        F.array_join(F.slice("lines", F.col("u.at"), F.col("u.size")), "\n").alias("unit"),
    )


def headers(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score) of the files with a licence of their own."""
    spark = files.sparkSession
    rows, idf, other = vectors(templates)
    postings = lookup(spark, ["licence", "statement", "token", "weight"], rows)
    weights = lookup(spark, ["token", "idf"], sorted(idf.items()))
    tokens = F.regexp_extract_all(F.lower("unit"), F.lit(TOKEN), F.lit(0))
    # Row numbers hold for one run only, so the units are written before both sides of a join read them.
    units = written(candidates(files, rows, idf, other, threshold), "units")
    counted = (
        units.select("row", "path", "line", F.explode(tokens).alias("token"))
        .groupBy("row", "path", "line", "token")
        .agg(F.count("*").alias("tf"))
        .join(weights, "token", "left")
        .withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other)))
        .drop("idf")
    )
    # One row per unit and template it shares a token with, and one without a template for the length.
    unit = ["row", "line"]
    dots = counted.join(postings, "token").select(*unit, "path", "licence", "statement", (F.col("value") * F.col("weight")).alias("dot"))
    lengths = counted.groupBy(*unit).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    scores = dots.groupBy(*unit, "path", "licence", "statement").agg(F.sum("dot").alias("dot"))
    best = F.max_by(F.struct("licence", "score"), F.struct("score", F.col("back")))
    return (
        scores.join(lengths, unit)
        .select("path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
        .where(F.col("score") >= threshold)
        .withColumn("back", F.lit(0) - F.array_position(F.array(*[F.lit(x) for x in sorted({t for t, _ in templates})]), F.col("licence")))
        .groupBy("path")
        .agg(best.alias("best"))
        .select("path", "best.licence", "best.score")
    )


def directory(path):
    """Everything before the last slash; null for a path without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """(dir, licence, from_dir): for every directory the licence of the nearest one at or above it."""
    name = F.element_at(F.split("path", "/"), -1)
    score = F.struct("score", "licence")
    holders = (
        own.where(name.rlike(LICENCE_FILE))
        .withColumn("holder", F.coalesce(directory(F.col("path")), F.lit("")))
        .groupBy("holder")
        .agg(F.max_by("licence", score).alias("licence"))
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))
    dirs = files.where(F.col("path").isNotNull()).select(
        F.coalesce(directory(F.col("path")), F.lit("")).alias("dir")
    ).distinct()
    return (
        dirs.select("dir", F.explode(F.array_distinct(chain)).alias("holder"))
        .join(holders, "holder")
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence", "holder"), F.length("holder")).alias("near"))
        .select("dir", "near.licence", F.col("near.holder").alias("from_dir"))
    )


def scanned(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with licence, score (null if inherited), origin (header, directory or null) and from_dir."""
    made = ("licence", "score", "origin", "from_dir")
    own = written(headers(files.select("path", "text"), templates, threshold), "headers")
    near = written(inherited(files.select("path"), own), "directories")
    o = own.select(F.col("path").alias("_path"), F.col("licence").alias("_own"), F.col("score").alias("_score"))
    n = near.select(F.col("dir").alias("_dir"), F.col("licence").alias("_near"), F.col("from_dir").alias("_from"))
    origin = F.when(F.col("_own").isNotNull(), "header").when(F.col("_near").isNotNull(), "directory")
    return (
        files.drop(*made)
        .join(o, F.col("path").eqNullSafe(F.col("_path")), "left")
        .join(n, F.when(F.col("path").isNotNull(), F.coalesce(directory(F.col("path")), F.lit(""))) == F.col("_dir"), "left")
        .withColumns({
            "licence": F.coalesce("_own", "_near"),
            "score": F.col("_score"),
            "origin": origin,
            "from_dir": F.when(F.col("_own").isNull(), F.col("_from")),
        })
        .drop("_path", "_own", "_score", "_dir", "_near", "_from")
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of their source: hundreds of ids share a directory, thousands its parent, and the
    first id of a hundred is the directory's licence file."""
    i = F.col("doc_id")
    unnamed = F.concat(F.lit("no-id-"), F.md5(F.coalesce("text", F.lit(""))))  # a row without an id is a file of its own
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.coalesce(i.cast("string"), unnamed), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(i / 1000), F.floor(i / 100), name)
    return docs.withColumn("path", path)
