"""Thousands of rules in one pass: what a pattern must contain is looked for first.

Every rule's pattern is parsed, and a set of literals is taken from it one of which each match holds. A single
automaton over the literals of all rules goes once through every line; a rule's pattern is only tried on lines with one
of its literals. Rules without such literals are named by ``without_literals`` and run as one pass of plain patterns.
"""

import re
import warnings
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..sources.files import explode_lines
from . import scanners

#: Characters of the shortest literal worth looking for.
SHORTEST = 3
#: Characters of literals in one automaton; a larger rule table takes several.
AUTOMATON_CHARS = 1 << 22
#: Most alternatives that a rule may bring.
ALTERNATIVES = 64


def literals(pattern: str, shortest: int = SHORTEST) -> list[str] | None:
    """Texts in lower case one of which every match of ``pattern`` holds, whatever the case; None if none is sure.

    Only ASCII characters count, since other letters change in more ways than case. A pattern that can't be
    parsed here may still be one for the scan.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    found = _needed(parsed)
    if not found or len(found) > ALTERNATIVES or min(map(len, found)) < shortest:
        return None
    return sorted(found)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest text is longer."""
    if not a or not b:
        return a or b
    return a if (min(map(len, a)), -len(a)) >= (min(map(len, b)), -len(b)) else b


def _needed(items) -> set[str] | None:
    best: set[str] | None = None
    run = ""
    for kind, value in items:
        if kind is C.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        best, run = _better(best, {run} if run else None), ""
        if kind is C.SUBPATTERN:
            best = _better(best, _needed(value[3]))
        elif kind is C.ATOMIC_GROUP:
            best = _better(best, _needed(value))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _needed(value[2]))
        elif kind is C.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            if all(each):
                best = _better(best, set().union(*each))
    return _better(best, {run} if run else None)


def with_literals(rules: DataFrame) -> DataFrame:
    """``rules`` (rule_no, label, severity, pattern, fix) with the array ``literals``, null for those that have none."""

    def parse(batches):
        for batch in batches:
            found = [literals(p) if p is not None else None for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "literals"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema)
    return rules.mapInArrow(parse, f"{kind}, literals array<string>")


def without_literals(indexed: DataFrame) -> DataFrame:
    return indexed.where("literals IS NULL AND pattern IS NOT NULL").drop("literals")


def _meets(lines: DataFrame, words: list[tuple[str, list[int]]]) -> DataFrame:
    """``lines`` that hold one of the words, with the numbers of the rules that ask for it."""
    import ahocorasick

    def search(batches):
        automaton = ahocorasick.Automaton()
        for word, numbers in words:
            automaton.add_word(word, numbers)
        automaton.make_automaton()
        for batch in batches:
            at, asked = [], []
            for k, line in enumerate(batch.column("line").to_pylist()):
                found = {n for _, numbers in automaton.iter(line.lower()) for n in numbers} if line else None
                if found:
                    at.append(k)
                    asked.append(sorted(found))
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(asked, pa.list_(pa.int64()))], [*some.schema.names, "_rules"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(search, f"{kind}, _rules array<long>")


def scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (file, line, rule) that matches: the columns of ``files`` but the content, then line_no, rule_no, label, severity, fix.

    ``rules`` have (rule_no, label, severity, pattern, fix); rule numbers are unique. Rules without a pattern match
    nothing. Rules without literals go through ``scanners.custom_rules``, which must read the contents once more for
    every 200 of them.
    """
    indexed = written(with_literals(rules.select(F.col("rule_no").cast("long").alias("rule_no"), "label", "severity", "pattern", "fix")), "rules")
    words = (
        indexed.select("rule_no", F.explode("literals").alias("word"))
        .groupBy("word")
        .agg(F.sort_array(F.collect_list("rule_no")).alias("numbers"))
        .withColumn("chars", F.char_length("word") + 8 * F.size("numbers"))
    )
    total = words.agg(F.sum("chars")).first()[0] or 0
    passes = -(-total // AUTOMATON_CHARS)  # one, unless the literals themselves are large
    lines = explode_lines(files)
    keys = [c for c in lines.columns if c != "line"]
    told = indexed.where("literals IS NOT NULL").drop("literals").withColumnRenamed("rule_no", "_rule")
    hits = []
    for part in range(passes):
        mine = words.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == part).select("word", "numbers").toLocalIterator()
        met = _meets(lines, [(r["word"], list(r["numbers"])) for r in mine])
        hits.append(met.select(*keys, "line", F.explode("_rules").alias("_rule")))
    plain = [tuple(r) for r in without_literals(indexed).orderBy("rule_no").collect()]
    out = None
    if hits:
        asked = hits[0]
        for more in hits[1:]:
            asked = asked.unionByName(more)
        if len(hits) > 1:  # a rule whose literals are in several parts meets a line in each
            asked = asked.distinct()
        out = (
            asked.join(told, "_rule")
            .where(F.regexp_like("line", F.col("pattern")))
            .select(*keys, F.col("_rule").alias("rule_no"), "label", "severity", "fix")
        )
    if plain or out is None:
        numbers = F.array(*[F.lit(r[0]).cast("long") for r in plain]) if plain else F.array(F.lit(0).cast("long"))
        rest = scanners.custom_rules(files, [r[1:] for r in plain]).withColumn("rule_no", F.get(numbers, F.col("rule_no")))
        rest = rest.select(*keys, "rule_no", "label", "severity", "fix")
        out = rest if out is None else out.unionByName(rest)
    return out
