"""Small Column builders shared by the operators. All stay inside whole-stage codegen."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, parts) -> Column:
    """True when any of the fixed ``parts`` occurs; one alternation instead of many searches."""
    return text.rlike("|".join(re.escape(p) for p in parts))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased text after the last dot of the base name; NULL without a dot."""
    base = basename(path)
    return F.when(base.contains("."), F.lower(F.substring_index(base, ".", -1)))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot. A dot that opens the name starts no extension."""
    dotted = F.locate(".", basename(path), 2) > 0
    return F.when(dotted, F.concat(F.lit("."), suffix(path))).otherwise(F.lit(""))


def filled(text: Column) -> Column:
    """NULL for an empty string, so that ``coalesce`` can fall through it."""
    return F.nullif(text, F.lit(""))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(words) -> str:
    return ", ".join(quoted(w) for w in words)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for informational, NULL for anything else."""
    position = F.array_position(F.expr(f"array({literals(V.SEVERITIES)})"), severity)
    return F.nullif(position, F.lit(0).cast("long")) - 1


def looked_up(key: Column, table: dict) -> Column:
    """Value of ``key`` in a short fixed table, or NULL."""
    pairs = literals(x for item in table.items() for x in item)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def fact_cases(concern: str, test: str, table: dict) -> list[str]:
    """SQL giving ``concern:label`` for every keyword that passes ``test`` (``{}`` = the keyword)."""
    return [
        f"CASE WHEN {test.format(quoted(word))} THEN {quoted(f'{concern}:{label}')} END"
        for word, label in table.items()
    ]


def normal_severity(spelling: Column) -> Column:
    """Severity for any tool's spelling of it; unknown spellings count as medium."""
    lowered = F.lower(F.coalesce(spelling, F.lit("")))
    return F.coalesce(looked_up(lowered, V.SEVERITY_SPELLINGS), F.lit(V.SEVERITY_FALLBACK))


def sarif_level(severity: Column) -> Column:
    return looked_up(severity, V.SARIF_LEVEL)


def line_number(text: Column) -> Column:
    """A positive whole number written as text, else NULL. Accepts '10', '10.0' and '1e1'."""
    numeric = text.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z")
    number = F.when(numeric, F.trim(text).try_cast("double"))
    whole = (number > 0) & (number == F.floor(number)) & (number <= 2147483647)
    return F.when(whole, number.cast("int"))


def finding_id(area, number: Column) -> Column:
    return F.format_string(V.FINDING_ID_FORMAT.format(area=area), number)


def is_active(status: Column) -> Column:
    return status != "rejected"


def array_of_rows(fields, rows) -> Column:
    """Literal array of structs, for fanning a row out over a short fixed list."""
    def cell(value):
        return quoted(value) if isinstance(value, str) else str(value)

    structs = [
        "named_struct(" + ", ".join(f"'{f}', {cell(v)}" for f, v in zip(fields, row, strict=True)) + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def present(*conditional) -> Column:
    """Array of the given columns without the NULL ones, keeping their order."""
    return F.array_compact(F.array(*conditional))


def explode_present(df: DataFrame, keep, columns, name: str) -> DataFrame:
    """One row per given column that is not NULL. Stays in generated code, unlike array_compact."""
    return df.select(*keep, F.explode(F.array(*columns)).alias(name)).filter(F.col(name).isNotNull())
