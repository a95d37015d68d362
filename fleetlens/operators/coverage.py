"""Which external scanners may run, apply, and did run, for every repository.

A repository fans out over the nine registered tools with a literal array, so every tool
appears for every repository without a join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import any_of, array_of_rows, present


def with_tools(repos: DataFrame, tools=None) -> DataFrame:
    """One row per repository and tool: tool, binary, gate, applies_when, tool_order."""
    rows = [(n, *tool) for n, tool in enumerate(tools or V.TOOLS)]
    fan = array_of_rows(["tool_order", "tool", "binary", "gate", "applies_when"], rows)
    return repos.select("*", F.explode(fan).alias("_t")).select(*repos.columns, "_t.*")


def is_disabled(disabled: Column, tool: Column) -> Column:
    return F.array_contains(disabled, tool)


def gate_open(gate: Column, security: Column, dependencies: Column) -> Column:
    return F.when(gate == "security", security).otherwise(dependencies)


def enabled(repos: DataFrame) -> DataFrame:
    """Tools each repository's settings allow.

    Needs ``disabled`` (array of tool names) and the toggles ``security`` and ``dependencies``.
    """
    return with_tools(repos).filter(
        ~is_disabled(F.col("disabled"), F.col("tool"))
        & gate_open(F.col("gate"), F.col("security"), F.col("dependencies"))
    )


def applies(rule: Column, managers: Column, manifest_count: Column) -> Column:
    """Named predicates of the registry over a repository's managers and manifests."""
    pip = F.exists(managers, lambda m: m.startswith("pip") | (m == "poetry"))
    return (
        F.when(rule == "always", F.lit(True))
        .when(rule == "has dependency files", manifest_count > 0)
        .when(rule == "uses npm", F.array_contains(managers, "npm"))
        .when(rule == "uses pnpm", F.array_contains(managers, "pnpm"))
        .when(rule == "uses pip or poetry", pip)
        .when(rule == "uses go-modules", F.array_contains(managers, "go-modules"))
        .when(rule == "uses cargo", F.array_contains(managers, "cargo"))
        .otherwise(F.lit(False))
    )


def applicability(repos: DataFrame) -> DataFrame:
    """Needs ``package_managers`` (array) and ``dependency_files`` (count)."""
    fits = applies(F.col("applies_when"), F.col("package_managers"), F.col("dependency_files"))
    return with_tools(repos).withColumn("applicable", fits)


def status_matrix(repos: DataFrame, observed: DataFrame) -> DataFrame:
    """Status of every tool for every repository; the first rule that holds decides.

    ``observed`` has (repo, tool, outcome, exit_code) for the tools found on the host; a tool
    without a row there was unavailable. It holds up to nine rows per repository, made from a column or
    two, so Spark would take it for far smaller than it is; the hint keeps it from being broadcast.
    """
    disabled = is_disabled(F.col("disabled"), F.col("tool"))
    gated = ~gate_open(F.col("gate"), F.col("security"), F.col("dependencies"))
    seen = F.col("outcome").isNotNull()
    status = (
        F.when(disabled | gated, F.lit("skipped-disabled"))
        .when(~F.col("applicable"), F.lit("skipped-not-applicable"))
        .when(~seen, F.lit("skipped-unavailable"))
        .when(F.col("outcome").isin("error", "timeout"), F.col("outcome"))
        .otherwise(F.lit("completed"))
    )
    note = (
        F.when(disabled, F.lit("Disabled in config.scanners.disabled."))
        .when(gated, F.concat(F.lit("Gated off (audit."), "gate", F.lit(" = false).")))
        .when(~F.col("applicable"), F.lit("Scanner does not apply to the detected stack."))
        .when(
            ~seen,
            F.concat(
                F.lit('Binary "'), "binary", F.lit('" not found on PATH. Install it to enable this scan.')
            ),
        )
        .when(
            (F.col("outcome") == "completed") & (F.col("exit_code") != 0),
            F.concat(
                F.lit("Exited non-zero ("), F.col("exit_code").cast("string"),
                F.lit("); many scanners use this to signal findings — inspect the output file."),
            ),
        )
        .otherwise(F.lit(""))
    )
    ran = F.col("status").isin("completed", "error", "timeout")
    return (
        applicability(repos)
        .join(observed.hint("merge"), ["repo", "tool"], "left")
        .select(
            "repo",
            "tool_order",
            "tool",
            (seen & ~(disabled | gated)).alias("available"),
            status.alias("status"),
            "exit_code",
            note.alias("note"),
        )
        .withColumn("exit_code", F.when(ran, F.col("exit_code")))
    )


def completion(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("repo").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count("*").alias("total"),
    )


def limitations(matrix: DataFrame, tested: DataFrame) -> DataFrame:
    """Caveats of each audit, in order: fixed ones, tools that were missing, no test framework.

    ``tested`` has (repo, has_tests), a row for every repository, and is not broadcast either.
    """
    missing = F.sort_array(
        F.collect_list(
            F.when(F.col("status") == "skipped-unavailable", F.struct("tool_order", "tool"))
        )
    )
    per_repo = matrix.groupBy("repo").agg(missing.alias("missing")).join(tested.hint("merge"), "repo", "left")
    names = F.array_join(F.transform("missing", lambda t: t["tool"]), ", ")
    lines = present(
        *[F.lit(text) for text in V.LIMITATIONS],
        F.when(
            F.size("missing") > 0,
            F.concat(F.lit(V.UNAVAILABLE_LIMITATION), names, F.lit(".")),
        ),
        F.when(~F.coalesce("has_tests", F.lit(False)), F.lit(V.NO_TESTS_LIMITATION)),
    )
    return per_repo.select("repo", F.posexplode(lines).alias("pos", "limitation")).select(
        "repo", (F.col("pos") + 1).alias("ordinal"), "limitation"
    )


def scoped_toggles(security: Column, api: Column, toggles: dict) -> dict:
    """Audit toggles after the scope flags: each flag switches its own group on and, if any flag
    is given, everything else off. Without flags the toggles stay as they are.
    """
    flags = {"security": security, "api": api}
    any_flag = security | api
    result = {}
    for toggle in V.AUDIT_TOGGLES:
        given = [flags[s] for s, members in V.SCOPE_TOGGLES.items() if toggle in members]
        chosen = any_of(given) if given else F.lit(False)
        result[toggle] = F.when(any_flag, chosen).otherwise(toggles[toggle])
    return result


def scope_matrix(repos: DataFrame) -> DataFrame:
    """Toggles and allowed tools under each repository's scope flags.

    Needs the flag columns ``scope_security`` and ``scope_api`` and one column per toggle.
    """
    toggles = scoped_toggles(
        F.col("scope_security"), F.col("scope_api"), {t: F.col(t) for t in V.AUDIT_TOGGLES}
    )
    scoped = repos.select("repo", *[value.alias(name) for name, value in toggles.items()])
    allowed = gate_open(F.col("gate"), F.col("security"), F.col("dependencies"))
    return with_tools(scoped).withColumn("allowed", allowed)
