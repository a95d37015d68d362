"""What each repository is made of: languages, managers, frameworks, stores, routes.

Labels come from short fixed lists, so they are found row by row with literal expressions and
only (repo, label) pairs are shuffled, after map-side de-duplication. Lists of paths have no
bound per repository and therefore stay rows.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import (
    basename,
    contains_any,
    explode_present,
    extension,
    fact_cases,
    literals,
    looked_up,
    present,
    quoted,
    suffix,
)
from ..sources.files import is_route_file, lines_matching

MANIFEST_SCHEMA = (
    "dependencies map<string,string>, devDependencies map<string,string>, "
    "peerDependencies map<string,string>"
)
STRICT_JSON = {"allowSingleQuotes": "false"}
DEPENDENCY_BLOCKS = ["dependencies", "devDependencies", "peerDependencies"]
PATH_COUNTS = [
    "file_count", "dependency_files", "ci_workflows", "infra_files", "auth_files", "config_files",
]
# Manifests whose content discovery reads.
READ_MANIFESTS = ["package.json", *V.KEYWORD_MANIFESTS]


# --- labels from paths ---------------------------------------------------------------------

def languages(files: DataFrame) -> DataFrame:
    language = looked_up(extension(F.col("path")), V.LANGUAGE_BY_EXTENSION)
    return (
        files.select("repo", language.alias("language")).filter("language IS NOT NULL").distinct()
    )


def package_managers(files: DataFrame) -> DataFrame:
    """Managers by file name, npm where a package.json has no Node manager beside it."""
    return path_summary(files).select("repo", F.explode("package_managers").alias("package_manager"))


def dependency_files(files: DataFrame) -> DataFrame:
    return files.filter(basename(F.col("path")).isin(V.DEPENDENCY_FILES)).select("repo", "path")


def _starts_with(parts) -> str:
    return "^(?:" + "|".join(re.escape(p) for p in parts) + ")"


def _ends_with(parts) -> str:
    return "(?:" + "|".join(re.escape(p) for p in parts) + r")\z"


def is_ci_file(path: Column) -> Column:
    return path.isin(V.CI_PATHS) | path.rlike(_starts_with(V.CI_PREFIXES))


def is_infra_file(path: Column) -> Column:
    base = basename(path)
    return (
        base.isin(V.INFRA_NAMES)
        | base.startswith("Dockerfile.")
        | path.rlike(_ends_with(V.INFRA_SUFFIXES))
        | contains_any(path, V.INFRA_PATH_PARTS)
    )


def is_auth_file(path: Column) -> Column:
    return suffix(path).isin(V.AUTH_CODE_SUFFIXES) & contains_any(F.lower(path), V.AUTH_PATH_HINTS)


def is_config_file(path: Column) -> Column:
    base = basename(path)
    return (
        base.startswith(".env")
        | suffix(path).isin(V.CONFIG_SUFFIXES)
        | (base == "config.json")
        | base.endswith(".config.js")
        | base.endswith(".config.ts")
    )


def paths_where(files: DataFrame, test) -> DataFrame:
    return files.filter(test(F.col("path"))).select("repo", "path")


def path_lists(paths: DataFrame) -> DataFrame:
    """(repo, concern, path): the files behind the counts of a profile, one row per file and concern."""
    path = F.col("path")
    tests = {
        "dependency_files": basename(path).isin(V.DEPENDENCY_FILES),
        "ci_workflows": is_ci_file(path),
        "infra_files": is_infra_file(path),
        "auth_files": is_auth_file(path),
        "config_files": is_config_file(path),
    }
    concerns = [F.when(test, F.lit(concern)) for concern, test in tests.items()]
    return explode_present(paths, ["repo", "path"], concerns, "concern").select("repo", "concern", "path")


def path_summary(paths: DataFrame) -> DataFrame:
    """What file names alone tell, in one aggregation per repository.

    Sets are over fixed vocabularies; path lists only leave their lengths.
    """
    path = F.col("path")
    base = basename(path)
    node = F.expr(f"array({literals(V.NODE_PACKAGE_MANAGERS)})")
    seen = paths.groupBy("repo").agg(
        F.count("*").alias("file_count"),
        F.count_if(base.isin(V.DEPENDENCY_FILES)).alias("dependency_files"),
        F.count_if(is_ci_file(path)).alias("ci_workflows"),
        F.count_if(is_infra_file(path)).alias("infra_files"),
        F.count_if(is_auth_file(path)).alias("auth_files"),
        F.count_if(is_config_file(path)).alias("config_files"),
        F.collect_set(looked_up(extension(path), V.LANGUAGE_BY_EXTENSION)).alias("languages"),
        F.collect_set(looked_up(base, V.PACKAGE_MANAGER_BY_FILE)).alias("named"),
        F.bool_or(base == "package.json").alias("has_package"),
        F.bool_or(path.endswith(".py") & path.rlike(V.PYTHON_TEST_FILE_PATTERN)).alias("py"),
        F.bool_or(base == "go.mod").alias("go"),
        F.bool_or(path.endswith("_test.go")).alias("go_test"),
        F.bool_or(base == "Cargo.toml").alias("rust"),
    )
    # A package.json without any Node manager implies npm.
    managers = F.when(
        F.col("has_package") & ~F.arrays_overlap("named", node), F.array_append("named", F.lit("npm"))
    ).otherwise(F.col("named"))
    tools = present(
        F.when(F.col("py"), F.lit("pytest")),
        F.when(F.col("go") & F.col("go_test"), F.lit("go test")),
        F.when(F.col("rust"), F.lit("cargo test")),
    )
    return seen.select(
        "repo", *PATH_COUNTS, "languages", managers.alias("package_managers"), tools.alias("test_tools")
    )


# --- manifests -------------------------------------------------------------------------------

def package_manifests(files: DataFrame) -> DataFrame:
    """package.json files parsed; ``valid`` is false when the text is not JSON."""
    # ``inline`` keeps the parse in one place; separate field accesses would each parse again.
    return files.filter(basename(F.col("path")) == "package.json").select(
        "repo",
        "path",
        "content",
        F.try_parse_json("content").isNotNull().alias("valid"),
        F.inline(F.array(F.from_json("content", MANIFEST_SCHEMA, STRICT_JSON))),
    )


def declared_dependencies(manifests: DataFrame) -> DataFrame:
    """Every declared (repo, path, dep), repeats included."""
    keys = [
        F.coalesce(F.map_keys(block), F.array().cast("array<string>"))
        for block in DEPENDENCY_BLOCKS
    ]
    return manifests.select("repo", "path", F.explode(F.concat(*keys)).alias("dep"))


def node_dependencies(files: DataFrame) -> DataFrame:
    return declared_dependencies(package_manifests(files)).select("repo", "dep").distinct()


def _lines(cases) -> str:
    return f"concat_ws('\\n', {', '.join(cases)})"


def _as_facts(rows: DataFrame, cases) -> DataFrame:
    """One (repo, concern, label) row per case that holds, repeats included.

    The cases are joined into one text in generated code. Nearly all rows give an empty text and
    are dropped before anything is exploded.
    """
    # The filter stays above the generator, so the cases are computed once.
    facts = F.expr(_lines(cases)).alias("facts")
    found = rows.select("repo", F.inline(F.array(F.struct(facts))))
    return (
        found.filter("facts <> ''")
        .select("repo", F.explode(F.split("facts", "\n")).alias("fact"))
        .select(
            "repo",
            F.substring_index("fact", ":", 1).alias("concern"),
            F.regexp_replace("fact", "^[a-z_]+:", "").alias("label"),
        )
    )


EXACT, NAMED, MENTIONED = "dep = {}", "startswith(dep, {})", "contains(lowered, {})"
FRAMEWORK_CASES = [
    *fact_cases("framework", EXACT, V.NODE_UI_FRAMEWORKS),
    *fact_cases("framework", EXACT, V.NODE_API_FRAMEWORKS),
    *fact_cases("api_framework", EXACT, V.NODE_API_FRAMEWORKS),
    *fact_cases("test_framework", EXACT, V.NODE_TEST_FRAMEWORKS),
]


def _keyword_cases(test: str) -> list[str]:
    return [
        *fact_cases("database", test, V.DATABASE_KEYWORDS),
        *fact_cases("integration", test, V.INTEGRATION_KEYWORDS),
    ]


FRAMEWORK_NAMES = [*V.NODE_UI_FRAMEWORKS, *V.NODE_API_FRAMEWORKS, *V.NODE_TEST_FRAMEWORKS]
KEYWORDS = [*V.DATABASE_KEYWORDS, *V.INTEGRATION_KEYWORDS]


def _telling_name() -> Column:
    """Most dependencies tell nothing; one cheap test spares them the list of cases."""
    return F.col("dep").rlike(_starts_with(KEYWORDS))


def _lowered(manifests: DataFrame) -> DataFrame:
    """Manifests with their text in lower case, made once however many keywords are sought in it."""
    lowered = F.struct(F.lower("content").alias("lowered"))
    return manifests.select("repo", "path", "content", F.inline(F.array(lowered)))


def _text_facts(manifests: DataFrame) -> DataFrame:
    texts = _lowered(manifests.filter(basename(F.col("path")).isin(V.KEYWORD_MANIFESTS))).filter(
        contains_any(F.col("lowered"), KEYWORDS)
    )
    return _as_facts(texts, _keyword_cases(MENTIONED))


def node_frameworks(dependencies: DataFrame) -> DataFrame:
    """Frameworks named exactly by a dependency, as (repo, concern, label)."""
    named = dependencies.filter(F.col("dep").isin(FRAMEWORK_NAMES))
    return _as_facts(named, FRAMEWORK_CASES).distinct()


PYTHON_CASES = [
    *fact_cases("framework", MENTIONED, V.PYTHON_WEB_FRAMEWORKS),
    *fact_cases("api_framework", MENTIONED, V.PYTHON_WEB_FRAMEWORKS),
    *fact_cases("test_framework", MENTIONED, {"pytest": "pytest"}),
]


def _python_facts(manifests: DataFrame) -> DataFrame:
    python = manifests.filter(basename(F.col("path")).isin(V.PYTHON_MANIFESTS))
    return _as_facts(_lowered(python), PYTHON_CASES)


def _first_manifest_facts(manifests: DataFrame) -> DataFrame:
    """API labels in each repository's first go.mod and first Cargo.toml.

    The marks found in a manifest are aggregated, not its content.
    """
    base, path = basename(F.col("path")), F.col("path")

    def first(name, test, table):
        words = ", ".join(f"{test.format(quoted(word))} AS `{word}`" for word in table)
        return F.min_by(F.expr(f"struct({words})"), F.when(base == name, path))

    firsts = _lowered(manifests.filter(base.isin("go.mod", "Cargo.toml"))).groupBy("repo").agg(
        first("go.mod", "contains(content, {})", V.GO_WEB_FRAMEWORKS).alias("go"),
        first("Cargo.toml", MENTIONED, V.RUST_WEB_FRAMEWORKS).alias("rust"),
    )
    cases = [
        f"CASE WHEN {side}.`{word}` THEN 'api_framework:{label}' END"
        for side, table in (("go", V.GO_WEB_FRAMEWORKS), ("rust", V.RUST_WEB_FRAMEWORKS))
        for word, label in table.items()
    ]
    return _as_facts(firsts, cases)


def test_conventions(paths: DataFrame) -> DataFrame:
    """Test tools implied by file names alone."""
    return path_summary(paths).select(
        "repo", F.lit("test_framework").alias("concern"), F.explode("test_tools").alias("label")
    )


def non_node_stacks(files: DataFrame) -> DataFrame:
    """Python, Go and Rust frameworks and test tools, as (repo, concern, label)."""
    parts = [_python_facts(files), _first_manifest_facts(files), test_conventions(files)]
    return reduce(DataFrame.unionByName, parts).distinct()


def stores_and_integrations(files: DataFrame) -> DataFrame:
    """Databases and third-party services, as (repo, concern, label).

    A keyword counts when a Node dependency starts with it or when another manifest's text
    contains it anywhere.
    """
    names = declared_dependencies(package_manifests(files)).filter(_telling_name())
    by_name = _as_facts(names, _keyword_cases(NAMED))
    return by_name.unionByName(_text_facts(files)).distinct()


def manifest_facts(manifests: DataFrame) -> DataFrame:
    """Everything manifests tell, with one shuffle after map-side removal of repeats.

    ``manifests`` are the files named in READ_MANIFESTS. Dependencies are not made distinct
    first: their labels are computed where they are read.
    """
    names = declared_dependencies(package_manifests(manifests)).filter(
        F.col("dep").isin(FRAMEWORK_NAMES) | _telling_name()
    )
    parts = [
        _as_facts(names, [*FRAMEWORK_CASES, *_keyword_cases(NAMED)]),
        _text_facts(manifests),
        _python_facts(manifests),
        _first_manifest_facts(manifests),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _begins(words) -> str:
    """Pattern of all ``words``, with one branch per first character."""
    rest = {}
    for word in sorted(set(words)):
        rest.setdefault(word[0], []).append(re.escape(word[1:]))
    branches = "|".join(f"{re.escape(c)}(?:{'|'.join(ends)})" for c, ends in rest.items())
    return f"(?=[{''.join(map(re.escape, rest))}])(?:{branches})"


def file_labels(first: str = "") -> Column:
    """``concern:label`` lines that a file (``path``, ``content``) gives by itself, each once; empty for most files.

    They are the facts of ``manifest_facts`` for a repository of this one file, told inside its row. Those of
    a go.mod or Cargo.toml, of which only a repository's first one counts, begin with ``first``.
    """
    # One element is transformed where a text is parsed or lowered once for many tests.
    base = "substring_index(path, '/', -1)"
    keys = ", ".join(f"coalesce(map_keys(m.{block}), CAST(array() AS ARRAY<STRING>))" for block in DEPENDENCY_BLOCKS)
    strict = ", ".join(quoted(x) for option in STRICT_JSON.items() for x in option)
    # A text without the quoted beginning of a telling name, and without an escape that could spell one, need not be parsed.
    hopeful = quoted(f'"{_begins([*FRAMEWORK_NAMES, *KEYWORDS])}|\\\\')
    names = f"transform(array(from_json(content, {quoted(MANIFEST_SCHEMA)}, map({strict}))), m -> concat({keys}))[0]"
    telling = f"filter({names}, dep -> dep IN ({literals(FRAMEWORK_NAMES)}) OR dep RLIKE {quoted(_starts_with(KEYWORDS))})"
    by_name = f"array_join(transform({telling}, dep -> {_lines([*FRAMEWORK_CASES, *_keyword_cases(NAMED)])}), '\\n')"
    go = fact_cases(f"{first}api_framework", "contains(content, {})", V.GO_WEB_FRAMEWORKS)
    rust = fact_cases(f"{first}api_framework", MENTIONED, V.RUST_WEB_FRAMEWORKS)
    by_text = f"""transform(array(lower(content)), lowered -> concat_ws('\\n', {_lines(_keyword_cases(MENTIONED))},
        CASE WHEN {base} IN ({literals(V.PYTHON_MANIFESTS)}) THEN {_lines(PYTHON_CASES)}
             WHEN {base} = 'go.mod' THEN {_lines(go)} WHEN {base} = 'Cargo.toml' THEN {_lines(rust)} END))[0]"""
    told = f"""CASE WHEN {base} = 'package.json' THEN CASE WHEN content RLIKE {hopeful} THEN {by_name} END
        WHEN {base} IN ({literals(V.KEYWORD_MANIFESTS)}) THEN {by_text} END"""
    once = f"transform(array({told}), told -> IF(told <> '', array_join(array_distinct(split(told, '\\n')), '\\n'), ''))[0]"
    return F.expr(f"CASE WHEN {base} IN ({literals(READ_MANIFESTS)}) THEN {once} ELSE '' END")


# --- routes ----------------------------------------------------------------------------------

def route_calls(lines: DataFrame) -> DataFrame:
    """Every route registration on the given (repo, path, line_no, line) rows.

    The line travels along, so that control checks need neither a second read nor a join.
    ``pos`` orders the calls of one line.
    """
    calls = lines.filter(is_route_file(F.col("path"))).select(
        "repo",
        F.col("path").alias("file"),
        F.col("line_no").alias("line"),
        F.col("line").alias("text"),
        F.posexplode(F.regexp_extract_all("line", F.lit(V.ROUTE_CALL), F.lit(0))).alias("pos", "call"),
    )
    return calls.select(
        "repo",
        F.upper(F.regexp_extract("call", V.ROUTE_CALL, 1)).alias("method"),
        F.regexp_extract("call", V.ROUTE_CALL, 2).alias("path"),
        "file",
        "line",
        "pos",
        "text",
    )


def endpoints(files: DataFrame) -> DataFrame:
    return route_calls(lines_matching(files.filter(is_route_file(F.col("path"))), V.ROUTE_CALL))


def route_count(path: Column, content: Column) -> Column:
    """How many calls ``endpoints`` finds in a file, counted inside its row."""
    calls = lambda line: F.size(F.regexp_extract_all(line, F.lit(V.ROUTE_CALL), F.lit(0)))
    counted = F.aggregate(F.split(content, V.LINE_BREAK), F.lit(0).cast("long"), lambda n, line: n + calls(line))
    return F.when(is_route_file(path) & content.rlike(V.ROUTE_CALL), counted).otherwise(F.lit(0).cast("long"))


# --- one row per repository ----------------------------------------------------------------

LABEL_COLUMNS = {
    "framework": "frameworks",
    "api_framework": "api_frameworks",
    "test_framework": "test_frameworks",
    "database": "databases",
    "integration": "integrations",
}
PROFILE_LISTS = ["languages", "package_managers", *LABEL_COLUMNS.values()]


def profile(paths: DataFrame, manifests: DataFrame, found_endpoints: DataFrame) -> DataFrame:
    """One row per repository: label lists from fixed vocabularies, and counts of path lists.

    Path lists can be as long as the repository, so the row carries their lengths; the paths
    themselves are the tables made by ``dependency_files`` and ``paths_where``. Contents are
    read from ``manifests`` only.
    """
    labels = manifest_facts(manifests).groupBy("repo").agg(
        *[
            F.collect_set(F.when(F.col("concern") == concern, F.col("label"))).alias(column)
            for concern, column in LABEL_COLUMNS.items()
        ]
    )
    routes = found_endpoints.groupBy("repo").agg(F.count("*").alias("api_endpoints"))
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in PROFILE_LISTS}
    lists["test_frameworks"] = F.array_union(lists["test_frameworks"], "test_tools")
    return (
        path_summary(paths)
        .join(labels, "repo", "left")
        .join(routes, "repo", "left")
        .select(
            "repo",
            *PATH_COUNTS,
            *[F.sort_array(value).alias(name) for name, value in lists.items()],
            F.coalesce("api_endpoints", F.lit(0)).alias("api_endpoints"),
        )
    )


def incremental(files: DataFrame, prior: DataFrame, compute) -> DataFrame:
    """Reuse ``prior`` rows of the repositories still listed; compute only the missing ones.

    A prior row without a file count is invalid and computed again.
    """
    listed = files.select("repo").distinct()
    usable = prior.filter(F.col("file_count").isNotNull())
    missing = files.join(usable.select("repo").distinct(), "repo", "left_anti")
    return usable.join(listed, "repo", "left_semi").unionByName(compute(missing))

