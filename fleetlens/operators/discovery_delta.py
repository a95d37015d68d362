"""Discovery of what changed: profiles brought up to date from the files that did.

The state of a fleet is two tables: the digest of every file with the facts that it gives by itself, and
how many files of a repository give each fact. Counts can be added and taken off, so a label stays while any file
supports it and goes with the last one; no set has to be made anew. What can't be taken off, the first go.mod and
Cargo.toml of a repository, is looked up among the facts of those files.

A file is one row throughout. Its facts are told inside that row, in one look at its content, as lines of two
texts: what its path tells and what its content tells. Equal rows of a repository are counted before they are
taken apart. A new listing meets the state in one shuffle, which tells changes, facts that stay and facts that go.

Contents are stored once per digest, in folders by the digest's first characters, so a run reads only the folders
that hold changed contents.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.columns import basename, extension, looked_up
from ..functions.tables import written
from . import discovery

FILE = ["repo", "path"]
#: Manifests of which only a repository's first one tells API frameworks.
FIRST_ONLY = ("go.mod", "Cargo.toml")
#: Before a fact of one of those.
FIRST = "first:"


@dataclass
class State:
    """Files (repo, path, digest, by_path, by_content, routes) and totals (repo, fact, n)."""

    files: DataFrame
    totals: DataFrame

    @property
    def digests(self) -> DataFrame:
        return self.files.select(*FILE, "digest")

    @property
    def facts(self) -> DataFrame:
        """(repo, path, fact, n): every fact of every file."""
        facts = _taken_apart(F.lit(1).cast("long"), F.col("routes"))
        return self.files.select("*", _home()).select("path", F.inline(facts)).select(*FILE, "fact", "n")


def digest(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def digests(files: DataFrame) -> DataFrame:
    return files.select(*FILE, digest(F.col("content")).alias("digest"))


def store_contents(files: DataFrame, path: str, digits: int = 3) -> None:
    """Every distinct content once, under the first ``digits`` of its digest."""
    named = files.select(digest(F.col("content")).alias("digest"), "content")
    keys = {"shard": F.substring("digest", 1, digits), "_part": F.substring("digest", digits + 1, 2)}
    (
        named.withColumns(keys)
        .repartition(*keys)
        .dropDuplicates(["digest", *keys])  # equal digests have met
        .drop("_part")
        .write.partitionBy("shard")
        .mode("append")
        .parquet(path)
    )


def stored_contents(spark: SparkSession, path: str, wanted: DataFrame, digits: int = 3) -> DataFrame:
    """(repo, path, digest, content) of the ``wanted`` files (repo, path, digest). Only folders that hold one are read."""
    shard = F.substring("digest", 1, digits)
    folders = [r["shard"] for r in wanted.select(shard.alias("shard")).distinct().collect()]  # at most 16^digits
    store = spark.read.schema("digest string, content string, shard string").parquet(path)
    held = store.where(F.col("shard").isin(folders)).drop("shard").repartition("digest").dropDuplicates(["digest"])
    return wanted.join(held, "digest").select(*FILE, "digest", "content")


def facts_of(files: DataFrame) -> DataFrame:
    """(repo, path, digest, by_path, by_content, routes): what every file tells by itself.

    ``by_path`` and ``by_content`` hold a fact a line, as ``kind:label``; ``routes`` counts API calls. The rules are
    those of the full discovery, as if each file were a repository of its own. A digest that ``files`` has is kept.
    """
    path = F.col("path")
    base = basename(path)
    tests = {
        "count:file_count": F.lit(True),
        "count:dependency_files": base.isin(V.DEPENDENCY_FILES),
        "count:ci_workflows": discovery.is_ci_file(path),
        "count:infra_files": discovery.is_infra_file(path),
        "count:auth_files": discovery.is_auth_file(path),
        "count:config_files": discovery.is_config_file(path),
        "mark:package.json": base == "package.json",
        "mark:py": path.endswith(".py") & path.rlike(V.PYTHON_TEST_FILE_PATTERN),
        "mark:go": base == "go.mod",
        "mark:go_test": path.endswith("_test.go"),
        "mark:rust": base == "Cargo.toml",
    }
    told = [F.when(test, F.lit(fact)) for fact, test in tests.items()]
    told.append(F.concat(F.lit("languages:"), looked_up(extension(path), V.LANGUAGE_BY_EXTENSION)))
    told.append(F.concat(F.lit("package_managers:"), looked_up(base, V.PACKAGE_MANAGER_BY_FILE)))
    return files.select(
        *FILE,
        F.col("digest") if "digest" in files.columns else digest(F.col("content")).alias("digest"),
        F.concat_ws("\n", *told).alias("by_path"),
        discovery.file_labels(FIRST).alias("by_content"),
        discovery.route_count(path, F.col("content")).alias("routes"),
    )


def _taken_apart(n: Column, routes: Column) -> Column:
    """Array of (repo, fact, n) of ``n`` equal files that hold ``routes`` together."""

    def told(repo, lines):
        facts = F.filter(F.split(lines, "\n"), lambda fact: fact != "")
        return F.transform(facts, lambda fact: F.struct(F.col(repo).alias("repo"), fact.alias("fact"), n.alias("n")))

    calls = F.struct(F.col("home").alias("repo"), F.lit("count:api_endpoints").alias("fact"), routes.alias("n"))
    facts = F.concat(told("repo", "by_path"), told("home", "by_content"))
    return F.when(routes != 0, F.array_append(facts, calls)).otherwise(facts)


def _home() -> Column:
    """What the content of a file without a repository tells stands under its path."""
    return F.coalesce("repo", "path").alias("home")


def summed(files: DataFrame) -> DataFrame:
    """(repo, fact, n) of files with a ``sign`` by which they count, without the facts of first manifests."""
    alike = files.groupBy("repo", _home(), "by_path", "by_content").agg(
        F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("routes")).alias("routes")
    )
    rows = alike.where("n <> 0 OR routes <> 0").select(F.inline(_taken_apart(F.col("n"), F.col("routes"))))
    return rows.where(~F.col("fact").startswith(FIRST)).groupBy("repo", "fact").agg(F.sum("n").alias("n")).where("n <> 0")


def signed(files: DataFrame, sign: int) -> DataFrame:
    return files.withColumn("sign", F.lit(sign).cast("long"))


def begun(files: DataFrame) -> State:
    """State of a fleet of which nothing is known yet."""
    facts = written(facts_of(files), "facts")
    return State(facts, written(summed(signed(facts, 1)), "totals"))


def compared(before: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of ``before`` (repo, path, digest and more) against those of ``listing`` (repo, path, digest).

    A row per (repo, path): ``olds``, rows of ``before`` without their key; ``changed``, a (digest, change) for
    each that is new, edited or gone; and ``stale``, whether the olds no longer hold. Files that are listed
    several times are compared each with each. A key with a null equals no other: its rows are gone and new.
    """
    more = [c for c in before.columns if c not in FILE]
    old, unknown = F.struct(*more), F.col("repo").isNull() | F.col("path").isNull()
    kind = before.select(old.alias("old")).schema["old"].dataType
    # Files without a key need not meet, however many there are. Sorting by a number first is quick.
    at = F.when(unknown, F.monotonically_increasing_id()).otherwise(F.xxhash64(*FILE)).alias("_at")
    both = before.select(*FILE, at, old.alias("old"), F.lit(None).cast("string").alias("new")).unionByName(
        listing.select(*FILE, at, F.lit(None).cast(kind).alias("old"), F.col("digest").alias("new"))
    )
    met = both.repartition("_at").groupBy("_at", *FILE).agg(F.collect_list("old").alias("olds"), F.collect_list("new").alias("news"))
    known = ~unknown
    differ = "flatten(transform(news, d -> transform(filter(olds, o -> NOT o.digest <=> d), o -> d)))"
    alone = unknown | (F.size("olds") == 0)
    lost = unknown | (F.size("news") == 0)
    none = "CAST(array() AS ARRAY<STRUCT<digest: STRING, change: STRING>>)"
    return met.withColumn("_edited", F.when(alone, F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.expr(differ))).select(
        *FILE,
        "olds",
        F.concat(
            F.expr("transform(_edited, d -> named_struct('digest', d, 'change', 'edited'))"),
            F.when(alone, F.expr("transform(news, d -> named_struct('digest', d, 'change', 'new'))")).otherwise(F.expr(none)),
            F.when(lost, F.expr("transform(olds, o -> named_struct('digest', CAST(NULL AS STRING), 'change', 'gone'))")).otherwise(F.expr(none)),
        ).alias("changed"),
        (known & ((F.size("news") == 0) | (F.size("_edited") > 0))).alias("stale"),
    )


def changes(before: DataFrame, listing: DataFrame) -> DataFrame:
    """(repo, path, digest, change): files of ``listing`` (repo, path, digest) that are new or edited, and those gone."""
    return compared(before, listing).select(*FILE, F.inline("changed"))


def advanced(state: State, listing: DataFrame, contents) -> State:
    """``state`` after a new ``listing`` of all files.

    ``contents`` gives (repo, path, content), with or without the digest, for the (repo, path, digest) it is asked
    for, which are the new and edited files only.
    """
    met = written(compared(state.files, listing), "changes")
    wanted = met.select(*FILE, F.inline("changed")).where("change <> 'gone'").select(*FILE, "digest")
    fresh = written(facts_of(contents(wanted)), "facts")
    old = met.select("stale", *FILE, F.inline("olds"))
    delta = signed(fresh, 1).unionByName(signed(old.where("stale").drop("stale"), -1))
    totals = state.totals.unionByName(summed(delta)).groupBy("repo", "fact").agg(F.sum("n").alias("n")).where("n <> 0")
    files = old.where("NOT stale").drop("stale").unionByName(fresh)
    return State(written(files, "files"), written(totals, "totals"))


def profile(state: State) -> DataFrame:
    """One row per repository, equal to the full discovery of its files."""
    concern, label = F.substring_index("fact", ":", 1), F.expr("substring(fact, instr(fact, ':') + 1)")
    told = state.totals.select("repo", concern.alias("concern"), label.alias("label"), "n")
    firsts = (
        state.facts.where(basename(F.col("path")).isin(*FIRST_ONLY))
        .groupBy("repo", basename(F.col("path")).alias("base"), "path")
        .agg(F.collect_set(F.when(F.col("fact").startswith(FIRST), F.substring_index("fact", ":", -1))).alias("labels"))
        .groupBy("repo", "base")
        .agg(F.min_by("labels", "path").alias("labels"))
        .select("repo", F.lit("api_framework").alias("concern"), F.explode("labels").alias("label"), F.lit(1).cast("long").alias("n"))
    )

    def labels(of: str):
        return F.collect_set(F.when(F.col("concern") == of, F.col("label")))

    def number(of: str):
        return F.coalesce(F.sum(F.when((F.col("concern") == "count") & (F.col("label") == of), F.col("n"))), F.lit(0)).cast("long")

    def mark(of: str):
        return F.coalesce(F.bool_or((F.col("concern") == "mark") & (F.col("label") == of)), F.lit(False))

    counts = [*discovery.PATH_COUNTS, "api_endpoints"]
    marks = ["package.json", "py", "go", "go_test", "rust"]
    rows = (
        told.unionByName(firsts)
        .groupBy("repo")
        .agg(
            *[number(c).alias(c) for c in counts],
            *[labels(c).alias(c) for c in ("languages", "package_managers")],
            *[labels(concern).alias(column) for concern, column in discovery.LABEL_COLUMNS.items()],
            *[mark(m).alias(f"_{m}") for m in marks],
        )
    )
    node = F.array(*[F.lit(m) for m in V.NODE_PACKAGE_MANAGERS])
    npm = F.col("`_package.json`") & ~F.arrays_overlap("package_managers", node)
    tools = F.array_compact(
        F.array(
            F.when(F.col("_py"), F.lit("pytest")),
            F.when(F.col("_go") & F.col("_go_test"), F.lit("go test")),
            F.when(F.col("_rust"), F.lit("cargo test")),
        )
    )
    lists = {c: F.col(c) for c in discovery.PROFILE_LISTS}
    lists["package_managers"] = F.when(npm, F.array_append("package_managers", F.lit("npm"))).otherwise(F.col("package_managers"))
    lists["test_frameworks"] = F.array_union("test_frameworks", tools)
    return rows.select("repo", *counts, *[F.sort_array(value).alias(name) for name, value in lists.items()])
