"""A training-data pipeline over ``documents``: every stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written and read again. All but
the last return the columns of ``docs``. Columns that no stage knows travel in a struct of their own, so they may
have any name and keep their values.

A stage's result must be written before the next stage is called on it, as ``run`` does: tables that earlier
stages wrote for themselves are removed then, but for those that its ``docs`` still reads.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.tables import recorded, removed, written
from fleetlens.llm import decontamination, jaccard_join, language_id, mixing, secret_scan
from fleetlens.llm.common import table

#: A document whose main language has a smaller share than this has no language it can be filed under.
LEAST_SHARE = 0.4
#: Near duplicates: words per shingle and per cent of Jaccard similarity.
SHINGLE, PERCENT = 5, 80
#: Columns that stages read or change.
KNOWN = ["doc_id", "text", "lang", "source", "n_chars"]

_left: list[str] = []


def stage(function):
    """Hides columns that are not known from a stage, and removes what the stages before it left."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = "\n".join(docs.inputFiles())
            unused = [path for path in _left if path.rpartition("/")[2] not in read]
            removed(spark, unused)
            _left[:] = [path for path in _left if path not in unused]
        rest, others = "_rest", [c for c in docs.columns if c not in KNOWN]
        held = docs.select(*[c for c in docs.columns if c in KNOWN], *([F.struct(*others).alias(rest)] if others else []))
        with recorded() as paths:
            done = function(spark, held, sf_dir)
        _left.extend(paths)
        return done.select(*[F.col(rest)[c].alias(c) if c in others else F.col(c) for c in docs.columns])

    return run_stage


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or without a main language go."""
    found = language_id.identified(docs)
    return found.where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    ).select(*docs.columns)


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates.

    Rows that repeat an id and its text count once. A row without an id can't be named and stays.
    """
    found = written(jaccard_join.joined(docs.select("doc_id", "text"), PERCENT, SHINGLE), "near")
    first = F.col("doc_id") == F.col("component_id")
    repeated = found.where(first).groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = written(repeated.withColumnRenamed("doc_id", "_id"), "repeated")
    gone = written(found.where(~first).select(F.col("doc_id").alias("_id")).union(twice).distinct(), "gone")
    # Few documents go, so Spark can broadcast their ids; the texts of the others stay where they are.
    once = docs.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    again = docs.join(twice, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item or a re-parameterised form of one."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars brought up to date."""
    return secret_scan.redacted(docs)


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emitted(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("source_mix", mix_stage),
]

#: Language inference and near-duplicate components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        result = function(spark, docs, sf_dir)
        with recorded() as paths:
            docs = written(result, f"pipeline-{name}")
        removed(spark, before)
        before = paths
    return docs
