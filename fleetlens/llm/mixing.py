"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source, targets come from the weights, and a document is taken
floor(rate) times plus once more with probability equal to the fraction, where the rate is the
target of its source over the source's size. The draw is a hash of the document's id and a seed,
so reruns agree.

Edge cases: a null source is a source of its own, ordered last. A null or empty text has size 0
and is taken as often as its rate says, at 0 words. If no text has a word, targets and rates are
0. A null id draws by the text's hash. Repeated rows draw alike. Other columns pass through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .common import n_words, ranked

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def targets(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of every source.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target stops at ``most`` times the source's size; what is cut is shared again by
    weight among the others, until none is above. Each round is one aggregate over the sources.
    """
    totals = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))
    place = (F.col("rank") - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), place.cast("int"))
    sources = written(
        ranked(totals, F.col("source").asc_nulls_last()).withColumn("weight", weight).drop("rank"),
        "sources",
    )
    size, weight = F.col("source_size"), F.col("weight")
    total, all_weight = sources.agg(F.sum(size), F.sum(weight)).first()
    if not total:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    held = (0, 0)
    while True:
        level = (total - most * held[0]) / (all_weight - held[1])
        full = most * size < F.lit(level) * weight
        now = sources.where(full).agg(
            F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))
        ).first()
        if tuple(now) == held:
            break
        held = tuple(now)
    target = F.when(full, (most * size).cast("double")).otherwise(F.lit(level) * weight)
    return sources.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    The table of sources is read from a written copy, so Spark knows its size and broadcasts it
    or splits the hot source by skew handling.
    """
    goals = targets(docs, weights, most).withColumnRenamed("source", "_goal_source")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col("doc_id"), F.col("text"), seed) < F.col("_rate") - F.floor("_rate")
    return (
        docs.select(*own)
        .withColumn("size", n_words(F.col("text")))
        .join(goals, F.col("source").eqNullSafe(F.col("_goal_source")))
        .withColumn("_rate", rate)
        .withColumn("copies", F.floor("_rate") + extra.cast("long"))
        .select(*own, "size", "source_size", "target", "copies")
    )


def emitted(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    return (
        mix(docs, **settings)
        .where(F.col("copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*docs.columns)
    )
