"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written


def _with_least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Edges with the least ``other`` of their ``key``.

    The minima are combined on the map side and written, so the join has an exchange on both
    sides (or a broadcast, if they are small) and a node with many edges can be split.
    """
    least = edges.groupBy(key).agg(F.min(other).alias("least"))
    return edges.join(written(least, "least"), key)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of ``edges(a, b)``; the component is its smallest id.

    Alternates large-star and small-star steps: a node links its larger neighbours, then its
    smaller ones, to the smallest of all. Depth shrinks by a factor each round, and no step has
    more rows than there are edges. Each round is written, which cuts the lineage.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
        both = edges.union(edges.select("b", "a"))
        large = _with_least(both, "a", "b").where(b > a)
        edges = written(large.select(b.alias("a"), F.least("least", "a").alias("b")).distinct(), "edges")
        small = _with_least(edges, "a", "b")
        hung = F.explode(F.array(F.struct(a.alias("x"), F.col("least").alias("y")), F.struct(b.alias("x"), F.col("least").alias("y"))))
        edges = written(
            small.select(hung.alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
            .where(a != b).distinct(),
            "edges",
        )
    return edges.select(a.alias("id"), b.alias("component")).union(
        edges.select(b.alias("id"), b.alias("component")).distinct()
    )
