"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _renamed(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """The column's ids replaced by their parents; ids without one stay."""
    p = parents.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"))
    out = rows.join(p, rows[column] == p["_id"], "left")
    return out.withColumn(column, F.coalesce("_parent", column)).drop("_id", "_parent")


def _rooted(parents: DataFrame) -> DataFrame:
    """Every id (columns id and parent) with the root of its chain as its parent."""
    while True:
        jumped = keep(_renamed(parents.withColumn("before", F.col("parent")), "parent", parents))
        parents = jumped.select("id", "parent")
        if jumped.filter("parent <> before").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """id and component_id (the smallest id reachable) of every id that has a link (columns a and b).

    Each round hangs every id on its smallest neighbour (a partially aggregated minimum, so that a hub of many
    links costs no task more than its share), doubles the chains' steps until all ids hang on their roots, and
    contracts the links to the roots. Links between one pair are merged, so the table shrinks from round to round,
    and a long chain of links takes as many jumps as its length has binary digits."""
    rest = keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )
    rounds = []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("parent"))
        rounds.append(parents := _rooted(keep(parents)))
        rest = keep(_renamed(_renamed(rest, "a", parents), "b", parents).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    out = rounds[0].select("id", F.col("parent").alias("component_id"))
    for parents in rounds[1:]:
        out = _renamed(out, "component_id", parents)
    return out
