"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.session import cut


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _followed(parents: DataFrame) -> DataFrame:
    """(u, p) with p followed one step further."""
    above = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    return parents.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))


def _roots(parents: DataFrame) -> DataFrame:
    """(u, p) with p followed to its end, twice doubled for each cut; every parent is smaller than its child, so there are no rings."""
    while True:
        twice = _followed(parents)
        above = twice.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        twice = twice.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("moved"))
        twice = cut(twice)
        parents = twice.select("u", "p")
        if twice.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(c, label) of every node of links (a, b): nodes with one label are connected, and it is the smallest of them.

    Each round hangs every node under its smallest neighbour, follows the chains to their ends, and replaces the links by those between
    the ends. Links and labels go through a round as one table, which is cut once. Neighbours are combined before a shuffle, and
    joins meet tables that were cut, so that a node of very many links can be split. No links give no rows.
    """
    table = cut(_ordered(links).select("a", "b", F.lit(True).alias("link")))
    rounds = 0
    while not table.filter("link").isEmpty():
        edges = table.filter("link")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        parents = _roots(parents)
        onward = parents.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        if rounds:
            labels = table.filter(~F.col("link")).join(onward, "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        else:
            labels = parents.select(F.col("u").alias("a"), F.col("p").alias("b"))
        left = parents.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        rest = _ordered(edges.join(left, "a").join(onward, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        table = cut(rest.withColumn("link", F.lit(True)).union(labels.withColumn("link", F.lit(False))))
        rounds += 1
    return table.filter(~F.col("link")).select(F.col("a").alias("c"), F.col("b").alias("label"))


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(c, label) after further links (a, b) are added to the components (c, label); only the links' ends are worked on again."""
    def named(side: str) -> DataFrame:
        return labels.select(F.col("c").alias(side), F.col("label").alias(f"l{side}"))

    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    merged = components(between.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    onward = merged.select(F.col("c").alias("label"), F.col("label").alias("root"))
    moved = labels.join(onward, "label", "left").select("c", F.coalesce("root", "label").alias("label"))
    new = merged.join(labels.select("c"), "c", "left_anti")  # an end that had no link before
    return moved.union(new)
