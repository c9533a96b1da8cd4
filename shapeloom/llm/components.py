"""Connected components of links between numbers, by rounds of large and small stars.

Each round hangs every node's larger neighbours on its smallest one, then its smaller
neighbours; components end as stars round their smallest node. Rounds grow with the logarithm
of a component's size. Every round's links are written to the shared folder; minima are
aggregated before they are shuffled and joined back from a written table, so that a node with
very many links is split like any skewed key. A round's tables go as soon as the next one's are
written.

Defined cases: a table without links gives no rows; repeated links count once. Links must hold
no null, and ``a`` must be less than ``b``. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, release, stored


def _hang(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = lookup(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least-neighbours")
    large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    hung = stored(large.where("a <> b").distinct(), "large-stars")
    release(least)
    return hung


def _lift(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    many = lookup(least.where("n > 1").select("b", "m"), "several-centers")
    hung = links.join(many, "b", "left")
    moved = hung.where("m is not null and a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    kept = hung.select(F.coalesce("m", "a").alias("a"), "b")
    lifted = stored(kept.unionByName(moved).distinct(), "small-stars")
    release(many)
    return lifted


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has a link; ``links``: a < b."""
    seen, last = None, None
    while True:
        hung = _hang(links)
        links = _lift(hung)
        release(hung, last)
        last = links
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        # Stars already: every larger end has one link, and no smaller end is a larger one.
        if links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        seen = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
