"""Connected components of a graph by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or else smaller) neighbours, and itself, to the smallest node around it.

    The minimum is aggregated before its shuffle, and the join back is a plain one, which Spark splits where
    one node has very many neighbours.
    """
    a, b = F.col("a"), F.col("b")
    around = edges.unionByName(edges.select(b.alias("a"), a.alias("b"))) if large else edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = around.join(least, "a")
    out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b) that isn't the smallest of its component.

    Edges with a null end, loops and repeated edges do no harm. Every round is written to the shared folder, and the
    one before it goes.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    scratch = Scratch()
    now = stored(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), scratch)
    while True:
        # stars: no node is a child twice, or a child and a root
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("child")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("child")))
        if ends.groupBy("x").agg(F.sum("child").alias("n"), F.min("child").alias("root")).where("n > 1 or (n = 1 and root = 0)").isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        older, scratch = scratch, Scratch()
        now = stored(_stars(_stars(now, True), False).distinct(), scratch)
        older.clear()
