"""Connected components of a link table by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.durable import discard, durable


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return links.join(least, "a").select(F.explode(ends).alias("x")).select("x.a", "x.b").where("a != b").distinct()


def star_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): each linked node but its component's smallest, with that smallest node.

    ``links`` has columns a and b of one orderable type. Each round writes its links to the shared
    checkpoint folder, so that lost executors repeat one round at most. Rounds grow with the logarithm
    of the longest chain; ``most_rounds`` guards against a defect and raises.
    """
    now = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        then = now
        now = durable(_small_star(_large_star(then)), "links")
        discard(then)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state
    raise RuntimeError("components did not settle")
