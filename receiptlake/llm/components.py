"""Connected components of links, by alternating large and small stars.

A large star links every greater neighbour of a node to the least of its neighbourhood, a
small star every smaller one and the node itself. Both keep the components and shrink the
graph towards one star per component. Each step aggregates a least neighbour per node, with
partial sums before the shuffle, and joins it back; no neighbourhood is ever collected. The
links are written to the shared folder between rounds, and only their number and a hash
sum reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Per node its least neighbour or itself."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.filter("b > a").join(_least(both), "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = _least(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns id and component (the least id reachable) of all ids that have a link.
    ``links`` has columns a and b; the direction, repeated links and links of an id to
    itself do not matter."""
    links = cut(links.select("a", "b").filter("a != b").distinct())
    state = None
    while True:
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if now == state:
            break
        state = now
    stars = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    centres = links.select(F.col("b").alias("id")).distinct()
    return stars.unionByName(centres.join(stars, "id", "left_anti").select("id", F.col("id").alias("component")))
