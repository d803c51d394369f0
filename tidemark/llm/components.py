"""Connected components of a table of links, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that one task takes, and the number up to which a round is spread over as many tasks as that needs.
TASK_LINKS, FEW_LINKS = 50_000, 1_000_000


def components(links: DataFrame, most_tasks: int | None = None) -> DataFrame:
    """node and root (the least node of its component) for each node of links (a, b) that has a link to another.

    Each round points every neighbour at the least node seen next to it, until a round changes nothing, so the
    result is always whole; the depth of the trees falls by half at least, so the number of rounds grows with the
    logarithm of a component's size. Each round is a written table. Loops and repeated links are allowed; no
    links give no rows.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = common.written(e, "links", most_tasks=most_tasks)
    state = None
    while True:
        spark, now = e.sparkSession, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, few = now, now[0] < FEW_LINKS
        parts = now[0] // TASK_LINKS + 1

        def by_u(df: DataFrame, few: bool = few, parts: int = parts) -> DataFrame:
            return df.repartition(parts, "u") if few else df

        def side(df: DataFrame, name: str, few: bool = few) -> DataFrame:
            """One side of a join: with many links a written table, so that the engine can split a node's rows."""
            return df if few else common.written(df, name, most_tasks=most_tasks)

        both = by_u(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = by_u(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        large = common.written(large, "large", 2 * now[0] if few else None, most_tasks)
        near = by_u(large)
        low = side(near.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = near.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        before, e = e, common.written(by_u(small).distinct(), "links", 2 * now[0] if few else None, most_tasks)
        common.discard(spark, before, large, *([] if few else [least, low]))
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
