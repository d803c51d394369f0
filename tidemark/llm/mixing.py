"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, target / source size. The documents of a
source stand in one fixed order (by size, so that what is taken comes close to the target), their expected
copies are summed up to each document, one random offset per source is added, and a document is emitted once
for each whole number that the sum crosses at it. As all steps of a source are equal, the prefix sums come from
places in one order of all rows, which is made in ranges and their totals; no source is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import FILE, ROW

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row per source with source and source_size.

    Sources take weights in turn in the order of their code points, null last. share times all sizes is dealt
    by weight; no target passes most times its source's size, and the excess is dealt again by weight among
    the others until none is above: with sources in the order of most * size / weight, the first ones stop at
    their limit and the rest get one level times their weight. The table has a row per source, and the two
    windows below order such rows only.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    given = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int")))
    given = given.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = given.withColumn("level", level)
    # levels fall as long as a source gets more than its limit; the first one under its source's limit holds
    first = F.first(F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("level")), ignorenulls=True).over(every)
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap"))).alias("target"))


def _mixed(rows: DataFrame, id_col: str, text_col: str, source_col: str, share: float, most: float, weights: tuple[int, ...], seed: int) -> DataFrame:
    """mix() of located rows, with __id, FILE and ROW."""
    size = F.coalesce(F.regexp_count(common.of_input(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = common.written(rows.select(common.of_input(id_col).alias("__id"), common.of_input(source_col).alias("source"), size.alias("size"), FILE, ROW), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = common.uniform(F.lit(seed), F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    sources = common.written(sources.withColumn("per", per).withColumn("offset", offset), "mix-sources")
    placed = common.null_safe(common.in_order(rows, ["source"], ["size", "__id", FILE, ROW], "mix-order"), sources, ["source"])
    sum_to = lambda n: F.floor(F.col("offset") + F.col("per") * n)
    copies = sum_to(F.col("__at") + 1) - sum_to(F.col("__at"))
    copies = F.least(copies, F.ceil("per")).cast("long")  # a sum's last bit never makes a copy too many
    return placed.select("__id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), FILE, ROW)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per row of docs: the id column, size, source_size, target, copies, taken.

    size is the number of words (null or empty text: 0), counted over the whole text. A null source is a source of
    its own. A source whose texts are all empty has target 0 and takes no copies. Equal rows, and rows with equal or
    null ids, each take their own place in the order. An empty table gives no rows. The result depends on the rows,
    their files and the seed only. Other columns, whatever their names, are ignored.
    """
    return _mixed(common.located(docs), id_col, text_col, source_col, share, most, weights, seed).withColumnRenamed("__id", id_col).drop(FILE, ROW)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as mix says, with all their columns; nulls, ties and empty tables as there."""
    rows = common.located(docs)
    dealt = _mixed(rows, id_col, text_col, source_col, share, most, weights, seed).select("copies", FILE, ROW).filter("copies > 0")
    out = rows.join(dealt, [FILE, ROW])
    return common.input_rows(out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
