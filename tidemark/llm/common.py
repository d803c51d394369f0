"""What the corpus operators share: scratch tables in the shared folder and stable row locators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import delete, scratch

#: The columns of located(): the input's row as a struct, and where the row is.
INPUT, FILE, ROW = "__input", "__file", "__row"
_PLAIN = {"Project", "Filter", "SubqueryAlias"}
#: Rows to a file of a written table, where their number is known.
FILE_ROWS = 50_000
#: Bytes of input files to a task, where each core has one task, and where it has two.
SMALL_TASK_BYTES, TASK_BYTES = 16 << 20, 64 << 20


def tasks(docs: DataFrame) -> int:
    """Into how many tasks a pass over docs, or over what is made of it, goes: one or two for a core, more for large inputs.

    Hadoop's local file system starts three child processes for a file that a task writes, so small inputs shall
    not make a file of each of very many partitions.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return min(max(cores, min(2 * cores, size // SMALL_TASK_BYTES), size // TASK_BYTES + 1), 1 << 30)


def written(df: DataFrame, name: str, most_rows: int | None = None, most_tasks: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    most_rows says that df has no more rows than that: a small table then gets few files, not one for each partition.
    most_tasks (see tasks) bounds the files whatever the rows; partitions are only taken together, never cut.
    """
    bounds = [most_tasks] if most_tasks else []
    if most_rows is not None:
        bounds.append(most_rows // FILE_ROWS + 1)
    if bounds:
        df = df.coalesce(min(bounds))
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete scratch tables (or folders) of this module that nothing will read again."""
    for t in tables:
        delete(spark, *({t} if isinstance(t, str) else {f.rsplit("/", 1)[0] for f in t.inputFiles()}))


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a file and always the same: files, chosen and filtered by fixed expressions."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _PLAIN and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """INPUT (all columns of docs as a struct), FILE and ROW, which tell rows apart (even equal ones) and stay the same
    when a task is run again.

    The struct keeps the input's columns, whatever their names, apart from all others; column pruning sees through
    it. Rows that don't come straight from files are written to the shared folder first.
    """
    if _rows_of_files(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            every = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
            out = docs.select(every.alias(INPUT), meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))
            out.schema  # noqa: B018  resolves the metadata column now
            return out
        except AnalysisException:
            pass
    return located(written(docs, "rows"))


def of_input(name: str) -> Column:
    """A column of the input of located()."""
    return F.col(INPUT).getField(name)


def input_rows(rows: DataFrame) -> DataFrame:
    """The input's columns of rows that still have INPUT."""
    return rows.select(F.col(f"{INPUT}.*"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the right side's keys go."""
    r = right.select([F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out


def in_order(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows as a written table with __at: the place of each row (from 0) in order among the rows with its values of by.

    The rows are sorted in ranges of the whole order, however they fall on the values of by, and their places in a
    range are moved on by the counts of the ranges before: no task holds more than its range, and one table of a
    row per range and value is ordered in tasks of one value each. order must tell all rows apart.
    """
    index = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = written(ranged.withColumn("__part", F.shiftright(index, 33)).withColumn("__at", index.bitwiseAND(F.lit((1 << 33) - 1))), name)
    parts = ranged.groupBy("__part", *by).agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"))
    ahead = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__from")).drop("__from", "__n")
    out = null_safe(ranged, parts, ["__part", *by])
    return out.withColumn("__at", F.col("__at") + F.col("__ahead")).drop("__part", "__ahead")


def uniform(*parts: Column) -> Column:
    """A fixed number in [0, 1) in steps of 2**-20 for each value of parts, alike in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 5), 16, 10).cast("long") / F.lit(1048576.0)


#: Bits of a key filter: 512 buckets of 4 KiB, so it never holds more than 2 MiB.
_BUCKETS, _BUCKET_BITS = 512, 32768


def _place(key: Column) -> Column:
    """A key's bit, from 24 bits of its hash."""
    return F.xxhash64(key).bitwiseAND(F.lit(_BUCKETS * _BUCKET_BITS - 1))


def maybe_marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column name: true for each row whose key is in keys (one column), and for some others.

    A filter of fixed size is broadcast, however many keys there are; an exact join must follow. It only
    spares that join most of the rows that it would not match.
    """
    at = F.col("__place")
    held = keys.select(_place(F.col(keys.columns[0])).alias("__place"))
    bits = held.groupBy(F.shiftright(at, 15).alias("__bucket")).agg(F.bitmap_construct_agg(at % _BUCKET_BITS).alias("__bits"))
    bit = at % _BUCKET_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.withColumn("__place", _place(key)).withColumn("__bucket", F.shiftright(at, 15)).join(F.broadcast(bits), "__bucket", "left")
    return found.withColumn(name, F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))).drop("__place", "__bucket", "__bits")


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in keys (one column), and some others; see maybe_marked."""
    return maybe_marked(rows, F.col(key), keys, "__maybe").filter("__maybe").drop("__maybe")
