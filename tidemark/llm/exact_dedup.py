"""Exact deduplication by stateful streaming.

The fingerprints of all documents run through a streaming aggregation whose state lives in RocksDB on the
executors' disks and is kept in a shared folder, without watermark or expiry. For each digest the state
retains the stable identifier and the content locator (file, row) of the row that stays, and a count. On hits
the full bytes are checked: texts of the delivery and, through the locators, those that stand from earlier
deliveries; texts that differ under one digest are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import common
from .common import FILE, ROW

_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store that stays open holds native memory and, with its preallocated manifest, 4 MB of disk
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # the default manager starts four child processes more for each file of a store on a local file system
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}
#: Fingerprints to a store of a state that goes after the call.
STORE_ROWS = 50_000


def _summed(prints: DataFrame) -> DataFrame:
    """digest, __keep (id, file, row; the largest stays) and __n."""
    return prints.groupBy("digest").agg(F.max(F.struct("__id", FILE, ROW)).alias("__keep"), F.count(F.lit(1)).alias("__n"))


def _run_stream(spark: SparkSession, folder: str, prints: DataFrame, files_per_batch: int | None, stays: bool) -> bool:
    """Take all fingerprints under folder that the state there has not seen; whether the state holds anything.

    The stream runs in a session of its own, so its settings touch no other query. A state that stays has as many
    stores as there are shuffle partitions, for all deliveries to come; one of these prints only has what they need.
    """
    own, schema = spark.newSession(), prints.schema
    stores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not stays:  # nor does it need files of checksums, of which the engine writes one for each file of the state
        own.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")
        stores = min(stores, max(spark.sparkContext.defaultParallelism, prints.count() // STORE_ROWS + 1))
    for k, v in {**_STREAM_CONF, "spark.sql.shuffle.partitions": str(stores)}.items():
        own.conf.set(k, v)
    per_batch = files_per_batch or max(64, 4 * spark.sparkContext.defaultParallelism)
    source = own.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/prints/*")
    sink = _summed(source).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return _exists(spark, f"{folder}/state/state/0")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = scratch._hadoop(spark, path)
    return fs.exists(at)


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state: digest, __keep and __n."""
    held = spark.read.format("statestore").load(f"{folder}/state")
    last = {n.split("#")[0]: n for n in held.schema["value"].dataType.names}
    return held.select(F.col("key.digest").alias("digest"), F.col(f"value.{last['max']}").alias("__keep"), F.col(f"value.{last['count']}").alias("__n"))


def _texts_at(places: DataFrame, text_col: str) -> DataFrame:
    """places (with FILE and ROW) with __text, read from the files that they name; the driver sees one name per file."""
    spark = places.sparkSession
    files = [r[0] for r in places.select(FILE).distinct().collect()]
    if not files:
        return places.withColumn("__text", F.lit(""))
    rows = common.located(spark.read.parquet(*files))
    text = rows.select(FILE, ROW, F.coalesce(common.of_input(text_col), F.lit("")).alias("__text"))
    return places.join(text, [FILE, ROW])


def _classes(rows: DataFrame, text_col: str, digest_bytes: int, files_per_batch: int | None, state_folder: str | None, delivery: str, most_tasks: int) -> DataFrame:
    """exact_dedup() of rows with __id, __text, FILE and ROW."""
    spark = rows.sparkSession
    folder = (state_folder or common.scratch(spark, "dedup")).rstrip("/")
    rows = rows.withColumn("__sha", F.unhex(F.sha2(F.col("__text"), 256)))
    rows = rows.withColumn("digest", F.substring("__sha", 1, digest_bytes))
    path = f"{folder}/prints/{delivery}"
    if not _exists(spark, f"{path}/_SUCCESS"):  # else an earlier try came so far
        rows.drop("__text").coalesce(most_tasks).write.mode("overwrite").parquet(path)
    prints = spark.read.schema(rows.drop("__text").schema).parquet(path)
    if _run_stream(spark, folder, prints, files_per_batch, state_folder is not None):
        state = common.written(_state(spark, folder), "dedup-state", most_tasks=most_tasks)
    else:  # no delivery has had a row yet
        state = _summed(prints)

    # Full bytes on hits: texts are gathered once per digest and task before they are exchanged, so a group of any
    # size sends one copy per task. What stands from an earlier delivery is read where its locator says.
    hits = state.filter("__n > 1")
    hit = common.maybe_in(rows, "digest", hits.select("digest")).select("digest", "__text")
    earlier = hits.join(prints.select("digest").distinct(), "digest", "left_semi").select("digest", F.col(f"__keep.{FILE}").alias(FILE), F.col(f"__keep.{ROW}").alias(ROW))
    others = _others(spark, folder, delivery)
    if others:
        foreign = common.written(earlier.join(prints.select(FILE, ROW), [FILE, ROW], "left_anti"), "dedup-earlier", most_tasks=most_tasks)
        hit = hit.unionByName(_texts_at(foreign, text_col).select("digest", "__text"))
    several = hit.groupBy("digest").agg(F.collect_set("__text").alias("__texts")).filter(F.size("__texts") > 1).select("digest")
    several = common.written(several, "dedup-several", most_tasks=most_tasks)

    def result(groups: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
        """members with the row that stays of their group."""
        both = members.join(groups, on)
        return both.select(
            "__id", F.col("__keep.__id").alias("keep_id"), F.col("__n").cast("long").alias("group_size"),
            ((F.col(FILE) == F.col(f"__keep.{FILE}")) & (F.col(ROW) == F.col(f"__keep.{ROW}"))).alias("kept"),
            F.lower(F.hex("__sha")).alias("text_sha256"), FILE, ROW,
        )

    if several.isEmpty():
        return result(state, prints, ["digest"])
    alone = result(state.join(several, "digest", "left_anti"), prints, ["digest"])
    mixed = rows.join(several, "digest", "left_semi")
    every = mixed.select("digest", "__text", "__id", FILE, ROW)
    for p in others:
        old = spark.read.schema(prints.schema).parquet(p).join(several, "digest", "left_semi")
        every = every.unionByName(_texts_at(old, text_col).select(every.columns))
    groups = every.groupBy("digest", "__text").agg(F.max(F.struct("__id", FILE, ROW)).alias("__keep"), F.count(F.lit(1)).alias("__n"))
    return alone.unionByName(result(groups, mixed, ["digest", "__text"]))


def _others(spark: SparkSession, folder: str, delivery: str) -> list[str]:
    """The folders of the other deliveries' fingerprints."""
    fs, at = scratch._hadoop(spark, f"{folder}/prints")
    return [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName() != delivery]


def _located(docs: DataFrame, state: str | None, delivery: str) -> DataFrame:
    """docs with locators that last as long as the state does."""
    if state is None or common._rows_of_files(docs):
        return common.located(docs)
    path = f"{state}/texts/{delivery}"
    if not _exists(docs.sparkSession, f"{path}/_SUCCESS"):
        docs.write.mode("overwrite").parquet(path)
    return common.located(docs.sparkSession.read.schema(docs.schema).parquet(path))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, files_per_batch: int | None = None, state: str | None = None, delivery: str = "1") -> DataFrame:
    """One row per row of docs: the id column, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, and the empty texts are one group. Of equal
    texts the row with the largest id stays (a null id is the smallest). Rows that repeat with the same id
    are told apart by their locator, so exactly one row of each group stays. Texts of any length are hashed where
    they are read; an empty table gives no rows. Other columns, whatever their names, are ignored. digest_bytes
    shortens the digest, for tests of the path that tells colliding texts apart.

    state names a folder of shared storage in which the state stays: docs are then one delivery of many, named by
    delivery, and are held against all deliveries before (group_size counts these too; a row of a later delivery with
    a larger id takes the place of the one that stood). A delivery that is run again, say after a failure, counts
    once. Without state, all goes after the call. Micro-batches take files_per_batch files of fingerprints
    (by default four to a core, 64 at least).
    """
    rows = _located(docs, state, delivery)
    picked = rows.select(common.of_input(id_col).alias("__id"), F.coalesce(common.of_input(text_col), F.lit("")).alias("__text"), FILE, ROW)
    n = common.tasks(docs)
    out = _classes(picked, text_col, digest_bytes, files_per_batch, state, delivery, n)
    return out.select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256").coalesce(n)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, delivery: str = "1") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay as they are.

    Nulls, empty and long texts, ties and repeated rows as there; an empty table stays empty. Columns of any name
    pass through, those of the operator's own helpers too.
    """
    rows = _located(docs, state, delivery)
    picked = rows.select(common.of_input(id_col).alias("__id"), F.coalesce(common.of_input(text_col), F.lit("")).alias("__text"), FILE, ROW)
    n = common.tasks(docs)
    dropped = _classes(picked, text_col, 32, None, state, delivery, n).filter("NOT kept").select(FILE, ROW)
    return common.input_rows(rows.join(dropped, [FILE, ROW], "left_anti")).coalesce(n)
