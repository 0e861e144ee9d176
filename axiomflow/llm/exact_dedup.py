"""Exact deduplication with keyed streaming state.

A stream over the files keeps, for each SHA-256 digest of the normalised text, how many rows had it and which row is
best: its rank, identifier and content locator (the file). The state lives on disk (RocksDB), in the checkpoint
folder between batches, and never expires. Rows whose digest has been seen are checked byte for byte against the
text of the row that stays.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.common import fresh_path, materialised, prepare
from axiomflow.storage import is_plain, size_of

DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: space is not set aside ahead of use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: For checkpoints in a folder of the operating system, where a plain rename overwrites at one stroke. Spark's default there
#: starts sixteen ``readlink`` processes for each state partition, and a process that just starts shares all of an executor's memory.
PLAIN_RENAME = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}

#: Bytes of input for each partition of a state that is used once. An open store takes about 0.8 MB of an executor besides its rows.
STATE_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c))
    return out


def digest(normal: Column) -> Column:
    """SHA-256 of a normalised text, as bytes."""
    return F.unhex(F.sha2(normal, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_partitions(spark: SparkSession, path: str) -> int:
    """By the size of the input: as many as tasks can run at least, those of a shuffle at most."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-size_of(spark, path) // STATE_BYTES)))


def run_stream(rows: DataFrame, checkpoint: str, changes: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream of (digest, best, locator...) to the end of what is there and returns the state.

    ``rows`` is a streaming frame with ``digest`` and ``best`` (struct, the least one stays). A later call with the
    same folders goes on from the state kept in ``checkpoint``. Each batch writes the changed keys to a folder of
    its own below ``changes``, which a repeated batch overwrites. ``partitions`` of a new state: those of a shuffle
    if it isn't given.
    """
    spark = rows.sparkSession
    state = rows.groupBy("digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    schema = state.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/epoch={epoch}")

    rows.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{changes}/epoch=-1")  # for streams without rows
    settings = DISK_STATE | (PLAIN_RENAME if is_plain(spark, checkpoint) else {}) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    with _settings(spark, settings):
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(changes)
    return read.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "epoch").alias("s")).select("digest", "s.best", "s.n")


def _as_glob(path: str) -> str:
    """A pattern that only ``path`` fits: a file stream takes a plain path for a folder, and it may be one file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 256 << 30, checkpoint: str | None = None) -> DataFrame:
    """One row for each row of the Parquet files at ``path``: id_col, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``, ``keep_locator`` (file of the row that stays).

    Of rows with equal normalised texts the one with the most code points in the original text stays, then the one
    with the smallest id (a null id counts as smallest). Null and empty texts are equal to each other. Repeated rows
    with the same id and text are all counted, and all of them are ``kept`` if they equal the one that stays.
    Other columns are left out. ``batch_bytes`` bounds a micro-batch; ``checkpoint`` names a folder to go on from.
    """
    prepare(spark)
    docs = spark.read.parquet(path)
    base = checkpoint or fresh_path(spark, "exact-dedup")
    text, doc = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    size = -F.length(F.coalesce(text, F.lit(""))).cast("bigint")
    stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(_as_glob(path))
    rows = stream.select(digest(normalised(text)).alias("digest"), F.struct(size.alias("size"), doc.alias("id"), F.col("_metadata.file_path").alias("locator")).alias("best"))
    # written first, as are the other grouped tables below: a join of two tables can split the rows of a hot digest
    # a state that later calls go on from keeps its number of partitions, so it gets those of a shuffle
    partitions = None if checkpoint else state_partitions(spark, path)
    state = materialised(run_stream(rows, f"{base}/state", f"{base}/changes", partitions), "exact-state")

    # rows beside their state; only rows whose digest was hit carry their text on
    plain = docs.select(doc.alias("id"), size.alias("size"), normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    met = materialised(plain.join(state.select("digest", "best", "n"), "digest").select("digest", "id", "size", "best", "n", F.when(F.col("n") > 1, F.col("norm")).alias("norm")), "exact-met")
    hits = met.filter("n > 1")
    keeper = hits.filter(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("size") == F.col("best.size"))).groupBy("digest").agg(F.min("norm").alias("keep_norm"))
    keeper = materialised(keeper, "exact-keepers")
    checked = hits.join(keeper, "digest").select("digest", "id", "size", "best", "n", F.when(F.col("norm") != F.col("keep_norm"), F.col("norm")).alias("other"))
    checked = materialised(checked, "exact-checked")
    # texts that share a digest and differ form groups by their bytes
    groups = checked.groupBy("digest", "other").agg(F.min(F.struct("size", "id", F.col("best.locator").alias("locator"))).alias("b"), F.count(F.lit(1)).alias("m")).withColumnsRenamed({"digest": "d2", "other": "o2"})
    groups = materialised(groups, "exact-groups")
    same = checked.join(groups, (F.col("digest") == F.col("d2")) & F.col("other").eqNullSafe(F.col("o2"))).select("digest", "id", checked["size"], F.col("b").alias("best"), F.col("m").alias("n"))
    single = met.filter("n = 1").select("digest", "id", "size", "best", "n")
    out = single.unionByName(same)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("size") == F.col("best.size"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("best.locator").alias("keep_locator"))
