"""Tables in the shared checkpoint folder, and broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table counts as small enough to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode, where driver and tasks are one process, may it be unset:
    a temporary folder then takes its place. Anywhere else tables would go astray, so an unset folder is an error."""
    sc, key = spark.sparkContext, "spark.checkpoint.dir"
    base = sc.getConf().get(key) or spark.conf.get(key, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set {key} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="axiomflow-")
        spark.conf.set(key, base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str = "table", path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage, safe from lost executors."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark drops a query's shuffle files when the query has ended, and not only when the driver collects its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_counted(df: DataFrame, path: str, compression: str | None = None) -> int:
    """Writes ``df`` and returns its number of rows, in one job whose shuffle files go with it."""
    seen, conf = Observation(), df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        (out.option("compression", compression) if compression else out).parquet(path)
    finally:
        conf.unset(CLEAN_SHUFFLES) if before is None else conf.set(CLEAN_SHUFFLES, before)
    return seen.get["n"]


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """As ``materialised``, without the shuffle files."""
    path = fresh_path(df.sparkSession, label)
    write_counted(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local(df: DataFrame) -> bool:
    """Whether the optimized plan is a local relation, whose rows the driver has already."""
    return df._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return reduce(Column.__add__, texts, F.lit(16 * len(df.columns))).cast("bigint")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the counted rows and bytes of ``df`` are within the bounds; counting ends beyond them."""
    if is_local(df):
        rows = df.take(BROADCAST_ROWS + 1)
        return len(rows) <= BROADCAST_ROWS and sum(16 * len(r) + sum(len(v) for v in r if isinstance(v, str)) for r in rows) <= BROADCAST_BYTES
    seen = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("bytes")).first()
    return seen.n <= BROADCAST_ROWS and (seen.bytes or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is within the bounds; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df) else df


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_plain(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in a file system of the operating system, local or mounted."""
    return _folder(spark, path)[1].getScheme() == "file"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, of all files below a folder, or of all that fit a pattern."""
    place, fs = _folder(spark, path)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(place) or ())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    place, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _folder(spark, path)
    fs.delete(place, True)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, there as a whole or not at all: written under a hidden name and renamed."""
    place, fs = _folder(spark, path)
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(hidden, place)


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
