"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.storage import fresh_path, materialised, shared_dir

__all__ = ["ByteCache", "arrow_map", "delete_path", "free_name", "fresh_path", "materialised", "prepare", "release", "resident", "shared_dir"]


def prepare(spark: SparkSession) -> None:
    """Makes this package importable in Python workers and sees that a checkpoint folder is set.

    On a cluster the package reaches the executors by ``--py-files`` or a shared path; the entry in the
    worker environment below only helps where the same path exists, as in local mode.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    if root not in sys.path:
        sys.path.append(root)
    shared_dir(spark)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(
    df: DataFrame,
    text_col: str,
    fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[list], Iterable[tuple]]],
    binary: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed in Arrow batches from one text column.

    ``make()`` runs once per task and returns a function from a list of texts (``bytes`` if ``binary``; nulls
    become empty) to one tuple per text. ``keep`` names the columns passed through (all by default). An added
    column replaces one of the same name.
    """
    names = [f[0] for f in fields]
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    hidden = free_name(df, "__text")
    source = df.select(*[F.col(f"`{c}`") for c in passed], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(hidden))
    schema = T.StructType([source.schema[c] for c in passed] + [T.StructField(n, t) for n, t, _ in fields])
    kinds = [k for _, _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            # long texts: small slices bound what Python holds at once
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                column = batch.column(batch.schema.get_field_index(hidden))
                texts = (column.cast(pa.binary()) if binary else column).to_pylist()
                rows = list(compute(texts))
                added = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*passed, *names])

    return source.mapInArrow(run, schema)


_resident: dict[str, object] = {}


def _trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: freed memory stays with the process
        pass


def release() -> None:
    """Lets go of what this worker process has kept for other operators."""
    if _resident:
        _resident.clear()
        _trim()


def resident(key: str, make: Callable[[], object]):
    """The object that this worker process keeps between tasks: one at a time, so that workers which serve one
    operator after another don't add up their models and caches."""
    if key not in _resident:
        release()
        _resident[key] = make()
        _trim()  # what building it took besides
    return _resident[key]


class ByteCache(dict):
    """A map bounded by the bytes of its keys, in two generations: a full young one becomes the old one, hits in the old
    one move back. Keys longer than ``longest`` are computed each time and never kept."""

    #: Bytes that an entry takes besides its key's characters, about.
    ENTRY = 200

    def __init__(self, limit: int, make: Callable, longest: int = 64):
        super().__init__()
        self.limit, self.make, self.longest, self.old, self.size = limit // 2, make, longest, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        self.size += self.ENTRY + len(key)
        return value
