"""Increments of axioms from a stream of documents, each one added to the saturated state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.operators.normalize import eliminate_ranges, normalise
from axiomflow.plans.saturate import Closure, extend, saturate
from axiomflow.schema import Axioms
from axiomflow.sources.owl import parse_documents
from axiomflow.storage import children, delete, fresh_path, read_small, write_small


class IncrementalClassifier:
    """A closure that grows by increments; results equal those of one batch over all axioms.

    All state lies below ``path``: the normal-form tables of each increment, the axioms that the closure follows, the closure, and a
    manifest of each increment that is written last. A classifier made with the path of an earlier one goes on from there; an increment that was
    cut off before its manifest is taken again.
    """

    def __init__(self, spark: SparkSession, base: DataFrame | None = None, path: str | None = None):
        self.spark, self.path, self.increment = spark, path or fresh_path(spark, "increments"), 0
        self.closure: Closure | None = None
        self.raw: Axioms | None = None
        self.figures: list[dict] = []
        self.batch = -1
        self._load()
        if base is not None and not self.increment:
            self.add(base)

    def _tables(self, folder: str, like: Axioms) -> Axioms:
        """The tables of a folder that holds one folder of Parquet for each kind."""
        return Axioms(**{k: self.spark.read.schema(t.schema).parquet(f"{self.path}/{folder}/{k}") for k, t in like.tables().items()})

    def _load(self) -> None:
        manifests = [x for x in children(self.spark, f"{self.path}/manifest") if x.isdigit()]
        if not manifests:
            delete(self.spark, f"{self.path}/closure")
            return
        state = json.loads(read_small(self.spark, f"{self.path}/manifest/{manifests[-1]}"))
        self.increment, self.batch, self.figures = state["increment"], state["batch"], state["figures"]
        empty = Axioms.of(self.spark)
        for i in range(1, self.increment + 1):
            here = self._tables(f"raw/{i}", empty)
            self.raw = here if self.raw is None else self.raw.union(here)
        axioms = self._tables(f"axioms/{self.increment}", empty)
        self.closure = Closure(self.spark, f"{self.path}/closure", "string", rounds=state["rounds"], axioms=axioms)
        for kind in ("S", "R"):  # rounds of an increment that was cut off: their facts were not followed to the end
            for name in children(self.spark, f"{self.path}/closure/{kind}"):
                if name.startswith("round=") and int(name[6:]) > state["rounds"]:
                    delete(self.spark, f"{self.path}/closure/{kind}/{name}")

    def add(self, axioms: DataFrame, batch: int | None = None) -> Closure:
        """Adds axiom rows (with a column ``axiom`` in functional syntax)."""
        number = self.increment + 1
        tables, _ = normalise(axioms, ranges=False)
        for kind, table in tables.tables().items():
            table.write.mode("overwrite").parquet(f"{self.path}/raw/{number}/{kind}")
        here = self._tables(f"raw/{number}", tables)
        self.raw = here if self.raw is None else self.raw.union(here)
        # a range may reach existentials of earlier increments; folded over the whole, only what is new is added
        for kind, table in eliminate_ranges(self.raw).tables().items():
            table.write.mode("overwrite").parquet(f"{self.path}/axioms/{number}/{kind}")
        whole = self._tables(f"axioms/{number}", tables)
        if self.closure is None:
            self.closure = saturate(whole, path=f"{self.path}/closure")
        else:
            known = self.closure.axioms
            self.closure = extend(self.closure, Axioms(**{k: t.subtract(getattr(known, k)) for k, t in whole.tables().items()}))
            self.closure.axioms = whole
        self.increment, self.batch = number, self.batch if batch is None else batch
        self.figures.append({"increment": number, "rounds": self.closure.rounds})
        write_small(self.spark, f"{self.path}/manifest/{number:08}", json.dumps({"increment": number, "batch": self.batch, "rounds": self.closure.rounds, "figures": self.figures}))
        return self.closure

    def follow(self, folder: str, checkpoint: str | None = None, files_per_batch: int = 1):
        """Runs a stream over the documents of a folder, ``files_per_batch`` an increment, until all are taken. Batches that the
        manifest knows are passed over, so a stream that was cut off goes on without a loss."""
        docs = self.spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)

        def take(batch: DataFrame, number: int) -> None:
            if number > self.batch:
                rows = parse_documents(batch.select(F.lit("").alias("file"), F.col("value").alias("text")))
                self.add(rows.filter(~F.col("kind").isin("Import", "Error")), number)

        query = docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint or f"{self.path}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.closure
