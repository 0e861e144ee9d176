"""The normaliser as a job: documents of a folder in, normal-form documents, rejected axioms and totals out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.operators.normalize import normalise, rejected_totals
from axiomflow.schema import COLUMNS
from axiomflow.sources import owl


def normaliser_job(spark: SparkSession, source: str, target: str, imports: dict[str, str] | None = None, ranges: bool = True) -> DataFrame:
    """Reads the documents of ``source``, writes ``target``/axioms (functional syntax, a folder of each kind), ``target``/rejected
    (axiom, kind, reason) and ``target``/totals, and returns the totals: (kind, n) of normal-form axioms, rejected axioms
    and unread documents. Normal-form documents can be read again by ``read_ontology``."""
    rows = owl.read_ontology(spark, source, imports)
    tables, rejected = normalise(rows.filter(~F.col("kind").isin("Import", "Error")), ranges)
    rejected.write.mode("overwrite").parquet(f"{target}/rejected")
    totals = rejected_totals(spark.read.parquet(f"{target}/rejected")).unionByName(rows.filter("kind = 'Error'").agg(F.lit("unread").alias("kind"), F.count(F.lit(1)).alias("n")))
    for kind in COLUMNS:
        path = f"{target}/axioms/{kind}"
        owl.normal_form_lines(kind, getattr(tables, kind)).write.mode("overwrite").text(path)
        totals = totals.unionByName(spark.read.text(path).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")))
    totals.filter("n > 0").coalesce(1).write.mode("overwrite").parquet(f"{target}/totals")
    return spark.read.parquet(f"{target}/totals")
