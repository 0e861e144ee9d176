"""A corpus pipeline of five text operators: toxicity, line dedup, near-dedup, decontamination, BPE.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``, with ``n_chars`` of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomflow.llm import bpe, decontam, linedup, minhash, toxicity
from axiomflow.llm.common import materialised, prepare


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names of no operator: its own columns can't be taken for those that an operator adds."""
    names = {c: c if c in ("doc_id", "text") else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _shown(df: DataFrame, names: dict[str, str], text: str | None = None) -> DataFrame:
    """The documents' own columns; with ``text``, the text of that column and its length."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")} if text else {}
    return df.select(*[new.get(c, F.col(f"`{n}`").alias(c)) for c, n in names.items()])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Only labels of documents that are not held out are learned from. Null and empty texts
    get the score of a text without known terms; rows with equal ids are scored each by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    held, names = _hidden(docs)
    return _shown(toxicity.score(held, model).filter("predicted = 0"), names)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All lines that later occurrences of repeated passages cover are cut; a document of which nothing stays goes. A null
    text becomes empty."""
    held, names = _hidden(docs)
    cut = linedup.dedup_lines(held, "doc_id", "text", spare_first=False)
    return _shown(cut.filter((F.col("n_removed") == 0) | F.col("dedup_text").rlike(r"[^ \t\n\r\x0b\x0c]")), names, "dedup_text")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; texts without words stay all."""
    return minhash.drop_near_duplicates(docs, "doc_id", "text", percent=75)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that consist mostly of them go."""
    held, names = _hidden(docs)
    kept = decontam.decontaminate(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", window=10, max_coverage=0.5)
    return _shown(kept, names, "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text that they decode to. Null texts have no tokens."""
    return bpe.encode_text(docs, "text", "word_bpe_49k.json", decoded=True, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("toxicity", keep_civil), ("line dedup", cut_repeated_lines), ("near dedup", keep_one_of_each_group), ("decontamination", cut_benchmark), ("bpe", encode)]

#: Scores, near-duplicate components and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
