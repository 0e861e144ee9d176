"""Rule dependencies and the cost model that shares out workers among rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which rules' new facts a rule waits for.
DEPENDS = {
    "sub": ("sub", "conj", "exl_join"),
    "conj": ("sub", "conj", "exl_join"),
    "ex": ("sub", "conj", "exl_join"),
    "exl": ("sub", "conj", "exl_join"),
    "exl_join": ("ex", "role", "chain", "exl"),
    "role": ("ex", "chain"),
    "chain": ("ex", "role"),
    "bottom": ("ex", "chain", "role"),
}
#: The share of work that an axiom of each rule stands for, of 20.
WEIGHTS = {"sub": 1, "conj": 2, "ex": 1, "exl": 1, "exl_join": 8, "role": 3, "chain": 3, "bottom": 1}


def affected(new: set[str]) -> set[str]:
    """Rules that have to run again when others found something."""
    return {rule for rule, on in DEPENDS.items() if new & set(on)}


def estimated_counts(counts: dict[str, int]) -> dict[str, int]:
    """Axioms that feed each rule: joined rules are fed by what their inputs may find."""
    get = lambda *names: sum(counts.get(n, 0) for n in names)
    role_like = get("chain", "role", "ex")
    return {"sub": get("sub"), "conj": get("conj"), "ex": get("ex"), "exl": get("exl"), "exl_join": get("ex", "exl", "role", "chain"), "role": role_like if get("role") else 0, "chain": role_like if get("chain") else 0, "bottom": get("bottom")}


def placement(spark: SparkSession, counts: dict[str, int], workers: int) -> DataFrame:
    """(rule, score, workers): scores are weight * count; each rule with work gets one worker and a share of the
    others in proportion, rounded down; what is left goes to the rules of the highest scores."""
    rows = [(rule, WEIGHTS[rule] * n) for rule, n in estimated_counts(counts).items()]
    df = spark.createDataFrame(rows, "rule string, score bigint")
    active = df.filter("score > 0")
    total = active.agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("rules"))
    shared = active.crossJoin(F.broadcast(total)).withColumn("base", 1 + F.floor((workers - F.col("rules")) * F.col("score") / F.col("total")))
    left = F.lit(workers) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "rule"))
    return shared.select("rule", "score", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("workers")).orderBy(F.desc("score"), "rule")


def least_complete(progress: DataFrame) -> DataFrame:
    """(rule, done): the rule that is furthest from done, of those that aren't."""
    each = progress.groupBy("rule").agg(F.min("done").alias("done")).filter("done < 1")
    return each.agg(F.min_by(F.struct("rule", "done"), F.struct("done", "rule")).alias("m")).filter("m IS NOT NULL").select("m.rule", "m.done")
