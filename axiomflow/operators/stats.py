"""Counts and statistics of axioms, facts and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomflow.schema import CLASS, INDIVIDUAL, ROLE, Axioms


def axiom_counts(ax: Axioms, distinct: bool = True) -> DataFrame:
    """(axiom_type, n) of each table; conjunctions count once each."""
    out = None
    for kind, df in ax.tables().items():
        if kind == "individuals":
            continue
        rows = df.select("conj_id") if kind == "conj" else df
        rows = rows.distinct() if distinct or kind == "conj" else rows
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("axiom_type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def closure_counts(s: DataFrame, r: DataFrame) -> DataFrame:
    """(relation, n) of both relations."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
    return n(s, "S").unionByName(n(r, "R"))


def set_size_stats(facts: DataFrame, key: str) -> DataFrame:
    """(n_sets, avg_size, max_size) of the sets that a relation holds for each key."""
    sizes = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_sets"), F.round(F.avg("n"), 6).alias("avg_size"), F.max("n").alias("max_size"))


def top_sets(facts: DataFrame, key: str, k: int = 1) -> DataFrame:
    """The k largest sets (key, n); ties by key."""
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def shapes(ax: Axioms) -> DataFrame:
    """(axiom_type, lhs, rhs) of each axiom: shapes of the two sides."""
    s = lambda kind, df, lhs, rhs: df.select(F.lit(kind).alias("axiom_type"), F.lit(lhs).alias("lhs"), F.lit(rhs).alias("rhs"))
    parts = [
        s("sub", ax.sub.distinct(), "class", "class"),
        s("conj", ax.conj.select("conj_id").distinct(), "intersection", "class"),
        s("ex", ax.ex.distinct(), "class", "existential"),
        s("exl", ax.exl.distinct(), "existential", "class"),
        s("role", ax.role.distinct(), "role", "role"),
        s("chain", ax.chain.distinct(), "chain", "role"),
        s("dom", ax.dom.distinct(), "domain", "class"),
        s("rng", ax.rng.distinct(), "range", "class"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_histogram(shape: DataFrame) -> DataFrame:
    return shape.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n"))


def shape_crosstab(shape: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each left side, one column for each right side."""
    return shape.groupBy("lhs").agg(*[F.count_if(F.col("rhs") == c).alias(f"n_{c}") for c in columns])


def shape_rollup(by_file: DataFrame) -> DataFrame:
    """(file, shape, n) with totals of files and of all; null stands for a total."""
    return by_file.rollup("file", "shape").agg(F.count(F.lit(1)).alias("n"))


def box_counts(axioms: DataFrame) -> DataFrame:
    """(abox, tbox, rbox) of axiom rows by kind."""
    assertion = F.col("kind").endswith("Assertion")
    roles = F.col("kind").rlike("Propert(y|ies)") & ~assertion
    return axioms.filter("kind != 'Declaration'").agg(F.count_if(assertion).alias("abox"), F.count_if(~assertion & ~roles).alias("tbox"), F.count_if(roles).alias("rbox"))


def running_mean(costs: DataFrame, order: str, cost: str, group: str | None = None) -> DataFrame:
    """costs with ``n`` and ``mean`` of all rows up to each one, within a group if there is one.

    Without a group the prefix sums are made in two steps: sums of ranges, then sums within a range, so no task sees
    all rows. ``order`` must hold no ties.
    """
    if group:
        w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return costs.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean", F.avg(cost).over(w))
    from axiomflow.storage import materialised

    parts = materialised(costs.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, n, total = [], 0, 0.0
    for row in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("t")).orderBy("__part").collect():
        before.append((row["__part"], n, float(total)))
        n, total = n + row.n, total + (row.t or 0)
    offsets = costs.sparkSession.createDataFrame(before, "__part int, __n bigint, __t double")
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("__cn", F.count(F.lit(1)).over(w)).withColumn("__ct", F.sum(cost).over(w)).join(F.broadcast(offsets), "__part")
    return summed.withColumn("n", F.col("__n") + F.col("__cn")).withColumn("mean", (F.col("__t") + F.col("__ct")) / F.col("n")).drop("__part", "__n", "__t", "__cn", "__ct")


def longest_prefix(running: DataFrame, limit: float) -> DataFrame:
    """(n_within): the greatest n whose mean is at most the limit."""
    return running.filter(F.col("mean") <= limit).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_within"))


def log_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(axioms, individuals, load_ms, classify_s, files) summed over the lines of classification logs."""
    v = F.col(value)
    number = lambda label: F.regexp_extract(v, rf"^\s*{label}:\s*(\d+)", 1).try_cast("bigint")
    time = F.regexp_extract(v, r"^real\s+(\d+)m", 1).try_cast("double") * 60 + F.regexp_extract(v, r"^real\s+\d+m([\d.]+)s", 1).try_cast("double")
    return lines.agg(
        F.coalesce(F.sum(number("Logical axioms")), F.lit(0)).alias("axioms"),
        F.coalesce(F.sum(number("Individuals")), F.lit(0)).alias("individuals"),
        F.coalesce(F.sum(number(r"Time taken \(millis\)")), F.lit(0)).alias("load_ms"),
        F.round(F.coalesce(F.sum(time), F.lit(0.0)), 3).alias("classify_s"),
        F.count_if(v.rlike(r"^\s*\d+ file: ")).alias("files"),
    )


def classify_times(lines: DataFrame, value: str = "value", order: str = "n") -> DataFrame:
    """(order, seconds) of the lines that time a run."""
    v = F.col(value)
    time = F.regexp_extract(v, r"^real\s+(\d+)m", 1).try_cast("double") * 60 + F.regexp_extract(v, r"^real\s+\d+m([\d.]+)s", 1).try_cast("double")
    return lines.filter(v.rlike(r"^real\s+\d+m[\d.]+s")).select(order, time.alias("seconds"))


def signature_rollup(entities: DataFrame) -> DataFrame:
    """(file, classes, individuals, roles) of (file, iri, kind): distinct names in each file, and in all files together
    (null file), where a name that several files share counts once."""
    once = entities.select("file", "iri", "kind").distinct()
    whole = once.select(F.lit(None).cast("string").alias("file"), "iri", "kind").distinct()
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return once.unionByName(whole).groupBy("file").agg(count(CLASS).alias("classes"), count(INDIVIDUAL).alias("individuals"), count(ROLE).alias("roles"))


def load_metrics(axioms: Axioms) -> DataFrame:
    """(axioms, concepts, individuals, roles) of normal-form tables, as a load reports them."""
    kinds = axioms.signature().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    rows = axiom_counts(axioms).select(F.lit(-1).cast("tinyint").alias("kind"), "n").unionByName(kinds)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return rows.agg(total(-1).alias("axioms"), total(CLASS).alias("concepts"), total(INDIVIDUAL).alias("individuals"), total(ROLE).alias("roles"))
