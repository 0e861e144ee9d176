"""Tables of axioms and facts.

Columns that name entities are strings (IRIs) before dictionary encoding and bigints after it; the operators
only compare them, so they work on both.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASS, INDIVIDUAL, ROLE, DATATYPE = 0, 1, 2, 3
BOTTOM_ID, TOP_ID = 0, 1
BOTTOM, TOP = "owl:Nothing", "owl:Thing"

#: Columns of each axiom table, in normal form.
COLUMNS = {
    "sub": ("a", "b"),
    "conj": ("conj_id", "operand", "arity", "b"),
    "ex": ("a", "r", "b"),
    "exl": ("r", "a", "b"),
    "role": ("r", "s"),
    "chain": ("r", "s", "t"),
    "dom": ("r", "d"),
    "rng": ("r", "d"),
}
#: Columns that name entities, and the kind of entity; None where a class or an individual may stand.
ENTITY = {"a": None, "b": None, "operand": None, "d": None, "r": ROLE, "s": ROLE, "t": ROLE}

#: Bits of an inline id (dictionary.Inline) that hold its number, and the most digits that are taken for one.
NUMBER_BITS, DIGITS = 41, 12


def digits(c: Column) -> Column:
    """How many characters of an IRI are its number: the last digits from the first that isn't 0; 0 if there are more than DIGITS."""
    n = F.length(F.ltrim(F.substring(c, F.length(F.rtrim(c, F.lit("0123456789"))) + 1, F.lit(2**31 - 1)), F.lit("0")))
    return n * (n <= DIGITS).cast("int")


def stem(c: Column) -> Column:
    """An IRI without its number."""
    return F.substring(c, F.lit(1), F.length(c) - digits(c))


def coarse(df: DataFrame, column: str) -> Column:
    """A coarser key: equal for equal entities, and with few values where IRIs or inline ids share their stems."""
    return stem(F.col(column)) if df.schema[column].dataType.typeName() == "string" else F.shiftright(column, NUMBER_BITS)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from Python rows as a local relation, which costs no job and which the optimizer sees through."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64()}
    columns = [c.split() for c in schema.split(",")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(columns)}))


def empty(spark: SparkSession, kind: str, entity: str = "string") -> DataFrame:
    types = {"conj_id": "bigint", "arity": "int"}
    return frame(spark, [], ", ".join(f"{c} {types.get(c, entity)}" for c in COLUMNS[kind]))


@dataclass(frozen=True)
class Axioms:
    """Normal-form axiom tables; individuals names those entities that are individuals (column x)."""

    sub: DataFrame
    conj: DataFrame
    ex: DataFrame
    exl: DataFrame
    role: DataFrame
    chain: DataFrame
    dom: DataFrame
    rng: DataFrame
    individuals: DataFrame

    @staticmethod
    def of(spark: SparkSession, entity: str = "string", **tables: DataFrame) -> Axioms:
        given = {k: tables[k].select(*COLUMNS[k]) if k in tables else empty(spark, k, entity) for k in COLUMNS}
        people = tables["individuals"] if "individuals" in tables else frame(spark, [], f"x {entity}")
        return Axioms(**given, individuals=people)

    @staticmethod
    def from_lists(spark: SparkSession, **rows: list[tuple]) -> Axioms:
        """From Python tuples; a conjunction is ((operand, ...), b)."""
        tables = {}
        for kind, values in rows.items():
            if kind == "conj":
                values = [("&".join(sorted(ops)), o, len(set(ops)), b) for ops, b in values for o in sorted(set(ops))]
                tables[kind] = frame(spark, values, "k string, operand string, arity int, b string").select(F.xxhash64("k", "b").alias("conj_id"), "operand", "arity", "b")
            elif kind == "individuals":
                tables[kind] = frame(spark, [(v,) for v in values], "x string")
            else:
                tables[kind] = frame(spark, values, ", ".join(f"{c} string" for c in COLUMNS[kind]))
        return Axioms.of(spark, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def union(self, other: Axioms) -> Axioms:
        return Axioms(**{k: v.unionByName(getattr(other, k)).distinct() for k, v in self.tables().items()})

    def with_union(self, other: Axioms) -> Axioms:
        """As union, but axioms that both have stand twice: nothing is moved."""
        return Axioms(**{k: v.unionByName(getattr(other, k)) for k, v in self.tables().items()})

    def with_(self, **tables: DataFrame) -> Axioms:
        return replace(self, **tables)

    def signature(self) -> DataFrame:
        """(iri, kind) of all entities named in the axioms: classes and individuals, then roles."""
        parts = []
        for kind, columns in COLUMNS.items():
            df = getattr(self, kind)
            parts += [df.select(F.col(c).alias("iri"), F.lit(ENTITY[c]).cast("int").alias("kind")) for c in columns if c in ENTITY]
        people = self.individuals.select(F.col("x").alias("iri"), F.lit(INDIVIDUAL).alias("kind"))
        out = people
        for p in parts:
            out = out.unionByName(p)
        return out.groupBy("iri").agg(F.coalesce(F.max("kind"), F.lit(CLASS)).cast("tinyint").alias("kind"))
