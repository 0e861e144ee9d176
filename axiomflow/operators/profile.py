"""Filters of axioms by language profile. Axiom rows are (file, kind, axiom) in functional syntax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of axioms that the profile keeps.
EL_AXIOMS = ("SubClassOf", "EquivalentClasses", "DisjointClasses", "SubObjectPropertyOf", "EquivalentObjectProperties", "TransitiveObjectProperty", "ObjectPropertyDomain", "ObjectPropertyRange", "ClassAssertion", "ObjectPropertyAssertion", "SubDataPropertyOf", "DataPropertyAssertion", "Declaration")
#: Expressions outside the profile.
BEYOND_EL = ("ObjectUnionOf", "ObjectComplementOf", "ObjectAllValuesFrom", "ObjectMinCardinality", "ObjectMaxCardinality", "ObjectExactCardinality", "ObjectHasSelf", "ObjectInverseOf", "DataAllValuesFrom", "DataMinCardinality", "DataMaxCardinality", "DataExactCardinality", "DataUnionOf", "DataComplementOf", "DataOneOf", "DatatypeRestriction")
SEVERAL = r"ObjectOneOf\((?:<[^>]*>\s*){2,}\)"


def beyond(axiom: Column) -> Column:
    """The first expression of an axiom that the profile lacks, or null."""
    hit = F.regexp_extract(axiom, rf"\b({'|'.join(BEYOND_EL)})\(", 1)
    return F.when(hit != "", hit)


def reason(kind: Column, axiom: Column) -> Column:
    """Why an axiom is outside the profile; null if it is inside."""
    several_right = axiom.rlike(rf"{SEVERAL}\)*$") & kind.isin("SubClassOf", "EquivalentClasses")
    return F.coalesce(F.when(~kind.isin(*EL_AXIOMS), F.concat(F.lit("axiom "), kind)), F.concat(F.lit("expression "), beyond(axiom)), F.when(several_right, F.lit("several individuals")))


def split_profile(axioms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Axioms inside the profile, and (axiom, kind, reason) of those outside."""
    marked = axioms.withColumn("reason", reason(F.col("kind"), F.col("axiom")))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select("axiom", "kind", "reason")


def profile_report(axioms: DataFrame) -> DataFrame:
    """(reason, n) of what the profile leaves out."""
    return split_profile(axioms)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def extract_el(base: DataFrame, more: DataFrame) -> DataFrame:
    """Profile axioms of both, once each."""
    return split_profile(base.unionByName(more))[0].select("kind", "axiom").distinct()


def without_data_values(axioms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Axioms without those that end in a DataHasValue, and the (datatype) names that those had."""
    right = F.col("axiom").rlike(r"^SubClassOf\(.*DataHasValue\([^()]*\)\)$")
    kinds = axioms.filter(right).select(F.coalesce(F.nullif(F.regexp_extract("axiom", r"\^\^<?([^>)\s]+)>?\)+$", 1), F.lit("")), F.lit("xsd:string")).alias("datatype"))
    return axioms.filter(~right), kinds.distinct()


def without_expressions(axioms: DataFrame, names: tuple[str, ...] = ("DataSomeValuesFrom", "ObjectExactCardinality")) -> DataFrame:
    return axioms.filter(~F.col("axiom").rlike(rf"\b(?:{'|'.join(names)})\("))


def side_kind(side: Column) -> Column:
    """class, existential, intersection, nominal, or other, for one side in functional syntax."""
    return (
        F.when(side.rlike(r"^<[^>]*>$"), "class")
        .when(side.rlike(r"^(Object|Data)(SomeValuesFrom|HasValue)\("), "existential")
        .when(side.startswith("ObjectIntersectionOf("), "intersection")
        .when(side.startswith("ObjectOneOf("), "nominal")
        .otherwise("other")
    )


def is_basic(side: Column) -> Column:
    return side_kind(side).isin("class", "nominal")
