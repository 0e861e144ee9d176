"""Documents, normal forms, profile filters, small functions."""

import pytest
from pyspark.sql import functions as F

from axiomflow.functions import ids
from axiomflow.operators import dictionary, normalize, profile, setops, stats
from axiomflow.plans.saturate import facts, saturate
from axiomflow.sources import owl, settings, sinks


def closed(spark, *texts, ranges=True):
    tables, rejected = normalize.normalise(spark.createDataFrame([(t,) for t in texts], "axiom string"), ranges)
    return {tuple(r) for r in facts(saturate(tables)).collect() if not any(v.startswith("urn:fresh") for v in r)}, {r.reason for r in rejected.collect()}


def test_rows_of_one_axiom():
    rows = normalize.normal_rows(owl.parse_axiom("SubClassOf(<A> ObjectIntersectionOf(<B> ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D>))))"))
    kinds = sorted(r[0] for r in rows)
    assert kinds == ["ex", "sub", "sub", "sub"]
    assert rows == normalize.normal_rows(owl.parse_axiom("SubClassOf(<A> ObjectIntersectionOf(ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<D> <C>)) <B>))")) or len(rows) == 4


def test_shapes_after_rewriting():
    texts = [
        "SubClassOf(ObjectIntersectionOf(ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D>)) <E> <F>) <G>)",
        "SubClassOf(ObjectIntersectionOf(<A> <B>) ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D>)))",
        "EquivalentClasses(<A> <B> ObjectSomeValuesFrom(<r> <C>))",
    ]
    for t in texts:
        for kind, *_, operands in normalize.normal_rows(owl.parse_axiom(t)):
            assert kind in ("sub", "conj", "ex", "exl") and (kind != "conj" or len(operands) == 2)
    assert normalize.normal_rows(owl.parse_axiom("SubClassOf(<http://www.w3.org/2002/07/owl#Nothing> <A>)")) == []
    chain = normalize.normal_rows(owl.parse_axiom("SubObjectPropertyOf(ObjectPropertyChain(<a> <b> <c> <d>) <e>)"))
    assert [r[0] for r in chain] == ["chain"] * 3 and chain[-1][3] == "e"
    with pytest.raises(normalize.Unsupported):
        normalize.normal_rows(owl.parse_axiom("SubClassOf(<A> ObjectOneOf(<i> <j>))"))


def test_nested_axioms_close_as_meant(spark):
    found, rejected = closed(
        spark,
        "SubClassOf(ObjectIntersectionOf(ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D>)) <E> <F>) <G>)",
        "SubClassOf(<A> ObjectIntersectionOf(<E> <F> ObjectSomeValuesFrom(<r> ObjectIntersectionOf(<C> <D>))))",
        "SubObjectPropertyOf(ObjectPropertyChain(<p> <q> <s>) <t>)",
        "SubClassOf(<K> ObjectSomeValuesFrom(<p> ObjectSomeValuesFrom(<q> ObjectSomeValuesFrom(<s> <L>))))",
        "SubClassOf(ObjectSomeValuesFrom(<t> <L>) <M>)",
        "SubClassOf(ObjectOneOf(<i> <j>) <N>)",
        "ObjectPropertyAssertion(<t> <k> <l>)",
        "ClassAssertion(<L> <l>)",
        "SubClassOf(<A> ObjectUnionOf(<B> <C>))",
        "DisjointClasses(<E> <Z>)",
        "EquivalentClasses(<Q> ObjectIntersectionOf(<A> <Z>))",
    )
    assert {("A", "G"), ("K", "M"), ("i", "N"), ("j", "N"), ("k", "M"), ("Q", "owl:Nothing")} <= found
    assert rejected == {"ObjectUnionOf"}


def test_documents(spark, tmp_path):
    (tmp_path / "a.owl").write_text('Prefix(:=<http://x#>)\nOntology(<http://x>\nImport(<http://y>)\n# note\nDeclaration(Class(:A))\nSubClassOf(Annotation(rdfs:label "x )") :A ObjectSomeValuesFrom(:r owl:Thing))\nDataPropertyAssertion(:age :i "5"^^xsd:integer)\n)')
    (tmp_path / "y.txt").write_text("SubClassOf(<http://x#A> <B>)")
    rows = owl.read_ontology(spark, str(tmp_path / "a.owl"), {"http://y": str(tmp_path / "y.txt")})
    texts = {r.axiom for r in rows.collect()}
    assert "SubClassOf(<http://x#A> <B>)" in texts and any("age" in t and '"5"^^' in t for t in texts) and len(texts) == 4
    owl.write_ontology(rows, str(tmp_path / "out"))
    assert {r.axiom for r in owl.read_ontology(spark, str(tmp_path / "out")).collect()} == texts
    bad = owl.parse_documents(spark.createDataFrame([("f", "SubClassOf(<A>"), ("g", None)], "file string, text string"))
    assert [r.kind for r in bad.collect()] == ["Error"]


def test_profile(spark):
    df = spark.createDataFrame([("f", "SubClassOf", "SubClassOf(<A> ObjectUnionOf(<B> <C>))"), ("f", "SubClassOf", "SubClassOf(<A> ObjectOneOf(<B> <C>))"), ("f", "SubClassOf", "SubClassOf(<A> ObjectOneOf(<B>))"), ("f", "HasKey", "HasKey(<A>)")], "file string, kind string, axiom string")
    inside, outside = profile.split_profile(df)
    assert inside.count() == 1 and {r.reason for r in outside.collect()} == {"expression ObjectUnionOf", "several individuals", "axiom HasKey"}


def test_dictionary_goes_on(spark):
    first = dictionary.encode_signature(spark.createDataFrame([("b", 0), ("a", 2)], "iri string, kind int"))
    more = dictionary.encode_signature(spark.createDataFrame([("c", 0), ("a", 2)], "iri string, kind int"), first)
    assert {(r.iri, r.id) for r in more.collect()} == {("owl:Nothing", 0), ("owl:Thing", 1), ("a", 2), ("b", 3), ("c", 4)}


def test_packed_ids(spark):
    row = spark.createDataFrame([(12, 0), (123456, 3)], "id bigint, kind int").select(ids.pack_id(F.col("id"), F.col("kind")).alias("p")).collect()
    assert [r.p for r in row] == ["02120", "061234563"]
    back = spark.createDataFrame([("02120061234563",)], "p string").select(ids.unpack_ids(F.col("p")).alias("u")).first().u
    assert [(x.id, x.kind) for x in back] == [(12, 0), (123456, 3)]


def test_running_mean_and_logs(spark):
    lines = spark.createDataFrame([(1, "1 file: /a"), (2, "Logical axioms: 7"), (3, "real\t1m2.500s"), (4, "noise"), (5, "real\t0m1.500s")], "n int, value string")
    m = stats.log_metrics(lines).first()
    assert (m.axioms, m.files, m.classify_s) == (7, 1, 64.0)
    times = stats.classify_times(lines)
    assert stats.longest_prefix(stats.running_mean(times, "n", "seconds"), 40).first().n_within == 2


def test_settings_and_sinks(spark, tmp_path):
    s = settings.Settings.of(settings.parse_properties("# c\nmax.rounds = 5\nweights: sub:4,\\\n conj:1\ninstrument=true"))
    assert (s.max_rounds, s.weights["sub"], s.instrument) == (5, 4, True)
    pairs = spark.createDataFrame([("a", "b")], "x string, b string")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert [tuple(r) for r in sinks.read_pairs(spark, str(tmp_path / "p")).collect()] == [("a", "b")]
    store = sinks.KeyedStore(spark, str(tmp_path / "kv"))
    store.append(spark.createDataFrame([("k", "m", 1.0), ("k", "n", 2.0), ("z", "m", 3.0)], "key string, member string, score double"))
    assert store.range_by_score("k", 2, 9).count() == 1 and store.without("^k").count() == 1 and setops.top_score(store.table(), "key", "score").count() == 2
    sinks.snapshot(pairs, str(tmp_path / "snap"), "1")
    assert sinks.read_snapshots(spark, str(tmp_path / "snap")).count() == 1
    sinks.write_side_by_side(pairs, pairs.limit(0), str(tmp_path / "l"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a: b"]


def test_odd_axioms_are_rejected(spark):
    deep = "SubClassOf(<A> " + "ObjectSomeValuesFrom(<r> " * 900 + "<B>" + ")" * 900 + ")"
    odd = ["ClassAssertion(<A> ObjectOneOf(<i>))", "Declaration(NamedIndividual(ObjectOneOf(<i>)))", "SubClassOf(<A> DataHasValue(<p> ObjectOneOf(<i>)))", "SubClassOf(<A> ObjectHasValue(<p> ObjectOneOf(<i>)))", "SubClassOf(<A>", "SubClassOf()", deep]
    rows = spark.createDataFrame([(a,) for a in [*odd, "SubClassOf(<A> <B>)"]], "axiom string")
    tables, rejected = normalize.normalise(rows)
    assert [tuple(r) for r in tables.sub.collect()] == [("A", "B")] and {r.axiom for r in rejected.collect()} >= set(odd[:6])
    parsed = owl.parse_documents(spark.createDataFrame([("f", deep + " SubClassOf(<A> <B>)")], "file string, text string")).collect()
    assert [r.axiom for r in parsed] == [deep, "SubClassOf(<A> <B>)"]


def test_progress(spark):
    from axiomflow.plans.progress import progress

    assert progress(spark).columns == ["job", "stage", "tasks", "done", "failed", "fraction"]
