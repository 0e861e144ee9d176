"""OWL functional syntax: reading documents as axiom rows, expression trees, and writing.

A document may be of any size in number, each one is parsed by one task. An axiom row is (file, kind, axiom), the
axiom in functional syntax with full IRIs, so later steps are row by row and need no recursion in the schema.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s+|#[^\n]*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[^\s()]+))?|<[^>]*>|[()=]|[^\s()<>="]+')
PREFIXES = {
    "owl:": "http://www.w3.org/2002/07/owl#",
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd:": "http://www.w3.org/2001/XMLSchema#",
}
OWL_THING, OWL_NOTHING = PREFIXES["owl:"] + "Thing", PREFIXES["owl:"] + "Nothing"


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if not m[0][0].isspace() and m[0][0] != "#":
            out.append(m[0])
    return out


def trees(text: str) -> list:
    """Nested lists of a document: [name, argument, ...], arguments being lists or strings."""
    root: list = []
    stack, named = [root], ""
    for t in tokens(text):
        if t == "(":
            inner = [named]
            stack[-1].append(inner)
            stack.append(inner)
            named = ""
            continue
        if named:
            stack[-1].append(named)
            named = ""
        if t == ")":
            if len(stack) == 1:
                raise ValueError("a bracket too many is closed")
            stack.pop()
        elif t[0] in '<"=':
            stack[-1].append(t)
        else:
            named = t
    if named:
        stack[-1].append(named)
    if len(stack) > 1:
        raise ValueError("a bracket stays open")
    return root


def expanded(tree, prefixes: dict[str, str]):
    """The tree with full IRIs without angle brackets; literals stay as written. Any depth: no recursion."""

    def leaf(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        if t.startswith('"'):
            return t
        head, colon, tail = t.partition(":")
        return prefixes[head + ":"] + tail if colon and head + ":" in prefixes else t

    if not isinstance(tree, list):
        return leaf(tree)
    out: list = [tree[0]]
    todo = [(tree, out)]
    while todo:
        given, made = todo.pop()
        for t in given[1:]:
            if isinstance(t, list):
                made.append([t[0]])
                todo.append((t, made[-1]))
            else:
                made.append(leaf(t))
    return out


def written(tree) -> str:
    """Functional syntax of an expanded tree. Any depth: no recursion."""
    out: list[str] = []
    todo: list = [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            out.append(t[0])
        elif isinstance(t, list):
            out.append(f"{t[0]}(")
            todo.append((")",))
            for i in range(len(t) - 1, 0, -1):
                todo.append(t[i])
                if i > 1:
                    todo.append((" ",))
        else:
            out.append(t if t.startswith('"') or t.isdigit() else f"<{t}>")
    return "".join(out)


def parse_axiom(text: str):
    """The expanded tree of one axiom in functional syntax."""
    return expanded(trees(text)[0], PREFIXES)


def parse_document(text: str) -> tuple[list, list[str]]:
    """Expanded axiom trees, without annotations, and the IRIs of imports."""
    prefixes, axioms, imports = dict(PREFIXES), [], []
    found = trees(text)
    i = 0
    while i < len(found):
        t = found[i]
        if isinstance(t, list) and t[0] == "Prefix":
            parts = [x for x in t[1:] if x != "="]
            prefixes[parts[0].rstrip("=")] = parts[-1][1:-1]
        elif isinstance(t, list) and t[0] == "Ontology":
            for x in t[1:]:
                if isinstance(x, list) and x[0] == "Import":
                    imports.append(expanded(x[1], prefixes))
                elif isinstance(x, list) and x[0] != "Annotation":
                    axioms.append(_plain(expanded(x, prefixes)))
        elif isinstance(t, list):
            axioms.append(_plain(expanded(t, prefixes)))
        i += 1
    return axioms, imports


def _plain(tree: list) -> list:
    return [tree[0], *(t for t in tree[1:] if not (isinstance(t, list) and t[0] == "Annotation"))]


SCHEMA = "file string, kind string, axiom string"


def parse_documents(docs: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, kind, axiom) of documents; imports come as rows of kind Import, faults as rows of kind Error."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    axioms, imports = parse_document(text or "")
                except (ValueError, IndexError) as e:
                    rows.append((file, "Error", str(e)))
                    continue
                rows += [(file, a[0], written(a)) for a in axioms] + [(file, "Import", i) for i in imports]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["file", "kind", "axiom"])

    return docs.select(F.col(file_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def read_ontology(spark: SparkSession, path: str, imports: dict[str, str] | None = None) -> DataFrame:
    """Axiom rows of a document or of all documents in a folder. ``imports`` maps imported IRIs to paths; the closure
    of imports is read, an import without a path stays an Import row."""
    imports = imports or {}
    out = None
    todo, done = [path], set()
    while todo:
        here = todo.pop()
        if here in done:
            continue
        done.add(here)
        docs = spark.read.text(here, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        rows = parse_documents(docs)
        out = rows if out is None else out.unionByName(rows)
        if imports:  # as many rows as the map has entries at most
            named = rows.filter(F.col("kind") == "Import").filter(F.col("axiom").isin(*imports)).select("axiom").distinct().collect()
            todo += [imports[r.axiom] for r in named]
    return out.filter(~((F.col("kind") == "Import") & F.col("axiom").isin(*imports))) if imports else out


def document_lines(axioms: DataFrame) -> DataFrame:
    """One line of functional syntax for each axiom row: (value)."""
    return axioms.filter(~F.col("kind").isin("Import", "Error")).select(F.col("axiom").alias("value"))


def write_ontology(axioms: DataFrame, path: str) -> None:
    """A folder of text files that ``read_ontology`` takes: bare axioms, one a line."""
    document_lines(axioms).write.mode("overwrite").text(path)


def normal_form_lines(kind: str, df: DataFrame) -> DataFrame:
    """Functional syntax of a normal-form table of string IRIs: (value)."""
    e = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    some = lambda r, c: F.concat(F.lit("ObjectSomeValuesFrom("), e(r), F.lit(" "), e(c), F.lit(")"))
    call = lambda name, *args: F.concat(F.lit(f"{name}("), F.concat_ws(" ", *args), F.lit(")"))
    if kind == "sub":
        out = call("SubClassOf", e("a"), e("b"))
    elif kind == "ex":
        out = call("SubClassOf", e("a"), some("r", "b"))
    elif kind == "exl":
        out = call("SubClassOf", some("r", "a"), e("b"))
    elif kind == "role":
        out = call("SubObjectPropertyOf", e("r"), e("s"))
    elif kind == "chain":
        out = call("SubObjectPropertyOf", call("ObjectPropertyChain", e("r"), e("s")), e("t"))
    elif kind == "dom":
        out = call("ObjectPropertyDomain", e("r"), e("d"))
    elif kind == "rng":
        out = call("ObjectPropertyRange", e("r"), e("d"))
    elif kind == "conj":
        df = df.groupBy("conj_id", "b").agg(F.sort_array(F.collect_list("operand")).alias("ops"))
        ops = F.array_join(F.transform("ops", lambda o: F.concat(F.lit("<"), o, F.lit(">"))), " ")
        out = call("SubClassOf", call("ObjectIntersectionOf", ops), e("b"))
    else:
        raise ValueError(kind)
    return df.select(out.alias("value"))
