"""Dictionary encoding of entities: dense ids that go on from an existing dictionary, and axiom tables of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiomflow.operators.normalize import FRESH_CLASS, FRESH_TEXT, eliminate_ranges
from axiomflow.schema import BOTTOM, BOTTOM_ID, CLASS, COLUMNS, ENTITY, NUMBER_BITS, TOP, TOP_ID, Axioms, digits, frame
from axiomflow.storage import BROADCAST_BYTES, BROADCAST_ROWS, is_local, materialised, small, stored


def numbered(df: DataFrame, column: str, start: int, name: str = "id") -> DataFrame:
    """df with dense numbers from ``start`` in the order of ``column``, without a sort in one task: rows are sorted by
    range, numbered within their range, and moved by the sizes of the ranges before (one row for each range)."""
    parts = materialised(df.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = [(r["__part"], r["count"]) for r in parts.groupBy("__part").count().orderBy("__part").collect()]
    offsets, total = [], start
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    places = parts.sparkSession.createDataFrame(offsets, "__part int, __offset bigint")
    within = parts.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(column)))
    return within.join(F.broadcast(places), "__part").withColumn(name, F.col("__offset") + F.col("__n") - 1).drop("__part", "__n", "__offset")


def encode_signature(signature: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """dict (id, iri, kind) of (iri, kind): 0 is bottom, 1 is top, others follow; known entries keep their ids."""
    spark = signature.sparkSession
    if known is None:
        known = spark.createDataFrame([(BOTTOM_ID, BOTTOM, CLASS), (TOP_ID, TOP, CLASS)], "id bigint, iri string, kind tinyint")
    start = known.agg(F.max("id")).first()[0] + 1
    new = signature.select("iri", "kind").filter("iri IS NOT NULL").dropDuplicates(["iri"]).join(known.select("iri"), "iri", "left_anti")
    return known.select("id", "iri", "kind").unionByName(numbered(new, "iri", start).select("id", "iri", F.col("kind").cast("tinyint").alias("kind")))


def lookup(df: DataFrame, dictionary: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """df with the named columns as ids (or, with ``back``, as IRIs). Rows with an unknown entity are an error of the
    caller's: they drop out."""
    key, value = ("id", "iri") if back else ("iri", "id")
    for c in columns:
        entry = dictionary.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
        df = df.join(entry, F.col(c) == F.col("__k")).select(*[F.col("__v").alias(n) if n == c else F.col(n) for n in df.columns])
    return df


def encode(ax: Axioms, dictionary: DataFrame) -> Axioms:
    entries = small(dictionary)
    tables = {k: lookup(getattr(ax, k), entries, [c for c in columns if c in ENTITY]) for k, columns in COLUMNS.items()}
    return Axioms(**tables, individuals=lookup(ax.individuals, entries, ["x"]))


def init_s(dictionary: DataFrame) -> DataFrame:
    """Seeds: x below x and x below top for classes, individuals and datatypes."""
    named = dictionary.filter("kind != 2").select(F.col("iri").alias("x"))
    return named.select("x", F.col("x").alias("b")).unionByName(named.select("x", F.lit(TOP).alias("b"))).distinct()


@dataclass
class Inline:
    """Ids that hold a number: the code of an IRI's stem above NUMBER_BITS, one more than the value of its last digits below
    (0: none). Only stems need a table, so IRIs become ids, and ids IRIs, row by row. Texts that stand for fresh
    classes become their names again."""

    axioms: Axioms
    stems: DataFrame
    nothing: int
    top: int

    def decode(self, df: DataFrame, columns: list[str]) -> DataFrame:
        for c in columns:
            number = F.col(c).bitwiseAND((1 << NUMBER_BITS) - 1)
            text = F.concat(F.col("__stem"), F.when(number == 0, F.lit("")).otherwise((number - 1).cast("string")))
            fresh = F.concat(F.lit(FRESH_CLASS), F.sha2(F.substring(text, F.lit(len(FRESH_TEXT) + 1), F.length(text)), 256).substr(1, 32))
            name = F.when(F.col("__stem").startswith(FRESH_TEXT), fresh).otherwise(text)
            joined = df.join(F.broadcast(self.stems), F.shiftright(c, NUMBER_BITS) == F.col("__code"), "left")
            df = joined.select(*[name.alias(n) if n == c else F.col(n) for n in df.columns])
        return df

    def ids(self, iris: list[str]) -> list[int]:
        return [_coded(_split(frame(self.stems.sparkSession, [(x,)], "x string"), ["x"]), ["x"], self.stems).first().x for x in iris]


@dataclass
class Looked:
    """Dense ids by a dictionary of all entities."""

    axioms: Axioms
    dictionary: DataFrame
    nothing: int = BOTTOM_ID
    top: int = TOP_ID

    def decode(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return lookup(df, self.dictionary, columns, back=True)

    def ids(self, iris: list[str]) -> list[int]:
        return [self.dictionary.filter(F.col("iri") == x).first().id for x in iris]


def _split(df: DataFrame, named: list[str]) -> DataFrame:
    """Each named column as its stem, and in a column ``__n`` what follows the stem as a number, plus one; 0 if nothing does."""
    cut = df.select(*df.columns, *[digits(F.col(c)).alias(f"{c}__k") for c in named])  # once: both columns need it
    out = []
    for c in named:
        k = F.col(f"{c}__k")
        out.append(F.substring(c, F.lit(1), F.length(c) - k).alias(c))
        out.append(F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.right(F.col(c), k).try_cast("bigint") + 1).alias(f"{c}__n"))
    return cut.select(*[c for c in df.columns if c not in named], *out)


def _coded(df: DataFrame, named: list[str], stems: DataFrame) -> DataFrame:
    for c in named:
        joined = df.join(F.broadcast(stems), F.col(c) == F.col("__stem"), "left")
        df = joined.select(*[(F.shiftleft("__code", NUMBER_BITS) + F.col(f"{c}__n")).alias(c) if n == c else F.col(n) for n in df.columns if n != f"{c}__n"])
    return df


def inline(ax: Axioms) -> Inline | None:
    """Stored axioms with ids in place of IRIs, without a table of all entities. None if there are too many stems to be
    broadcast: then IRIs don't end in numbers, and a dictionary has to serve."""
    spark, split, found = ax.sub.sparkSession, {}, {BOTTOM, TOP}
    for kind, df in ax.tables().items():
        named = [c for c in df.columns if c in ENTITY or c == "x"]
        cut, local = _split(df, named), is_local(df)
        if not local:
            cut = stored(cut, f"split-{kind}", "zstd")
        split[kind] = (cut, named, df.columns, local)
        some = cut.select(*named).distinct().select(F.explode(F.array(*named)).alias("stem")).distinct().take(BROADCAST_ROWS + 1)
        found.update(r.stem for r in some if r.stem is not None)
        if len(found) > BROADCAST_ROWS or sum(len(x.encode()) + 32 for x in found) > BROADCAST_BYTES:
            return None
    codes = {x: i for i, x in enumerate(sorted(found))}
    stems = frame(spark, list(codes.items()), "__stem string, __code bigint")
    tables = {}
    for kind, (df, named, columns, local) in split.items():
        coded = _coded(df, named, stems).select(*columns)
        tables[kind] = frame(spark, [tuple(r) for r in coded.collect()], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)) if local else coded
    return Inline(Axioms(**tables), stems, codes[BOTTOM] << NUMBER_BITS, codes[TOP] << NUMBER_BITS)


def identified(ax: Axioms) -> Inline | Looked:
    """Axioms without ranges, on ids: inline ones where stems are few, else those of a dictionary."""
    found = inline(eliminate_ranges(ax, texts=True))
    if found:
        return found
    plain = eliminate_ranges(ax)
    d = encode_signature(plain.signature())
    return Looked(encode(plain, d), d)
