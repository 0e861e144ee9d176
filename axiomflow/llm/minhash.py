"""Near-duplicate documents: universal hash minima, banding, verification, connected components.

A document's set holds the 64-bit hashes of its distinct five-word shingles. 128 universal hash functions give its
signature; 32 bands of 4 minima give its buckets. At a Jaccard similarity of 0.75 a pair misses all bands with a
probability of 5e-6. Documents with equal sets are one node. First each member of a bucket is compared with the bucket's
centre, and members that also share the next one or two bands with a centre of those finer buckets: linear work that finds
most links. What is left in other components of its bucket is met through rare shingles (an exact prefix filter: of two
alike sets, the rarest shingles of the one and the other overlap), so no pair is lost and no bucket is compared each with each.
A comparison looks at the signatures first and confirms by the full sets, made anew from the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.common import arrow_map, materialised, prepare, release
from axiomflow.llm.components import connected_components

SHINGLE, HASHES, ROWS = 5, 128, 4
BANDS = HASHES // ROWS
#: Bands that the finer buckets take together.
FINER = (2, 3)
#: A-Z to a-z; space and 0x09-0x0D part words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_random = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
PLACES = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = int(_random.integers(0, 1 << 61)) * 8 + 3
#: Bytes that are hashed at once; a longer word gets a digest of its own.
PIECE = 1 << 16
#: Compared only if at least this share of the signatures agrees; at a similarity of 0.75 fewer do with a probability of 5e-14.
AGREEING = 0.44
#: Pairs of one centre that meet in one group of rows, with the centre's text once.
GROUP_PAIRS = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSES = _powers(STEP), _powers(pow(STEP, -1, 1 << 64))


def _piece_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of at most PIECE bytes: differences of one running polynomial, brought back to power 0."""
    at = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(at) + 2, np.bool_)
    np.not_equal(at, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(BYTE_CODES[at] * POWERS[: len(at)], out=total[1:])
    return _mixed((total[last] - total[first]) * INVERSES[first] + (last - first).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw, parts, at = text.translate(LOWER), [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw) and raw[end] != 32:
            end = raw.rfind(b" ", at, end)
            if end < 0:  # one word fills the piece
                end = raw.find(b" ", at)
                end = len(raw) if end < 0 else end
                digest = hashlib.blake2b(raw[at:end], digest_size=8).digest()
                parts.append(np.frombuffer(digest, "<u8").astype(np.uint64))
                at = end + 1
                continue
        parts.append(_piece_hashes(raw[at:end]))
        at = end + 1
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle of all its words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(len(h), SHINGLE)
    total = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * PLACES[i]
    total = np.sort(_mixed(total))
    new = np.ones(len(total), np.bool_)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a set that isn't empty."""
    least = None
    for start in range(0, len(hashes), 512):
        part = (FACTORS[:, None] * hashes[None, start : start + 512] + TERMS[:, None]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, node: 128-bit digest of the set, bands, sig: low byte of each minimum); empty sets have no bands."""
    fields = [("n_shingles", T.LongType(), pa.int64()), ("node", T.BinaryType(), pa.binary()), ("bands", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("sig", T.BinaryType(), pa.binary())]

    def make():
        release()

        def compute(texts):
            for text in texts:
                s = shingles(text)
                if not len(s):
                    yield 0, _digest(s), [], b""
                    continue
                least = signature(s)
                keys = _mixed((least.reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                yield len(s), _digest(s), keys.view(np.int64), (least & np.uint64(255)).astype(np.uint8).tobytes()

        return compute

    return arrow_map(_named(df, id_col, text_col), "text", fields, make, binary=True, keep=["id", "text_hash"])


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are alike. texts: (node, sig, text), one row for each node. The text of u comes once
    for each GROUP_PAIRS pairs, in front of them; a hot u is dealt to many groups."""
    pairs = materialised(pairs, "pairs")
    sizes = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / GROUP_PAIRS).alias("parts"))
    dealt = materialised(pairs.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), "v"), "pairs")
    body = texts.select(F.col("node"), "sig", F.col("text").cast("binary").alias("text"))
    own = dealt.select("u", "part").distinct().join(body.withColumnRenamed("node", "u"), "u").select("u", "part", F.lit(None).cast("binary").alias("v"), "sig", "text")
    others = dealt.join(body.withColumnRenamed("node", "v"), "v").select("u", "part", "v", "sig", "text")
    met = own.unionByName(others).repartition("u", "part").sortWithinPartitions("u", "part", "v")

    def run(batches):
        release()
        own = sig = None
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                keep = []
                for i, (v, given) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    if v is None:  # the text of u comes first
                        own, sig = shingles(batch.column(4)[i].as_py()), np.frombuffer(given, np.uint8)
                        keep.append(False)
                        continue
                    agree = np.count_nonzero(sig == np.frombuffer(given, np.uint8)) >= AGREEING * HASHES
                    keep.append(agree and _alike(own, shingles(batch.column(4)[i].as_py()), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "u binary, v binary")


def _stars(members: DataFrame, key: str) -> DataFrame:
    """(key, node, centre) of those buckets that hold more than one node; the centre is the least."""
    several = members.groupBy(key).agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre != last").select(key, "centre")
    return members.join(several, key).select(key, "node", "centre")


def _finer(nodes: DataFrame) -> DataFrame:
    """(finer, node): keys of neighbouring bands taken together."""
    keys = [F.xxhash64(F.lit(m), F.lit(i), *[F.col("bands")[(i + k) % BANDS] for k in range(m)]) for m in FINER for i in range(BANDS)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("finer"))


def _prefixes(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, label, n, place): of each node's n shingles, from the rarest on, those among which one must be shared
    with each set that is alike. Rarity is counted over all ``nodes``; shingles of one node only take places, but no rows."""
    given = nodes.join(texts.select("node", F.col("text").cast("binary").alias("text")), "node").select("node", "label", "text")

    def run(batches):
        release()
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                sets = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
                arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "label", "n", "shingles"])

    sets = materialised(given.mapInArrow(run, "node binary, label binary, n bigint, shingles array<bigint>"), "open-sets")
    each = sets.select("node", "label", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = each.join(shared, "shingle")
    by_node = Window.partitionBy("node")
    placed = held.withColumn("place", F.col("n") - F.count(F.lit(1)).over(by_node) + F.row_number().over(by_node.orderBy("df", "shingle")) - 1)
    first = placed.filter(F.col("place") <= F.col("n") - _over(F.col("n") * percent, 100))
    return materialised(first.select("shingle", "node", "label", "n", "place"), "prefixes")


def _over(a: Column, b: int) -> Column:
    """a / b, rounded up, in whole numbers."""
    return F.floor((a + (b - 1)) / b).cast("bigint")


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different labels that share a shingle early enough in both for their sets to be alike."""
    a = prefixes.select("shingle", F.col("node").alias("u"), F.col("label").alias("u_label"), F.col("n").alias("u_n"), F.col("place").alias("u_place"))
    b = prefixes.select("shingle", F.col("node").alias("v"), F.col("label").alias("v_label"), F.col("n").alias("v_n"), F.col("place").alias("v_place"))
    least = _over((F.col("u_n") + F.col("v_n")) * percent, 100 + percent)  # shingles that alike sets of these sizes share
    fits = (a["shingle"] == b["shingle"]) & (F.col("u") < F.col("v")) & (F.col("u_label") != F.col("v_label"))
    return a.join(b, fits & (F.col("u_place") <= F.col("u_n") - least) & (F.col("v_place") <= F.col("v_n") - least)).select("u", "v").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row of df: id_col, ``n_shingles``, ``component_id`` (least id reachable), ``kept``.

    Texts are lower-cased (A-Z) and split at space and 0x09-0x0D. Two documents are linked if 100 * intersection
    of their shingle sets >= percent * union. Null, empty and blank texts have no shingles and are linked with
    nothing: their component is their own id. Texts of any length are taken whole; a word of any length is one word. Rows with
    equal ids count as documents of their own; if their ids tie as the least, all of them are ``kept``. A null id counts as
    no id when the least one is sought. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = materialised(signatures(df, id_col, text_col), "signatures")
    full = docs.filter("n_shingles > 0")
    members = materialised(_stars(full.select("node", F.explode("bands").alias("bucket")), "bucket").distinct(), "buckets")
    chosen = full.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("m"), F.max("sig").alias("sig"), F.first("bands").alias("bands"))
    chosen = chosen.select("node", "sig", "bands", F.col("m.id").alias("rep"), F.col("m.text_hash").alias("rep_hash"))
    # rows of one id and one text have one set, so any of them serves
    source = _named(df, id_col, text_col)
    found = source.join(chosen, (source["text_hash"] == chosen["rep_hash"]) & source["id"].eqNullSafe(chosen["rep"]))
    texts = materialised(found.select("node", "sig", "bands", "text").dropDuplicates(["node"]), "candidate-texts")

    near = members.select("node", "centre").unionByName(_stars(_finer(texts), "finer").select("node", "centre")).filter("node != centre")
    links = materialised(_verified(near.select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), texts, percent), "links")
    labels = connected_components(links)
    # a bucket whose members are all in one component is done
    marked = materialised(members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label")), "marked")
    open_ = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    rest = materialised(marked.join(open_, "bucket", "left_semi").select("node", "label").distinct(), "rest")
    if not rest.isEmpty():
        more = materialised(_verified(_met(_prefixes(rest, texts, percent), percent), texts, percent), "links")
        if not more.isEmpty():
            labels = connected_components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    named = docs.join(labels, "node", "left").select("id", "n_shingles", F.coalesce("root", "node").alias("label"))
    # written before the join, so that the rows of one large component can be split over tasks
    least = materialised(named.filter("n_shingles > 0").groupBy("label").agg(F.min("id").alias("component_id")), "least-ids")
    linked = named.filter("n_shingles > 0").join(least, "label").select("id", "n_shingles", "component_id")
    alone = named.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """df with the rows whose id is the least of its component; columns are those of df."""
    kept = near_duplicates(df, id_col, text_col, percent).filter("kept").select(F.col(id_col).alias("__nd_id")).distinct()
    return df.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("__nd_id")), "left_semi")
