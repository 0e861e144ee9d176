"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased words and their beginnings of five letters. All terms of the examples make the vectors;
the more surely a term sets labelled toxic examples apart from clean ones, the more it weighs, without a limit below
which it is dropped. A block-max inverted index over the examples gives the exact nearest ones; their votes, weighted
by similarity, are calibrated on left-out examples. A text without any term of the examples gets the share of toxic
labels among examples without any.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.common import arrow_map, materialised, prepare, release, resident

LETTER = re.compile(r"[^\W\d_]")


class _Letters(dict):
    """For str.translate: letters stay, all else becomes a space. Holds each code point once."""

    def __missing__(self, code: int) -> int:
        self[code] = code if LETTER.match(chr(code)) else 32
        return self[code]


LETTERS = _Letters()
STEMS = (5,)
#: Bounds of the sample of labelled rows that the classifier learns from, by class.
MAX_TOXIC, MAX_CLEAN = 1000, 3000
NEIGHBOURS, BLOCK = 16, 64
#: Texts that are searched at once.
TOGETHER = 32


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class BlockMaxIndex:
    """Unit vectors in blocks of examples: postings of rare terms; for terms of more than an eighth of the examples,
    columns of weights and the greatest weight in each block. Examples of like vectors should come one after another,
    so that blocks differ in what they can reach."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        terms = np.fromiter(chain.from_iterable(vectors), np.int64, len(rows))
        self._build(len(vectors), n_terms, rows, terms, np.fromiter(chain.from_iterable(v.values() for v in vectors), float, len(rows)))

    @classmethod
    def of_arrays(cls, n: int, n_terms: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> BlockMaxIndex:
        """An index from parallel arrays of examples, terms and weights."""
        index = cls.__new__(cls)
        index._build(n, n_terms, rows, terms, weights)
        return index

    def _build(self, n: int, n_terms: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.n = n
        common = _common(n, np.bincount(terms, minlength=n_terms))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[terms] >= 0
        self.blocks = -(-n // BLOCK)
        self.columns = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        self.columns[rows[dense], self.column[terms[dense]]] = weights[dense]
        self.best = self.columns.reshape(self.blocks, BLOCK, len(common)).max(axis=1)
        rows, terms, weights = rows[~dense], terms[~dense], weights[~dense]
        order = np.lexsort((rows, terms))
        self.ids, self.weights = rows[order].astype(np.int32), weights[order].astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k examples of greatest dot product above 0, exactly; ties go to the lower place."""
        return self.search([(np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), float, len(query)))], k)[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` for several queries (terms, values): rare terms by their postings, then common terms block by block,
        only where a block's greatest weights could still lift an example among the k best."""
        if not self.n:
            return [[] for _ in queries]
        m, width = len(queries), self.blocks * BLOCK
        owner = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, values = np.concatenate([t for t, _ in queries]), np.concatenate([v for _, v in queries])
        at = self.column[terms]
        rare = at < 0
        lo, n = self.starts[terms[rare]], self.starts[terms[rare] + 1] - self.starts[terms[rare]]
        ends = np.cumsum(n)
        found = np.repeat(lo - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        place = np.repeat(owner[rare] * width, n) + self.ids[found]
        scores = np.bincount(place, self.weights[found] * np.repeat(values[rare], n), m * width).reshape(m, width)
        if len(values) > np.count_nonzero(rare):
            asked = np.zeros((m, self.columns.shape[1]), np.float32)
            asked[owner[~rare], at[~rare]] = values[~rare]
            bound = (asked @ self.best.T) + scores.reshape(m, self.blocks, BLOCK).max(axis=2) + 1e-5
            left = np.ones((m, self.blocks), np.bool_)
            ahead = np.argsort(-bound, axis=1)[:, : -(-2 * k // BLOCK)]
            todo = np.zeros((m, self.blocks), np.bool_)
            np.put_along_axis(todo, ahead, True, axis=1)
            exact = np.full((m, width), -1.0)
            while todo.any():
                for b in np.flatnonzero(todo.any(axis=0)).tolist():
                    who, own = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                    exact[who, own] = scores[who, own] + asked[who] @ self.columns[own].T
                left &= ~todo
                least = np.partition(exact, width - k, axis=1)[:, width - k] if k < width else np.full(m, -1.0)
                todo = left & (bound >= least[:, None])
            scores = exact
        scores = scores[:, : self.n]
        top = np.argpartition(-scores, k, axis=1)[:, : k + 1] if k < self.n else np.tile(np.arange(self.n), (m, 1))
        out = []
        for row, near in zip(scores, top, strict=True):
            least = np.sort(row[near])[-k] if k < self.n else 0.0
            near = np.flatnonzero(row >= max(least, 1e-12)) if k < self.n and np.count_nonzero(row[near] >= least) > k else near
            near = near[row[near] > 0]
            near = near[np.lexsort((near, -row[near]))][:k]
            out.append(list(zip(row[near].tolist(), near.tolist(), strict=True)))
        return out


def _common(n: int, df: np.ndarray) -> np.ndarray:
    return np.flatnonzero(df > max(n // 16, 8))


@dataclass
class ToxicityModel:
    """Terms, examples and calibration; of bounded size, so it may be broadcast. The index is made again where it is loaded."""

    terms: dict[str, int]
    #: Inverse document frequency of each term, times its weight for setting toxic examples apart.
    scale: np.ndarray
    #: Numbers of terms of the examples, and their terms and counts one example after another.
    sizes: np.ndarray
    held: np.ndarray
    counts: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    ids: list
    base: float
    empty: float
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        n, rows = len(self.sizes), np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        values = (1 + np.log(self.counts)) * self.scale[self.held]
        values /= np.sqrt(np.bincount(rows, values * values, len(self.sizes)))[rows]
        # in the index, examples stand by their two strongest common terms
        strong, key = np.zeros(len(self.scale), np.bool_), np.full((2, n), -1, np.int64)
        strong[_common(n, np.bincount(self.held, minlength=len(self.scale)))] = True
        by = np.lexsort((self.held, -values, rows))
        by = by[strong[self.held[by]]]
        for k in range(2):
            first = np.ones(len(by), np.bool_)
            np.not_equal(rows[by][1:], rows[by][:-1], out=first[1:])
            key[k, rows[by[first]]] = self.held[by[first]]
            by = by[~first]
        self.order = np.lexsort((key[1], key[0]))
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        self.index = BlockMaxIndex.of_arrays(n, len(self.terms), rank[rows], self.held, values)

    def packed(self) -> bytes:
        """Without the index, compressed."""
        return zlib.compress(pickle.dumps({k: v for k, v in self.__dict__.items() if k not in ("index", "order")}, protocol=5), 1)

    @classmethod
    def unpacked(cls, packed: bytes) -> ToxicityModel:
        return cls(**pickle.loads(zlib.decompress(packed)))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic among the neighbours, weighted by squared similarity and drawn to the base rate."""
        total, toxic = 0.5, 0.5 * self.base
        for s, i in near:
            w = s * s * self.weights[i]
            total += w
            toxic += w * self.labels[i]
        return toxic / total

    def calibrated(self, vote: float) -> float:
        x = min(max(vote, 1e-3), 1 - 1e-3)
        return float(1 / (1 + np.exp(-(self.slope * np.log(x / (1 - x)) + self.offset))))

    def near(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """(similarity, example) of the nearest examples of each text, given as terms and counts; ``without``: an
        example for each text that doesn't count."""
        queries = []
        for terms, counts in texts:
            values = (1 + np.log(counts)) * self.scale[terms]
            queries.append((terms, values / np.sqrt((values * values).sum())))
        found = self.index.search(queries, NEIGHBOURS + (without is not None)) if queries else []
        found = [[(s, int(self.order[i])) for s, i in near] for near in found]
        return found if without is None else [[x for x in near if x[1] != i][:NEIGHBOURS] for near, i in zip(found, without, strict=True)]

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        return [((self.calibrated(self.vote(near)) if near else self.empty), near) for near in self.near(texts)]


def _term_lists(df: DataFrame, text_col: str) -> DataFrame:
    fields = [("terms", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("counts", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]

    def make():
        release()

        def compute(texts):
            for text in texts:
                c = Counter(t for w in text.lower().translate(LETTERS).split() for t in terms_of(w))
                yield list(c), list(c.values())

        return compute

    return arrow_map(df, text_col, fields, make, keep=[c for c in df.columns if c != text_col])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, drawn a little to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g, h = w * (p - y), w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, [(g * x).sum() + (a - 1), g.sum() + b])
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Learns from at most ``max_toxic`` and ``max_clean`` labelled rows, those of least hash of their id.

    Null labels and ids are left out; of several labels of a document the greatest counts, of several rows of a
    document each is an example. Without labels of both classes the model has no terms and scores the base rate.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    totals = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = marked.filter("y = 1").orderBy(*order).limit(max_toxic).unionByName(marked.filter("y = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean rows of an id and a label
    examples = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    examples = materialised(examples.withColumn("row", F.monotonically_increasing_id()), "toxicity-examples")
    table = _term_lists(examples, "text").toArrow()
    ids = table.column("id").to_pylist()
    by_id = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i]))), np.int64)
    ids = [ids[i] for i in by_id]
    y = table.column("y").to_numpy().astype(float)[by_id]
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    all1, all0 = totals.get(1, 0), totals.get(0, 0)
    base = all1 / (all1 + all0) if all1 + all0 else 0.0
    w1, w0 = (all1 / n1 if n1 else 0.0), (all0 / n0 if n0 else 0.0)
    weights = np.where(y == 1, w1, w0)
    found = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
    sizes = found[by_id]
    bare = sizes == 0 if n1 and n0 else np.ones(n, bool)
    e1, e0 = weights[bare & (y == 1)].sum(), weights[bare & (y == 0)].sum()
    empty = float((e1 + base) / (e1 + e0 + 1))
    if not (n1 and n0):
        nothing = np.zeros(0, np.int32)
        return ToxicityModel({}, np.zeros(0), np.zeros(n, np.int64), nothing, nothing, y, weights, ids, base, empty)
    place = table.column("row").to_numpy()[by_id]
    counts = pc.list_flatten(table.column("counts")).to_numpy()
    coded = pc.list_flatten(table.column("terms"))
    del table
    coded = coded.dictionary_encode().unify_dictionaries()
    terms, names = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), {t: i for i, t in enumerate(coded.chunk(0).dictionary.to_pylist())}
    del coded
    rank = np.empty(n, np.int32)
    rank[by_id] = np.arange(n)
    order = np.argsort(np.repeat(rank, found), kind="stable")
    terms, counts = terms[order], counts[order]
    df = np.bincount(terms, minlength=len(names))
    a = np.bincount(terms[np.repeat(y == 1, sizes)], minlength=len(names))
    scale = (np.log((1 + n) / (1 + df)) + 1) * _apart(a, df, n1, n0)
    model = ToxicityModel(names, scale, sizes, terms, counts, y, weights, ids, base, empty)
    votes = np.clip(_left_out_votes(examples, model, place), 1e-3, 1 - 1e-3)
    model.slope, model.offset = _logistic(np.log(votes / (1 - votes)), y, weights / weights.mean())
    return model


def _apart(a: np.ndarray, m: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Weights, 1 or more, of terms that ``a`` of ``n1`` toxic examples and ``m`` of all hold: for terms that
    are more frequent in toxic ones they grow with the log-likelihood ratio (G) and the logarithm of the ratio of rates."""
    b, n = m - a, n1 + n0
    g = np.zeros(len(m))
    for seen, expected in ((a, m * (n1 / n)), (b, m * (n0 / n)), (n1 - a, (n - m) * (n1 / n)), (n0 - b, (n - m) * (n0 / n))):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.where(seen > 0, expected, 1)), 0.0)
    ratio = np.log((a + 0.5) / (n1 + 1) * (n0 + 1) / (b + 0.5))
    return 1 + (np.maximum(g, 0) * np.maximum(ratio, 0)) ** 2 / 4


def _left_out_votes(examples: DataFrame, model: ToxicityModel, place: np.ndarray) -> np.ndarray:
    """The vote on each example by the others. ``place``: the examples' values of ``row`` in the model's order."""
    shared = examples.sparkSession.sparkContext.broadcast(model.packed())
    order = {int(p): i for i, p in enumerate(place)}
    key = f"toxicity votes {uuid.uuid4().hex}"

    def run(batches):
        m, hits = resident(key, lambda: _loaded(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                near = m.near([hits(text) for text in part.column(1).to_pylist()], [order[row] for row in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.vote(x) for x in near], pa.float64())], names=["row", "vote"])

    texts = examples.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = {r.row: r.vote for r in texts.mapInArrow(run, "row bigint, vote double").collect()}
    shared.destroy()
    return np.array([found[int(p)] for p in place])


def _loaded(packed: bytes) -> tuple[ToxicityModel, Callable]:
    """The model, and the function that finds its terms in a text, with their counts."""
    m = ToxicityModel.unpacked(packed)
    whole = {t: i for t, i in m.terms.items() if not t.endswith("*")}
    stems = {t[:-1]: i for t, i in m.terms.items() if t.endswith("*")}

    m.terms = {}  # held twice otherwise

    def hits(text: str) -> tuple[np.ndarray, np.ndarray]:
        counted = Counter(text.lower().translate(LETTERS).split())
        times = np.fromiter(counted.values(), np.int64, len(counted))
        found = [np.array([whole.get(w, -1) for w in counted], np.int64)]
        found += [np.array([stems.get(w[:k], -1) if len(w) > k else -1 for w in counted], np.int64) for k in STEMS]
        terms, place = np.unique(np.concatenate(found), return_inverse=True)
        counts, known = np.bincount(place, np.tile(times, len(found)), len(terms)), terms >= 0
        return terms[known], counts[known]

    return m, hits


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5), ``neighbours``: (id, similarity, label) of the nearest
    examples, and ``evidence``: the same for texts predicted as toxic, else empty. Only the text is looked at; a null
    text counts as empty. All rows stay; columns of the added names are replaced."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model.packed())
    near_type = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    fields = [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32()), *((name, near_type, pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))) for name in ("neighbours", "evidence"))]
    key = f"toxicity {uuid.uuid4().hex}"

    def make():
        m, hits = resident(key, lambda: _loaded(shared.value))

        def compute(texts):
            scored = (x for at in range(0, len(texts), TOGETHER) for x in m.score([hits(text) for text in texts[at : at + TOGETHER]]))
            for s, near in scored:
                found = [{"id": str(m.ids[i]), "similarity": x, "label": int(m.labels[i])} for x, i in near]
                yield s, int(s >= 0.5), found, found if s >= 0.5 else []

        return compute

    return arrow_map(df, text_col, fields, make, keep=keep)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0
