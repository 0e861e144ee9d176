"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Document words stream through the automaton, which keeps the longest match that ends at each word. A match of
``window`` words, or of a whole shorter item, marks those words as hit. Marked spans are cut; a document of which too
large a share is marked is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.common import free_name, fresh_path, materialised, prepare, release, resident

#: A-Z to a-z; digits, a-z and bytes from 0x80 make words, all else parts them: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Bytes of item text in one automaton; more items make more automata, passed over all documents one after another.
BLOCK_BYTES = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All substrings of several word sequences; state 0 is the empty string."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: list[list[tuple[int, str]]] = [[]]
        self.vocabulary: set[bytes] = set()
        self.least = window
        prefixes: list[tuple[int, str]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                # each prefix is the longest string of its state, and later splits leave it there
                prefixes.append((last, item))
            self.vocabulary.update(words)
            if 0 < len(words) < window:
                self.short[last].append((len(words), item))
                self.least = min(self.least, len(words))
        #: The state of the last ``window`` words, by state; and the nearest state along the links that ends a short item.
        self.tail, self.near = [-1] * len(self.next), [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.tail[s] = s if self.length[up] < window else self.tail[up]
            self.near[s] = s if self.short[s] else self.near[up]
        #: Items by the states of their windows; shorter strings need none.
        self.items: dict[int, set[str]] = {}
        for s, item in prefixes:
            if self.tail[s] >= 0:
                self.items.setdefault(self.tail[s], set()).add(item)

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.short.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state for p's string and w, cut off q where q also holds longer strings."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans [first, last + 1) of hit words, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set[str] = set()
        known = bytes(map(self.vocabulary.__contains__, words))
        need = b"\x01" * self.least
        at = known.find(need)
        while at >= 0:
            end = known.find(b"\x00", at)
            end = len(words) if end < 0 else end
            state = length = 0
            for i in range(at, end):
                w = words[i]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.next[state]:
                    state = self.next[state][w]
                    length += 1
                size = 0
                if length >= self.window:
                    size = self.window
                    found |= self.items[self.tail[state]]
                q = self.near[state]
                while q > 0:
                    for n, item in self.short[q]:
                        if n <= length:
                            size = max(size, n)
                            found.add(item)
                    q = self.near[self.link[q]]
                if size:
                    first = i + 1 - size
                    while spans and spans[-1][1] >= first:  # the lengths differ, so an earlier span may begin later
                        first = min(first, spans.pop()[0])
                    spans.append([first, i + 1])
            at = known.find(need, end)
        return spans, found


def _automaton(key: str, items: list[tuple[str, bytes]], window: int) -> SuffixAutomaton:
    return resident(f"automaton {key}", lambda: SuffixAutomaton([(i, words_of(t)) for i, t in items], window))


def _blocks(items: DataFrame, item_id: str, item_text: str, limit: int) -> Iterable[list[tuple[str, bytes]]]:
    block, size = [], 0
    for i, text in items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit(""))).toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append((i, raw))
        size += len(raw)
    yield block


def _scanned(df: DataFrame, text_col: str, block: list, window: int) -> DataFrame:
    """Rows of df with hits by one block: without the text, with ``spans`` (word numbers, first and last + 1 in turn) and ``found`` (item ids)."""
    shared = df.sparkSession.sparkContext.broadcast(block)
    key = hashlib.sha256(repr((window, block)).encode()).hexdigest()
    passed = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in passed), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches):
        automaton = _automaton(key, shared.value, window)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                spans, found = [], []
                for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                    own, names = automaton.scan(words_of(text or b""))
                    spans.append([x for a in own for x in a])
                    found.append(sorted(names))
                columns = [*batch.columns[:-1], pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(columns, names=[*passed, "spans", "found"])
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`")).mapInArrow(run, schema)


ADDED = ["n_words", "n_hit", "hit_items", "hit_spans", "clean_text"]
ADDED_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.string()]
ADDED_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("clean_text", T.StringType())]


def _finished(text: bytes | None, s: list[int], found: list[str]) -> tuple:
    """The added columns of a text with the hit spans s."""
    if not s:
        return len(words_of(text or b"")), 0, [], [], None if text is None else text.decode()
    places = [m.span() for m in WORD.finditer(text.translate(WORD_BYTES))]
    cut = [[places[a][0], places[b - 1][1]] for a, b in zip(s[::2], s[1::2], strict=True)]
    edges = [0, *(x for c in cut for x in c), len(text)]
    clean = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(places), sum(s[1::2]) - sum(s[::2]), found, cut, clean.decode()


def scan_contamination(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``hit_items`` (distinct item ids as strings, sorted), ``hit_spans`` (byte offsets
    in UTF-8) and ``clean_text`` (the text without those spans).

    Words are lower-cased as WORD_BYTES says. An item of fewer words than ``window`` is one window; an item without
    words and a null item count for nothing; items with equal ids count once. A null text has no words and stays
    null; an empty table of items hits nothing, an empty df gives no rows. Texts of any length are passed whole. All rows
    of df stay, repeated ones too; columns of the added names are replaced, others may have any names.

    Items are read in blocks of ``block_bytes`` of text. One block is passed over df in one go. Several are passed
    in one job each, one after another: a worker holds one automaton and the executors one block at a time,
    however many there are, and only hits are written between the jobs.
    """
    spark = df.sparkSession
    prepare(spark)
    passed = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    text = free_name(df, "__dc_text")
    work = df.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`").cast("string").alias(text))
    blocks = iter(_blocks(items, item_id, item_text, block_bytes))
    first = next(blocks)
    second = next(blocks, None)
    out = T.StructType([*(work.schema[c] for c in passed), *ADDED_FIELDS])
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        key = hashlib.sha256(repr((window, first)).encode()).hexdigest()

        def run(batches):
            automaton = _automaton(key, shared.value, window)
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    rows = []
                    for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                        spans, names = automaton.scan(words_of(raw or b""))
                        rows.append(_finished(raw, [x for a in spans for x in a], sorted(names)))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(ADDED_TYPES))], names=[*passed, *ADDED])

        return work.mapInArrow(run, out)

    row, spans, found = (free_name(df, f"__dc_{c}") for c in ("row", "spans", "found"))
    work = materialised(work.withColumn(row, F.monotonically_increasing_id()), "decontamination-texts")
    texts, path = work.select(row, text), fresh_path(spark, "decontamination-hits")
    for block in chain([first, second], blocks):
        _scanned(texts, text, block, window).write.mode("append").parquet(path)
    hits = spark.read.schema(T.StructType([T.StructField(row, T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("found", T.ArrayType(T.StringType()))])).parquet(path)
    # at most one list of each block for a text
    lists = hits.groupBy(row).agg(F.collect_list("spans").alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias(found))
    met = work.join(lists, row, "left").select(*[F.col(f"`{c}`") for c in passed], spans, found, text)

    def finish(batches):
        release()
        for batch in batches:
            n = batch.num_columns
            rows = []
            for raw, s, f in zip(batch.column(n - 1).cast(pa.binary()).to_pylist(), batch.column(n - 3).to_pylist(), batch.column(n - 2).to_pylist(), strict=True):
                together = _merged([pair for one in s or () for pair in zip(one[::2], one[1::2], strict=True)])
                rows.append(_finished(raw, [x for a in together for x in a], f or []))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(ADDED_TYPES))], names=[*passed, *ADDED])

    return met.mapInArrow(finish, out)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, max_coverage: float = 0.5, **names) -> DataFrame:
    """df without hit spans: documents of which more than ``max_coverage`` of the words is hit go, from the others
    the spans are cut. Null and empty texts stay. Columns are those of df, whatever their names."""
    own = {c: free_name(df, f"__dc_{i}") for i, c in enumerate(df.columns) if c != text_col}
    held = df.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    scanned = scan_contamination(held, items, "text", window=window, keep=list(own.values()), **names)
    kept = scanned.filter(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    return kept.select(*[F.col("clean_text" if c == text_col else own[c]).alias(c) for c in df.columns])
