"""Exact token counts of every prefix of a text, by dynamic programming.

For each prefix of a word the last token of its exact encoding is the one match ending there that is compatible
with the last token of the prefix before that match; its count is one more. A text's table holds the count of each of its
prefixes, so truncation and budget questions need no second encoding.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from itertools import accumulate, compress
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axiomflow.llm.bpe import BYTE_WORDS, CACHE_BYTES, BpeModel
from axiomflow.llm.common import ByteCache, arrow_map, prepare, resident

BLANK = regex.compile(r"\s*")
#: White space goes with what follows it, so that no word lies in two pieces.
PIECES = regex.compile(r"\s*\S+|\s+")
MARKS = frozenset(".,;:!?")
#: The step to one more token.
ONE = array("h", [1]).tobytes()
CONTRACTIONS = {"'re", "'ve", "'ll"}


def prefix_counts(model: BpeModel, word: str) -> list[int]:
    """Token counts of word[:1], word[:2], ... for a word given as byte symbols."""
    n = len(word) + 1
    last, count, length, known = [0] * n, [0] * n, model.length, model.memo.get
    done = 0
    for at, token in model.automaton.iter(word):
        if at < done:  # this prefix has its last token already
            continue
        start = at + 1 - length[token]
        if start:
            pair = last[start] << 20 | token
            fits = known(pair)
            if fits is None:
                fits = model.compatible(last[start], token)
            if not fits:
                continue
        done = at + 1
        last[done], count[done] = token, count[start] + 1
    return count[1:]


class Counter:
    def __init__(self, vocabulary: str):
        self.model = BpeModel(vocabulary)
        if self.model.suffix:
            raise ValueError("prefix counts need a byte-level vocabulary")
        self.words = ByteCache(CACHE_BYTES, lambda w: prefix_counts(self.model, w)[-1])
        self.totals = ByteCache(CACHE_BYTES, lambda c: sum(map(self.words.__getitem__, self.model.words(c))))
        self.cache = ByteCache(CACHE_BYTES, self._part)

    def _part(self, text: str) -> bytes:
        """Steps of a text that stands alone; most are one word, with at most one mark after it."""
        if text.isascii():
            body = text[1:] if text[:1] == " " else text
            if body.isalpha():
                return _steps(prefix_counts(self.model, text))
            if body[-1:] in MARKS and body[:-1].isalpha():
                return self.cache[text[:-1]] + ONE
        return _steps(self._counts(text))

    def _ends(self, word: str) -> list[int]:
        """Token counts at the ends of the word's code points."""
        if word.isascii():
            return prefix_counts(self.model, word)
        raw = word.encode()
        counts = prefix_counts(self.model, raw.decode("latin-1"))
        return list(compress(counts, [b & 0xC0 != 0x80 for b in raw[1:]] + [True]))

    def _counts(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2], ... as texts of their own, for a text without special tokens.

        A cut leaves the words before it as they are, but for two cases: white space before the cut is one word up to
        its last character, and a contraction of three characters cut after the second is a mark and a letter.
        """
        if BYTE_WORDS.match(text).end() == len(text) and text not in CONTRACTIONS:
            return self._ends(text)
        out, base, run, before = [], 0, -1, 0
        for m in BYTE_WORDS.finditer(text):
            start, word = m.start(), m[0]
            counts = self._ends(word)
            blank = BLANK.match(word).end()
            if blank and run < 0:
                run, before = start, base
            if blank and run < start:
                out += [before + c for c in self._ends(text[run : start + blank])[start - run :]]
            else:
                out += [base + c for c in counts[:blank]]
            if blank < len(word):
                run = -1
                own = counts if word not in CONTRACTIONS else [counts[0], counts[0] + 1, counts[2]]
                out += [base + c for c in own[blank:]]
            base += counts[-1]
        # a text that ends in white space ends in one word, whose count the last entry has
        return out

    def _special(self, part: str, special: str) -> bytes:
        """Steps through a special token after ``part``: cut in two it is plain text, which may join the words before it."""
        piece = PIECES.findall(part)[-1] if part else ""
        counts = self._counts(piece + special[:-1])
        here = counts[len(piece) - 1] if piece else 0
        return _steps([*counts[len(piece) :], here + 1], here)

    def _parts(self, part: str) -> list[str]:
        """Parts that are counted independently of each other."""
        chunks = self.model.chunks(part) if part else []
        if chunks is None:
            return PIECES.findall(part)
        return [*chunks[:1], *[" " + c for c in chunks[1:]]]

    def table(self, text: str) -> tuple[np.ndarray]:
        """The stored table: the token count of text[:n] for each n from 0 on. Its memory is 4 bytes a code point."""
        steps = [bytes(2)]
        for part, special in self.model.sections(text):
            steps += map(self.cache.__getitem__, self._parts(part))
            if special >= 0:
                steps.append(self._special(part, self.model.texts[special]))
        return (np.cumsum(np.frombuffer(b"".join(steps), np.int16), dtype=np.int32),)

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the code points of its longest prefix of at most ``budget`` tokens.

        The sums at the ends of the parts say in which part the budget ends: each place of a later part has a token more than
        the parts before it, so only that part's places are asked for. A special token cut in two may join what stands before
        it, so texts that hold one use their whole table.
        """
        sections = self.model.sections(text)
        if len(sections) > 1 or sections[0][1] >= 0:
            store = PrefixStore(self.model, text, *self.table(text))
            return store.tokens(len(text)), store.longest_within(budget)
        parts = self._parts(text)
        ends = list(accumulate(map(self.totals.__getitem__, parts)))
        if not ends or ends[-1] <= budget:
            return ends[-1] if ends else 0, len(text)
        k = bisect_left(ends, budget)
        left = budget - (ends[k - 1] if k else 0)
        fits = [n for n, c in enumerate(self._counts(parts[k]), 1) if c <= left]
        return ends[-1], sum(map(len, parts[:k])) + (fits[-1] if fits else 0)

    def count(self, text: str) -> int:
        """The last entry of the table of prefix counts."""
        return self.fit(text, 0)[0]


def _steps(counts: list[int], before: int = 0) -> bytes:
    """Differences of consecutive counts, as 16-bit integers. A further character adds as many tokens as it has bytes at
    most, and takes away no more than the longest token has; what doesn't fit raises an error."""
    return array("h", map(sub, counts, [before, *counts])).tobytes()


class PrefixStore:
    """Answers from a stored table, without a look at the text: tokens of text[:n], and the longest prefix within a budget."""

    def __init__(self, model: BpeModel, text: str, counts: np.ndarray):
        self.counts = counts

    def tokens(self, n: int) -> int:
        """Tokens of the first n code points."""
        return int(self.counts[max(0, min(n, len(self.counts) - 1))])

    def longest_within(self, budget: int) -> int:
        """The greatest n with tokens(n) <= budget, 0 if there is none. Counts aren't monotone: a longer prefix may end in one
        token where a shorter one takes several, so all places are looked at."""
        fits = np.flatnonzero(self.counts <= budget)
        return int(fits[-1]) if len(fits) else 0


def tokens_of_prefix(prefix_tokens: Column, n: Column | int) -> Column:
    """Tokens of the first n code points, from a stored table; n is taken as at least 0 and at most the text's length."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.element_at(prefix_tokens, (F.greatest(F.lit(0), F.least(n, F.size(prefix_tokens) - 1)) + 1).cast("int"))


def longest_prefix(prefix_tokens: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from a stored table; 0 if there is none."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("bigint")


def counter(vocabulary: str) -> Counter:
    return resident(f"counts {vocabulary}", lambda: Counter(vocabulary))


def count_tokens(df: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512, table: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens``, ``fits_chars`` (code points of the longest prefix of at most ``limit`` tokens) and
    ``over_limit`` (n_tokens > limit), all from prefix counts; with ``table`` also the table of all of them,
    ``prefix_tokens``, for :func:`tokens_of_prefix` and :func:`longest_prefix`.

    Counts are those of the vocabulary's library without added tokens; special strings in a text count as their
    token. A null text counts as empty: 0 bytes, 0 tokens, a table of one 0. Texts are taken whole; a table takes 4 bytes
    a code point. All rows stay, repeated ones too; columns of the added names are replaced.
    """
    prepare(df.sparkSession)
    fields = [("n_bytes", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64()), ("fits_chars", T.LongType(), pa.int64())]
    if table:
        fields.append(("prefix_tokens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))

    def make():
        c = counter(vocabulary)

        def compute(texts):
            for raw in texts:
                text = raw.decode()
                row = len(raw), *c.fit(text, limit)
                yield (*row, *c.table(text)) if table else row

        return compute

    base = df if keep is None else df.select(*{*keep, text_col})
    return arrow_map(base, text_col, fields, make, binary=True, keep=keep).withColumn("over_limit", F.col("n_tokens") > limit)
