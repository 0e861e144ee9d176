"""Exact byte-pair encoding and decoding.

Encoding is the backtracking search over longest token matches: an Aho-Corasick automaton over the vocabulary
finds all token matches of a word, the longest one is tried first, and a token may follow another only if the
pair-compatibility table says that merging by rank would leave the border between the two. Dead ends are
remembered by position, so a word takes time linear in its length. Decoding slices one block of token texts by an
offset table. Vocabulary files are read from a path and never trained here.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from axiomflow.llm.common import ByteCache, arrow_map, prepare, resident

#: Stands for the end of a word in symbol strings, whose other characters are bytes 0-255.
END = "Ā"
BYTE_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ENDED_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space of Unicode; str.split() alone also breaks at U+001C to U+001F.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: A space that is not alone between two texts; such texts are split as a whole.
ODD_SPACE = re.compile(r"\A\s| \s|\s |\s\Z")
#: Bytes of each cache of words and of chunks in a worker process.
CACHE_BYTES = 32 << 20
MEMO_PAIRS = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def resolve(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up in the installed public vocabulary package."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class BpeModel:
    """A BPE vocabulary: symbol strings, merge tree, pair compatibility, automaton, token texts."""

    def __init__(self, vocabulary: str):
        import ahocorasick

        with open(resolve(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"unsupported model in {vocabulary}")
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        table = {ord(k): chr(v) for k, v in letters.items()}

        def symbols(token: str) -> str:
            ended = self.suffix and token.endswith(self.suffix)
            return (token[: -len(self.suffix)] if ended else token).translate(table) + (END if ended else "")

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.texts = [""] * size
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.texts[i] = token
        self.ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.ids[symbols(token)] = i
        self.length = [0] * size
        for s, i in self.ids.items():
            self.length[i] = len(s)
        self.rank, self.left, self.right = [-1] * size, list(range(size)), list(range(size))
        self.pair_rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            l, r = self.ids[symbols(a)], self.ids[symbols(b)]
            self.pair_rank.setdefault(l << 20 | r, rank)
            merged = self.ids[symbols(a) + symbols(b)]
            if self.rank[merged] < 0:
                self.rank[merged], self.left[merged], self.right[merged] = rank, l, r
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        #: The longest shorter token with which a token begins.
        self.shorter = [-1] * size
        for s, i in self.ids.items():
            for n in range(len(s) - 1, 0, -1):
                if (j := self.ids.get(s[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.memo: dict[int, bool] = {}
        self.special_re = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        # decoding: byte-level vocabularies give back bytes, the others the token texts with spaces between
        joined = b"" if not self.suffix and (spec.get("decoder") or {}).get("type") == "ByteLevel" else b" "
        if not joined:
            pieces = [bytes(letters[c] for c in t) if t not in self.special else t.encode() for t in self.texts]
        else:
            pieces = [t.encode() + joined for t in self.texts]
        self.joined = joined
        self.block = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b by rank gives a and b again."""
        key = a << 20 | b
        known = self.memo.get(key)
        if known is None:
            known = self._border_holds(a, b)
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            self.memo[key] = known
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Takes back the later of the two last merges beside the border until single symbols meet.

        A merge over the border happens if the two parts that meet have a rank below that of the merge taken
        back last; at the same rank the leftmost pair goes first, which is the one over the border if the
        merge taken back lies to its right.
        """
        rank, before = self.rank, 1 << 60
        while True:
            over = self.pair_rank.get(a << 20 | b)
            if over is not None and over < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word given as symbols: longest matches first, with backtracking where a pair is not compatible."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        known = self.memo.get
        greedy = [token for _, token in self.automaton.iter_long(word)]
        if sum(map(self.length.__getitem__, greedy)) == len(word):
            last = greedy[0]
            for token in greedy[1:]:
                if not (known(last << 20 | token) or self.compatible(last, token)):
                    break
                last = token
            else:
                return greedy
        n, length, shorter = len(word), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(word):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if token >= 0 and not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                if token >= 0:
                    continue
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            elif token >= 0 and shorter[token] >= 0:
                token = shorter[token]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                raise ValueError(f"no encoding of {word!r}")

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, as symbols."""
        if text.isascii():  # the common case of one word, with at most one mark after it
            low = text.lower() if self.suffix else text
            body = low if self.suffix else low[1:] if low[:1] == " " else low
            if body.isalpha():
                return [low + END] if self.suffix else [low]
            if body[:-1].isalpha() and body[-1] in ".,;:!?":
                return [low[:-1] + END, low[-1] + END] if self.suffix else [low[:-1], low[-1]]
        if self.suffix:
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            return [w.encode().decode("latin-1") + END for w in ENDED_WORDS.findall(text)]
        return [w.encode().decode("latin-1") for w in BYTE_WORDS.findall(text)]

    def chunks(self, text: str) -> list[str] | None:
        """Parts of a text that are encoded independently of each other; None if it has no such parts.

        Words with a word-end symbol never hold white space. Byte-level words hold one leading space at most, so
        a text in which every space stands alone between two texts falls apart before each space.
        """
        if self.suffix:
            return text.split() if not SEPARATORS.search(text) else [x for x in SPACES.split(text) if x]
        if ODD_SPACE.search(text):
            return None
        return text.split(" ")

    def sections(self, text: str) -> list[tuple[str, int]]:
        """The text cut at special tokens: (text before, id of the special token or -1)."""
        if self.special_re is None or not any(s in text for s in self.special):
            return [(text, -1)]
        parts = self.special_re.split(text)
        return [(parts[i], self.special[parts[i + 1]] if i + 1 < len(parts) else -1) for i in range(0, len(parts), 2)]


class Encoder:
    """Encodes whole texts; chunks seen before come from a bounded cache."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.word_cache = ByteCache(CACHE_BYTES, lambda w: np.array(model.encode_word(w), "<u4").tobytes())
        self.cache = ByteCache(CACHE_BYTES, self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.word_cache[w] for w in self.model.words(chunk)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part, special in self.model.sections(text):
            if part:
                chunks = self.model.chunks(part)
                if chunks is None:
                    out.append(self._chunk(part))
                elif self.model.suffix:
                    out.extend(map(self.cache.__getitem__, chunks))
                else:
                    out.append(self._chunk(chunks[0]))
                    out.extend(map(self.cache.__getitem__, [" " + c for c in chunks[1:]]))
            if special >= 0:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        m, i = self.model, np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return ""
        starts, sizes = m.offset[i], m.offset[i + 1] - m.offset[i]
        ends = np.cumsum(sizes)
        data = m.block[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        return (data[: len(data) - len(m.joined)] if m.joined else data).decode("utf-8", "replace")


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process."""
    return resident(f"bpe {vocabulary}", lambda: Encoder(BpeModel(vocabulary)))


def encode_text(df: DataFrame, text_col: str = "text", vocabulary: str = "word_bpe_49k.json", decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and, if asked, ``decoded_text``.

    Encodes as the vocabulary's own library does without added special tokens, padding or truncation; special
    tokens written out in a text become their ids. A null text counts as empty and gives no ids. Rows are kept as
    they are, repeated ones too; columns of the added names are replaced. ``decoded_text`` is decoded from the ids.
    """
    prepare(df.sparkSession)
    fields = [("token_ids", T.BinaryType(), pa.binary()), ("n_tokens", T.LongType(), pa.int64())]
    fields += [("decoded_text", T.StringType(), pa.string())] if decoded else []

    def make():
        e = encoder(vocabulary)

        def compute(texts):
            for text in texts:
                ids = e.encode(text)
                yield (ids, len(ids) // 4, e.decode(ids)) if decoded else (ids, len(ids) // 4)

        return compute

    return arrow_map(df, text_col, fields, make, keep=keep)


def decode_ids(df: DataFrame, ids_col: str = "token_ids", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Adds ``decoded_text``, the text of the ids in ``ids_col`` (binary as above); null ids give an empty text."""
    prepare(df.sparkSession)
    passed = [c for c in df.columns if c != "decoded_text"]
    schema = T.StructType([df.schema[c] for c in passed] + [T.StructField("decoded_text", T.StringType())])

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            texts = [e.decode(x or b"") for x in batch.column(passed.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*passed, "decoded_text"])

    return df.select(*[f"`{c}`" for c in passed]).mapInArrow(run, schema)
