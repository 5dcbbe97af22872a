"""Byte-level BPE by longest matches and backtracking.

A sequence of tokens is the merge result of its bytes exactly if every two adjacent tokens are compatible: their
joint bytes would merge into just these two. So the encoder walks the text once, takes the longest vocabulary match
(Aho-Corasick over bytes mapped to Latin-1) that is compatible with the token before it, falls back to shorter prefixes,
and backtracks past positions that turn out to have no continuation; each position fails at most once.
Compatibility of token pairs is memoised.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import keeps, map_rows, table

#: Entries of a memo table, which is emptied when full: speed only, never results.
MEMO = 200_000
#: White space of the Rust and `regex` dialects; Python's `re` also counts 0x1C to 0x1F.
_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"


def _latin(pattern: str) -> re.Pattern:
    """The split pattern for texts of code points below 256, for the faster standard module."""
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]")
    pattern = pattern.replace("\\p{L}", f"[{_LETTER}]").replace("\\p{N}", f"[{_NUMBER}]")
    return re.compile(pattern.replace("\\s", f"[{_SPACE}]").replace("\\S", f"[^{_SPACE}]"))


class Memo(dict):
    """A dict that computes missing values and is emptied when full."""

    def __init__(self, compute, size: int = MEMO):
        super().__init__()
        self.compute, self.size = compute, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        got = self[key] = self.compute(key)
        return got


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.wide = regex.compile(pattern)
        self.latin = _latin(pattern) if not re.search(r"\\p\{(?!L\}|N\})", pattern) else None
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits = Memo(self._fits)
        self.pieces = Memo(self._piece)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) == 1 or self._split(rank) is not None:  # else no merge makes it
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost, with ranks under `below` only. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            at, best = -1, below
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1], below)
                if r < best:
                    at, best = i, r
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that merging never makes."""
        if token not in self.splits:
            parts = self.merge(self.bytes_of[token], token)
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of two tokens merge into just them.

        Undoes merges from the border outwards, the latest first. A merge across the border that would have come
        before the undone one shows that the pair can't stand.
        """
        left, right = pair
        before = len(self.ranks) + 1
        first, second = self.bytes_of[left], self.bytes_of[right]
        while True:
            across = self.ranks.get(first + second)
            if across is not None and across < before:
                return False
            a, b = self._split(left), self._split(right)
            if a is None and b is None:
                return True
            # of equal ranks the left merge comes first, so the right one is undone first
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
                first = self.bytes_of[left]
            else:
                before, right = right + 1, b[0]
                second = self.bytes_of[right]

    def _prefix(self, token: int) -> int | None:
        """The longest shorter token that begins this one and that merging can make."""
        if token not in self.shorter:
            data, found = self.bytes_of[token], None
            for n in range(len(data) - 1, 0, -1):
                rank = self.ranks.get(data[:n])
                if rank is not None and (n == 1 or self._split(rank) is not None):
                    found = rank
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest: list = [None] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size] = token  # for a start, longer ones end later
        bytes_of, fits, out, dead, at = self.bytes_of, self.fits, [], bytearray(n + 1), 0
        token = longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(bytes_of[token])
                if not dead[end] and (last is None or fits[last, token]):
                    break
                token = self._prefix(token)
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(bytes_of[token])
        return out

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text is empty."""
        if not text:
            return b""
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return b"".join(map(self.pieces.__getitem__, self.latin.findall(text)))
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.pieces.__getitem__, self.wide.findall(text)))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """From a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return ByteBpe(ranks, pattern)


keeps(__name__, load.cache_clear)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary, from the ids).

    One narrow pass: every executor reads the vocabulary file, texts are never shuffled, and memory is bounded by a
    slice of rows and the memo tables. A null or empty text has no ids; texts of any length are encoded whole, in linear
    time; repeated rows and null ids each give their row; an empty table gives none; other columns are not looked at.
    """

    def make():
        bpe = load(path, pattern)
        bpe.pieces.clear()  # workers live on and take other tasks

        def step(cols):
            ids = [bpe.encode(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": [bpe.decode(i) for i in ids]}

        return step

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_rows(read, make, "doc_id long, n_tokens long, ids binary, decoded binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), *default_vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
