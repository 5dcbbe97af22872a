"""Token ids in a binary format of directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 holds the low chunk of every id, level 1 the next chunk of those ids that have
one, and so on. A bitmap for each level marks the ids that go on; a rank directory (set bits before each 512-bit
word group) turns a position in one level into the position in the next. So any id, or any range, is read by
position without decoding what stands before it.

A stored table has rows (bucket, seq, n_docs, n_tokens, payload), in ascending doc_id order by (bucket, seq).
"""

from __future__ import annotations

import bisect
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.byte_bpe import _LETTER, _NUMBER, _SPACE, Memo
from strandlog.llm.common import map_rows, scratch, slices, table

MAGIC = b"DAC1"
#: Bits for each entry of a rank directory.
GROUP = 512
#: A block is closed once it has so many ids (or one document).
BLOCK_TOKENS = 1 << 20


class DacWriter:
    @staticmethod
    def pack(ids: np.ndarray) -> bytes:
        """Levels of chunks, each with its bitmap and rank directory."""
        rest, levels = ids.astype(np.uint64), []
        while True:
            goes_on = rest > 255
            bitmap = np.packbits(goes_on, bitorder="little")
            bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (GROUP // 8), np.uint8)])
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bitmap).reshape(-1, GROUP // 8).sum(axis=1))]).astype("<u4")
            levels.append(struct.pack("<III", len(rest), len(bitmap), len(ranks)) + (rest & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.tobytes())
            if not goes_on.any():
                return struct.pack("<B", len(levels)) + b"".join(levels)
            rest = rest[goes_on] >> np.uint64(8)


class DacReader:
    """Random access to the ids of one packed sequence; nothing is decoded on opening."""

    def __init__(self, data: bytes, at: int = 0):
        (depth,) = struct.unpack_from("<B", data, at)
        at += 1
        self.levels = []
        for _ in range(depth):
            n, size, groups = struct.unpack_from("<III", data, at)
            at += 12
            chunk = np.frombuffer(data, np.uint8, n, at)
            bitmap = np.frombuffer(data, np.uint8, size, at + n)
            ranks = np.frombuffer(data, "<u4", groups, at + n + size)
            self.levels.append((chunk, bitmap, ranks))
            at += n + size + 4 * groups
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, bitmap, ranks = self.levels[level]
        group, byte = i // GROUP, i // 8
        count = int(ranks[group]) + int(np.bitwise_count(bitmap[group * (GROUP // 8) : byte]).sum())
        return count + (int(bitmap[byte] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; each level is entered by its rank directory."""
        out = np.zeros(max(0, stop - start), np.uint32)
        at = np.arange(len(out))
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            if start >= stop:
                break
            out[at] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            at = at[bits]
            begin = self.rank(level, start)
            start, stop = begin, begin + len(at)
        return out


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Documents with their ids: MAGIC, count, ids with a null mark, offsets, then the codes."""
    ends = np.cumsum([len(i) for i in ids]).astype("<u8")
    head = MAGIC + struct.pack("<I", len(ids)) + bytes(i is None for i in doc_ids) + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + ends.tobytes()
    return head + DacWriter.pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32))


def open_block(data: bytes) -> tuple[list[int | None], np.ndarray, DacReader]:
    """doc_ids, offsets (one more than documents) and a reader of the ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of directly addressable codes")
    (n,) = struct.unpack_from("<I", data, 4)
    null, numbers, ends = data[8 : 8 + n], np.frombuffer(data, "<i8", n, 8 + n), np.frombuffer(data, "<u8", n, 8 + 9 * n)
    return [None if x else int(i) for x, i in zip(null, numbers, strict=True)], np.concatenate([[0], ends]).astype(int), DacReader(data, 8 + 17 * n)


def latin_splitter(config: dict) -> re.Pattern | None:
    """The file's own split pattern for texts of code points below 256, or None if the file doesn't ask for just this: NFC, one space
    for white space, lower case, words by one pattern, byte-level letters, BPE with no option that looks beyond a word."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    kinds = [(n.get("type"), n.get("pattern"), n.get("content")) for n in steps]
    parts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = config.get("model") or {}
    fits = (
        kinds == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and (parts[0].get("behavior"), parts[0].get("invert")) == ("Removed", True)
        and (parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == (False, False)
        and model.get("type") == "BPE"
        and not any(config.get(n) for n in ("truncation", "padding", "post_processor"))
        and not any(model.get(n) for n in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    )
    pattern = parts[0].get("pattern", {}).get("Regex") if fits else None
    if pattern is None:
        return None
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace("[\\p{L}]", f"[{_LETTER}]").replace("[\\p{N}]", f"[{_NUMBER}]")
    return None if "\\" in re.sub(r"\\(x[0-9a-f]{2}|[tr])", "", pattern) else re.compile(pattern)


class WordTokenizer:
    """The tokenizers library, unaltered, with its results kept by word.

    Texts of code points below 256 are lower-cased and cut into words here, by the tokenizer file's own pattern (normalisation is
    the identity for them, but for case and white space), and each word is encoded by the library's model. Other texts go to the
    library whole, and so do texts that hold one of the file's special tokens, which the library gives their own ids. So do all
    texts if the file asks for anything else, or if the two ways differ on any of the 256 characters.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        special = [re.escape(t["content"]) for t in config.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(special)) if special else None
        self.words = latin_splitter(config)
        self.model = self.library.model
        self.known = Memo(self._word, 400_000)
        # the byte-level alphabet: visible Latin-1 characters stand for their own code, the others follow from 256 on
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(seen)]
        self.alphabet = dict(zip(hidden, map(chr, range(256, 512)), strict=False))
        if self.words is not None and any(self.encode(t) != self._text(t) for t in (x for c in map(chr, range(256)) for x in (c, f"a{c}b", f"1{c} {c}{c}", f"'{c}s"))):
            self.words = None

    def _word(self, word: str) -> bytes:
        """One word by the library's model, without its normaliser and splitter: they leave a single word as it is."""
        letters = word.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.words is None or (self.special is not None and self.special.search(text)):
            return self._text(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._text(text)
        return b"".join(map(self.known.__getitem__, self.words.findall(text.lower())))


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: The place of a null id in the order of ids.
_NULL = -(1 << 63)


def bounds(docs: DataFrame, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """(doc_id, salt) bounds of ranges of about equal numbers of rows, three for each shuffle partition; reads the id column only.

    An id with so many rows that it is several quantiles at once has its salts cut into as many ranges.
    """
    count = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NULL)).alias("id"))
    found = [int(q) for q in ids.approxQuantile("id", [i / count for i in range(1, count)], 0.2 / count)]
    out = []
    for value in sorted(set(found)):
        times = found.count(value)
        out += [(value, (1 << 64) * k // times - (1 << 63)) for k in range(1, times)] + [(value, 1 << 63)]
    return out


def tokenize(docs: DataFrame, path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, salt (a hash of the text), bucket (its range of ids and salts), n_tokens and ids (little-endian, 16-bit if `wide` is
    false, else 32-bit) of each document, the end id appended."""
    edges = bounds(docs, id_col)

    def make():
        coder = load(path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def step(cols):
            bucket = [bisect.bisect_left(edges, (_NULL if d is None else d, x)) for d, x in zip(cols["doc_id"], cols["salt"], strict=True)]
            out = {"doc_id": cols["doc_id"], "salt": cols["salt"], "bucket": bucket, "n_tokens": [], "wide": [], "ids": []}
            for text in cols["text"]:
                ids = np.frombuffer(coder.encode(text) + end, "<u4")
                wide = bool(len(ids) and ids.max() > 65535)
                out["n_tokens"].append(len(ids))
                out["wide"].append(wide)
                out["ids"].append(ids.tobytes() if wide else ids.astype("<u2").tobytes())
            return out

        return step

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_rows(read.withColumn("salt", F.xxhash64("text")), make, "doc_id long, salt long, bucket int, n_tokens long, wide boolean, ids binary")


def write(tokens: DataFrame, path: str) -> None:
    """Writes the result of tokenize() in ascending doc_id order (null first; equal ids by a hash of their text, then their tokens).

    Ids move in one shuffle, by bucket. A bucket is written as blocks of about BLOCK_TOKENS ids, streamed: no task holds more
    than a block.
    """
    placed = tokens.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "salt", "ids")
    names = {"bucket": pa.int32(), "seq": pa.int32(), "n_docs": pa.int32(), "n_tokens": pa.int64(), "payload": pa.binary()}

    def run(batches):
        at, seq, docs, ids, held = None, 0, [], [], 0

        def block():
            row = (at, seq, len(docs), held, pack_block(docs, ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, names.values(), strict=True)], list(names))

        for batch in batches:
            for part in slices(batch):
                for doc, wide, data, where in zip(*(part.column(c).to_pylist() for c in ("doc_id", "wide", "ids", "bucket")), strict=True):
                    if docs and (where != at or held >= BLOCK_TOKENS):
                        yield block()
                        seq, docs, ids, held = (seq + 1 if where == at else 0), [], [], 0
                    at = where
                    docs.append(doc)
                    ids.append(np.frombuffer(data, "<u4" if wide else "<u2"))
                    held += len(ids[-1])
        if docs:
            yield block()

    placed.mapInArrow(run, "bucket int, seq int, n_docs int, n_tokens long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, **derived: Column) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32-bit) of a stored table.

    Columns `derived` from the ids replace them; they are computed before the ids could move.
    """
    stored = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for bucket, seq, payload in zip(*(part.column(c).to_pylist() for c in ("bucket", "seq", "payload")), strict=True):
                    docs, offsets, codes = open_block(payload)
                    for a in range(0, len(docs), 1024):
                        b = min(len(docs), a + 1024)
                        ids = [codes.range(s, e).astype("<u4").tobytes() for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([bucket] * (b - a), pa.int32()), pa.array([seq] * (b - a), pa.int32()), pa.array(docs[a:b], pa.int64()), pa.array(offsets[a:b], pa.int64()), pa.array(np.diff(offsets[a : b + 1]), pa.int64()), pa.array(ids, pa.binary())],
                            ["bucket", "seq", "doc_id", "offset", "n_tokens", "ids"],
                        )

    docs = stored.select("bucket", "seq", "payload").mapInArrow(run, "bucket int, seq int, doc_id long, offset long, n_tokens long, ids binary")
    docs = docs.select("bucket", "seq", "doc_id", "offset", "n_tokens", *([c.alias(n) for n, c in derived.items()] or ["ids"]))
    sums = stored.groupBy("bucket", "seq").agg(F.sum("n_tokens").alias("n"))
    within = sums.withColumn("inner", F.sum("n").over(Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each bucket, so their running sum is small at any size
    buckets = stored.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).select("bucket", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("outer"))
    base = within.join(buckets, "bucket").select("bucket", "seq", (F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("base"))
    return docs.join(base, ["bucket", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", *(derived or ["ids"]))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have only the end id; repeated rows and null ids each give a row; an empty table gives none."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), path)
    return read(spark, path, ids_crc32=F.crc32("ids"))


__all__ = ["DacReader", "DacWriter", "WordTokenizer", "op3_token_store", "open_block", "pack_block", "read", "tokenize", "write"]
