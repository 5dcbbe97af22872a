"""Benchmark decontamination: Wu-Manber search for all 13-word windows of the benchmark items at once."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import append, free_name, map_rows, table

WINDOW = 13
#: Bytes of item text whose tables a worker holds; larger benchmarks take several passes.
BLOCK_BYTES = 1 << 19
#: Longest character block of the shift tables.
BLOCK = 8

#: Lower-cases A-Z and turns all that stands between words into spaces; bytes from 0x80 belong to words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Finds byte strings. Strings of similar length share a shift table, so a short one doesn't shorten the others' jumps."""

    def __init__(self, patterns: dict[bytes, object]):
        self.groups = []
        by_size: dict[int, list[bytes]] = {}
        for p in patterns:
            by_size.setdefault(len(p).bit_length(), []).append(p)
        for found in by_size.values():
            m = min(map(len, found))
            block = min(BLOCK, m)
            jump = m - block + 1
            shift: dict[bytes, int] = {}
            heads: dict[bytes, list[bytes]] = {}
            for p in found:
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    if m - end < shift.get(key, jump):
                        shift[key] = m - end
                heads.setdefault(p[:m], []).append(p)
            self.groups.append((m, block, jump, shift, heads))

    def find(self, text: bytes):
        """Yields (start, pattern) for every occurrence, overlapping ones included."""
        size = len(text)
        for m, block, jump, shift, heads in self.groups:
            shift_of, end = shift.get, m
            while end <= size:
                step = shift_of(text[end - block : end], jump)
                if step:
                    end += step
                    continue
                start = end - m
                for p in heads.get(text[start:end], ()):
                    if text.startswith(p, start):
                        yield start, p
                end += 1


def item_windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[bytes, set[str]]:
    """Each window, words parted and bordered by single spaces, with the ids of its items."""
    found: dict[bytes, set[str]] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(str(item_id))
    return found


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
#: A document's hits in one block of items: (first word, words) pairs as little-endian 64-bit integers, and the items.
_HITS = "doc_id long, sign string, block int, hits binary, items array<string>"


class Searcher:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.windows = item_windows(items)
        self.matcher = WuManber(self.windows)
        self.lengths = {p: p.count(b" ") - 1 for p in self.windows}

    def search(self, w: list[bytes]) -> tuple[bytes, set[str]]:
        """The hits, packed, and the ids of the items that occur in the words."""
        if not w or not self.windows:
            return b"", set()
        line = b" " + b" ".join(w) + b" "
        found = list(self.matcher.find(line))
        if not found:
            return b"", set()
        index = np.cumsum(np.frombuffer(line, np.uint8) == 32) - 1
        return np.array([(index[s], self.lengths[p]) for s, p in found], "<i8").tobytes(), set().union(*(self.windows[p] for p in {p for _, p in found}))


def covered(hits: bytes, n_words: int) -> int:
    """Words inside any of the packed hits."""
    if not hits:
        return 0
    spans = np.frombuffer(hits, "<i8").reshape(-1, 2)
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans.sum(axis=1), -1)
    return int((np.cumsum(edges) > 0).sum())


def _report(doc_ids: list, sizes: list[int], hits: list[bytes], items: list[set[str]]) -> dict:
    n_hit, items = [covered(h, n) for h, n in zip(hits, sizes, strict=True)], [sorted(i) for i in items]
    return {
        "doc_id": doc_ids,
        "n_words": sizes,
        "n_hit": n_hit,
        "n_items": [len(i) for i in items],
        "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
        "contaminated": [h > 0 and 20 * h >= n for h, n in zip(n_hit, sizes, strict=True)],
        "items": items,
    }


def _pieces(text: str, size: int, window: int = WINDOW):
    """The text, or, of a text above `size` bytes, runs of words that share window - 1 words, so that no window is lost."""
    w = words(text) if len(text.encode()) > size else []
    step = max(1, size // max(1, max(map(len, w), default=1)))
    if len(w) <= max(window, step):
        yield text
        return
    for at in range(0, len(w) - window + 1, step):
        yield b" ".join(w[at : at + step + window - 1]).decode()


def item_blocks(items: DataFrame, size: int):
    """Broadcasts of (item_id, text) lists with at most about `size` bytes of text each; at least one. One scan, a block at a time."""
    sc, held, total = items.sparkSession.sparkContext, [], 0
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string"))
    for item_id, text in wanted.toLocalIterator():
        for piece in _pieces(text, size):
            if held and total + len(piece.encode()) > size:
                yield sc.broadcast(held)
                held, total = [], 0
            held.append((item_id, piece))
            total += len(piece.encode())
    yield sc.broadcast(held)


def _hits(docs: DataFrame, blocks: list) -> DataFrame:
    """_HITS rows of the documents (doc_id, text) that have hits, once for each block. Each block is a pass of its own: a
    union's tasks run apart, so a worker holds the tables of one block only."""

    def search(number, block):
        def make():
            searcher = Searcher(block.value)

            def step(cols):
                found = [(d, s, *searcher.search(words(t))) for d, s, t in zip(cols["doc_id"], cols["sign"], cols["text"], strict=True)]
                found = [f for f in found if f[2]]
                return {"doc_id": [f[0] for f in found], "sign": [f[1] for f in found], "block": [number] * len(found), "hits": [f[2] for f in found], "items": [sorted(f[3]) for f in found]}

            return step

        return make

    read = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("sign"), "text").where(F.col("text").isNotNull())
    out = None
    for number, block in enumerate(blocks):
        some = map_rows(read, search(number, block), _HITS)
        out = some if out is None else out.unionByName(some)
    return out


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (the ids, sorted as strings).

    Documents are scanned whole where they lie. The items are broadcast in blocks of at most about block_bytes (BLOCK_BYTES) of text.
    One block is one narrow pass. More blocks are a pass each, apart from one another, whose hits (not the texts) are
    brought together by (doc_id, hash of the text); equal rows have equal hits, so they count once there.
    Null or empty texts have no words, hits or items. Items with null text, without a word or with a null id have no windows. Items
    repeated under one id count once. Repeated documents and null ids each give a row; an empty table gives none, and
    an empty benchmark no hits. Other columns are not looked at.
    """
    blocks = list(item_blocks(items, block_bytes or BLOCK_BYTES))
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if len(blocks) == 1:

        def whole():
            searcher = Searcher(blocks[0].value)

            def step(cols):
                split = [words(t) for t in cols["text"]]
                found = [searcher.search(w) for w in split]
                return _report(cols["doc_id"], [len(w) for w in split], [h for h, _ in found], [i for _, i in found])

            return step

        return map_rows(read, whole, SCHEMA)
    each = _hits(read, blocks).groupBy("doc_id", "sign", "block").agg(F.min("hits").alias("hits"), F.min("items").alias("items"))
    merged = each.groupBy("doc_id", "sign").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = append(read.withColumn("sign", F.sha2(F.col("text"), 256)), lambda: lambda cols: {"n_words": [len(words(t)) for t in cols["text"]]}, {"text": "text"}, {"n_words": "long"}).drop("text")
    found = merged.select(F.col("doc_id").alias("d"), F.col("sign").alias("s"), "hits", "items")
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sign") == F.col("s")), "left").select("doc_id", "n_words", "hits", "items")

    def finish():
        return lambda cols: _report(cols["doc_id"], cols["n_words"], [b"".join(h or ()) for h in cols["hits"]], [set(i or ()) for i in cols["items"]])

    return map_rows(joined, finish, SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, in whose text no window of any item occurs, however long the text.

    One passage is enough to leak an item, so the share of hit words doesn't matter here. Cases as in find_contamination.
    """
    blocks = list(item_blocks(items, block_bytes or BLOCK_BYTES))
    text = F.col(f"`{text_col}`").cast("string")
    if len(blocks) == 1:
        flag = free_name(docs, "_hit")

        def make():
            searcher = Searcher(blocks[0].value)
            return lambda cols: {flag: [bool(searcher.search(words(t))[0]) for t in cols["text"]]}

        return append(docs, make, {"text": text_col}, {flag: "boolean"}).where(~F.col(flag)).drop(flag)
    hit = _hits(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")), blocks).select(F.col("sign").alias("_hit_sign")).distinct()
    return docs.join(hit, F.sha2(text, 256) == F.col("_hit_sign"), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with iw as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
wins as (
  select item_id, least(len(w), {WINDOW}) as size, list_aggregate(w[i : i + least(len(w), {WINDOW}) - 1], 'string_agg', ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct size from wins),
dw as (select row_number() over () as row_id, doc_id, {_WORDS} as w from documents),
grams as (
  select row_id, size, i, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') as win
  from (select row_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hits as (select g.row_id, g.i, g.size, item_id from grams g join wins using (size, win)),
hit_words as (select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(i, i + size)) as p from (select distinct row_id, i, size from hits)) group by 1),
hit_items as (select row_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hits group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit_words using (row_id) left join hit_items using (row_id)"""
