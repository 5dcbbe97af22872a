"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

Comparing all suffixes of a corpus is out of reach, so only suffixes that can be equal meet:

1. Every string of LENGTH bytes has an anchor: the k-gram with the smallest hash among its k-grams. Strings that share an
   anchor lie in one span. Spans move as (k-gram hash, span hash, place), packed; equal spans are settled at once, and
   in each map task before the shuffle, so copies cost one entry for each task. Within a task equal hashes are confirmed byte by
   byte; over tasks 64 bits of the span's hash and 64 of its k-gram's stand for the bytes.
2. Spans that share an anchor's k-gram but differ (the borders of repeats) are fetched as text and their suffixes are
   sorted: a stable mergesort whose comparisons find the common extension of two suffixes by binary search over prefix
   polynomial hashes. In each run of suffixes equal over LENGTH bytes all but the first are repeats; equal hashes are
   confirmed byte by byte.
3. K-grams with very many different spans go by the hash of each single string instead, which spreads them. They are found by a
   sketch of counts over all documents; it decides the way, never the result.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import cut, slices, table

LENGTH = 100
GRAM = 32
_WINDOW = LENGTH - GRAM + 1
#: Positions hashed at once, and entries held by a map task before they are handed on.
CHUNK, HELD = 1 << 20, 400_000
#: Counters of the sketch, spans that make a k-gram frequent, and the multiple of a counter's mean that does so on larger inputs.
WIDTH, FREQUENT, OVER_MEAN = 1 << 20, 4096, 8
#: Counters that move together, and bytes of text for each bucket of k-grams or documents (one bucket is held at a time).
CELL, BUCKET_BYTES = 1 << 14, 64 << 20
#: The place of a null id in the order of ids.
_NULL = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1
#: An entry: k-gram hash, span hash, document, its part (texts of one id), first string's start, strings, the anchor's offset.
ENTRY = (("k", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("start", "<u4"), ("n", "<u1"), ("off", "<u1"))
#: Repeats of a document: strings start, start + 1, ... start + n - 1 are repeats.
REPEAT = (("doc", "<i8"), ("part", "<i8"), ("start", "<u4"), ("n", "<u4"))
#: Spans to be fetched.
WANTED = (("k", "<u8"), ("doc", "<i8"), ("part", "<i8"), ("start", "<u4"), ("n", "<u1"), ("off", "<u1"))


def pack(cols: dict[str, np.ndarray], kind) -> bytes:
    """Column after column, which packs better than row after row."""
    return b"".join(cols[n].astype(t).tobytes() for n, t in kind)


def unpack(blobs: list[bytes], kind) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in kind)
    got = {n: [] for n, _ in kind}
    for blob in blobs:
        count, at = len(blob) // width, 0
        for n, t in kind:
            got[n].append(np.frombuffer(blob, t, count, at))
            at += count * np.dtype(t).itemsize
    return {n: np.concatenate(v) if v else np.zeros(0, dict(kind)[n]) for n, v in got.items()}


def take(cols: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {n: v[at] for n, v in cols.items()}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        m = min(n, size - n)
        out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
        n += m
    return out


class Hashes:
    """Prefix polynomial hashes modulo 2^64 of a byte string: any substring's hash in a few steps."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        size = len(data) + 1
        table_size = max(CHUNK + 4 * LENGTH, 1 << (size - 1).bit_length())
        self.prefix = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, table_size)[: size - 1], out=self.prefix[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), table_size)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.inverse[start]


def spans(data: np.ndarray, text: np.ndarray):
    """(first string, last string, anchor) positions of each span in texts laid end to end; `text` numbers the bytes' texts."""
    hashes = Hashes(data)
    n = len(data) - GRAM + 1
    if n < _WINDOW:
        return None
    grams = mix((hashes.prefix[GRAM:] - hashes.prefix[:-GRAM]) * hashes.inverse[:n])
    place = np.arange(n, dtype=np.uint64)
    marked = (grams & np.uint64(_ALL << 21 & _ALL)) | place  # unique, and the leftmost of equal ones is smallest
    rows = np.concatenate([marked, np.full(-n % _WINDOW, _ALL, np.uint64)]).reshape(-1, _WINDOW)
    ahead, back = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - _WINDOW + 1
    anchor = (np.minimum(back[:count], ahead[_WINDOW - 1 : _WINDOW - 1 + count]) & np.uint64((1 << 21) - 1)).astype(np.int64)
    inside = np.flatnonzero(text[:count] == text[LENGTH - 1 : LENGTH - 1 + count])
    if not len(inside):
        return None
    anchor = anchor[inside]
    ends = np.append((np.diff(anchor) != 0) | (np.diff(inside) != 1), True)
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    return inside[first], inside[last], anchor[last], grams, hashes


def cell(key: np.ndarray) -> np.ndarray:
    """A k-gram's counter. Low bits of its hash: anchors have small high ones."""
    return (key & np.uint64(WIDTH - 1)).astype(np.int64)


def entries(docs: list[tuple[int, int, bytes]], frequent: np.ndarray | None) -> dict[str, np.ndarray]:
    """The entries of (document, part, text) triples, and `at`, where each begins in the texts laid end to end."""
    out = []
    group, size, offset = [], 0, 0
    for doc, part, raw in docs:
        for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK // 2):
            piece = raw[at : at + CHUNK // 2 + LENGTH - 1]
            if size + len(piece) > CHUNK:
                out.append(_entries(group, frequent))
                group, size = [], 0
            group.append((doc, part, at, offset, piece))
            size += len(piece)
        offset += len(raw)
    if group:
        out.append(_entries(group, frequent))
    out = [x for x in out if x is not None]
    return {n: np.concatenate([x[n] for x in out]) if out else np.zeros(0, t) for n, t in (*ENTRY, ("at", "<i8"))}


def _entries(group, frequent):
    data = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
    sizes = np.array([len(p) for *_, p in group])
    text = np.repeat(np.arange(len(group), dtype=np.int32), sizes)
    found = spans(data, text)
    if found is None:
        return None
    first, last, anchor, grams, hashes = found
    other = Hashes(data, _BASES[1])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    docs, parts, ats, offsets = (np.array([g[i] for g in group], np.int64) for i in range(4))

    def made(key, span, first, count, off):
        t = text[first]
        start = first - begin[t] + ats[t]
        return {"k": key, "s": span, "doc": docs[t], "part": parts[t], "start": start.astype(np.uint32), "n": count.astype(np.uint8), "off": off.astype(np.uint8), "at": start + offsets[t]}

    key = grams[anchor]
    often = frequent[cell(key)] if frequent is not None else np.zeros(len(key), bool)
    shape = ((anchor - first) * 256 + (last - first)).astype(np.uint64)
    plain = made(key, mix(other.of(first, last + LENGTH) ^ mix(shape + np.uint64(1))), first, last - first + 1, anchor - first)
    if not often.any():
        return plain
    lengths = (last - first + 1)[often]
    each = np.repeat(first[often] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    single = made(mix(hashes.of(each, each + LENGTH) + np.uint64(1)), mix(other.of(each, each + LENGTH)), each, np.ones(len(each)), np.zeros(len(each)))
    return {n: np.concatenate([plain[n][~often], single[n]]) for n in plain}


def tell_apart(cols: dict[str, np.ndarray], data: np.ndarray) -> dict[str, np.ndarray]:
    """The entries, with another span hash where the bytes (in `data`, from `at` on) differ from those of the first entry of equal hashes.

    Such spans then share only their k-gram, so their strings are compared in the suffix sort.
    """
    if len(data) < LENGTH or not len(cols["k"]):
        return cols
    order = np.lexsort((cols["s"], cols["k"]))
    cols = take(cols, order)
    head = np.append(True, (cols["k"][1:] != cols["k"][:-1]) | (cols["s"][1:] != cols["s"][:-1]))
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    rest = np.flatnonzero(~head)
    for i in range(0, len(rest), 1 << 14):
        a = rest[i : i + (1 << 14)]
        b = lead[a]
        more = cols["n"][a].astype(np.int64) - 1  # a span is covered by its first and its last string
        x, y = cols["at"][a], cols["at"][b]
        differ = (cols["n"][a] != cols["n"][b]) | (view[x] != view[y]).any(axis=1)
        same = np.flatnonzero(~differ)
        differ[same] = (view[(x + more)[same]] != view[(y + more)[same]]).any(axis=1)
        for j in a[differ].tolist():
            at, size = int(cols["at"][j]), int(cols["n"][j]) + LENGTH - 1
            cols["s"][j] = np.uint64(int.from_bytes(blake2b(data[at : at + size].tobytes(), digest_size=8).digest(), "little"))
    return cols


def settle(cols: dict[str, np.ndarray]) -> tuple[dict, dict]:
    """(the earliest entry of each span, the repeats). Entries of the same place are no repeats of each other."""
    order = np.lexsort((cols["start"], cols["part"], cols["doc"], cols["s"], cols["k"]))
    cols = take(cols, order)
    head = np.ones(len(order), bool)
    head[1:] = (cols["k"][1:] != cols["k"][:-1]) | (cols["s"][1:] != cols["s"][:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
    same = (cols["doc"] == cols["doc"][lead]) & (cols["start"] == cols["start"][lead]) & (cols["part"] == cols["part"][lead])
    return take(cols, head), merge({n: cols[n][~same] for n, _ in REPEAT})


def merge(repeats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Joins runs of a document that touch."""
    order = np.lexsort((repeats["start"], repeats["part"], repeats["doc"]))
    r = take(repeats, order)
    if not len(order):
        return r
    start, stop = r["start"].astype(np.int64), r["start"].astype(np.int64) + r["n"]
    head = np.append(True, (r["doc"][1:] != r["doc"][:-1]) | (r["part"][1:] != r["part"][:-1]) | (start[1:] > stop[:-1]))
    at = np.flatnonzero(head)
    out = take(r, at)
    out["n"] = np.maximum.reduceat(stop, at) - start[at]
    return out


def target(doc: np.ndarray, part: np.ndarray, count: int) -> np.ndarray:
    """pmod(xxhash64(doc, part), count) as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(doc), 42, np.uint64)
    for value in (doc, part):
        h = h + p5 + np.uint64(8)
        h = turn(h ^ (turn(value.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return (h.view(np.int64) % count).astype(np.int64)


def _bounds(where: np.ndarray):
    """(start, stop) of each run of equal values."""
    edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])).tolist() if len(where) else []
    return zip(edges, [*edges[1:], len(where)][: len(edges)], strict=True)


def _by(where: np.ndarray, cols: dict[str, np.ndarray], kind, code: int):
    """(bucket, kind, payload) for each bucket that has rows."""
    order = np.argsort(where, kind="stable")
    where, cols = where[order], take(cols, order)
    for a, b in _bounds(where):
        yield int(where[a]), code, pack(take(cols, slice(a, b)), kind)


_ENTRIES, _REPEATS, _WANTED = 0, 1, 2
_PACKED = "bucket int, kind int, payload binary"


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "payload"])


def _map(frequent, buckets: int):
    """Documents to packed entries by k-gram bucket, and the repeats that a task finds by itself."""

    def run(batches):
        held, texts, count, size = [], [], 0, 0

        def flush():
            cols = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            first, repeats = settle(tell_apart(cols, np.frombuffer(b"".join(texts), np.uint8)))
            yield _batch([*_by((first["k"] >> np.uint64(8)) % np.uint64(buckets), first, ENTRY, _ENTRIES), *_by(target(repeats["doc"], repeats["part"], buckets), repeats, REPEAT, _REPEATS)])

        for batch in batches:
            for part in slices(batch):
                docs = list(zip(*(part.column(c).to_pylist() for c in ("key", "part")), (t.encode() for t in part.column("text").to_pylist()), strict=True))
                found = entries(docs, frequent.value)
                found["at"] += size
                held.append(found)
                texts += [raw for *_, raw in docs]
                size += sum(len(raw) for *_, raw in docs)
                count += len(found["k"])
                if count >= HELD:
                    yield from flush()
                    held, texts, count, size = [], [], 0, 0
        if count:
            yield from flush()

    return run


def _runs(batches, finish):
    """Calls finish(bucket, rows) for the rows of each bucket, which come together."""
    now, rows = None, []
    for batch in batches:
        for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and rows:
                yield from finish(now, rows)
                rows = []
            now = bucket
            rows.append(rest)
    if rows:
        yield from finish(now, rows)


def _reduce(buckets: int):
    """Settles equal spans over all tasks; asks for the text of spans that share an anchor but differ."""

    def finish(bucket, rows):
        out = [(bucket, _REPEATS, p) for kind, p in rows if kind == _REPEATS]
        first, repeats = settle(unpack([p for kind, p in rows if kind == _ENTRIES], ENTRY))
        out += _by(target(repeats["doc"], repeats["part"], buckets), repeats, REPEAT, _REPEATS)
        alone = np.ones(len(first["k"]), bool)
        alone[1:] &= first["k"][1:] != first["k"][:-1]
        alone[:-1] &= first["k"][1:] != first["k"][:-1]
        wanted = {n: first[n][~alone] for n, _ in WANTED}
        out += _by(target(wanted["doc"], wanted["part"], buckets), wanted, WANTED, _WANTED)
        yield _batch(out)

    return lambda batches: _runs(batches, finish)


def _fetch(buckets: int):
    """The wanted spans' texts, packed by k-gram bucket: the wanted columns, then the text bytes of each."""

    def run(key, docs, asked):
        wanted = unpack(asked.column("payload").to_pylist(), WANTED)
        texts = {(k, p): t for k, p, t in zip(*(docs.column(c).to_pylist() for c in ("key", "part", "text")), strict=True)} if len(wanted["k"]) else {}
        order = np.lexsort((wanted["part"], wanted["doc"]))
        wanted, pieces, last, raw = take(wanted, order), [], None, b""
        for doc, part, start, n in zip(*(wanted[c].tolist() for c in ("doc", "part", "start", "n")), strict=True):
            if (doc, part) != last:
                last, raw = (doc, part), texts[doc, part].encode()
            pieces.append(raw[start : start + n + LENGTH - 1])
        where = ((wanted["k"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rows, where = [], where[order]
        for a, b in _bounds(where):
            rows.append((int(where[a]), b - a, pack(take(wanted, order[a:b]), WANTED), b"".join(pieces[i] for i in order[a:b])))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "payload", "text"])

    return run


class SuffixSorter:
    """Sorts suffixes of one byte string over their first LENGTH bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.hashes = data, Hashes(data)

    def equal(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        return self.hashes.of(a, a + size) == self.hashes.of(b, b + size)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, LENGTH at most: the longest prefix with equal hashes, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        out = or_equal.copy()
        differ = np.flatnonzero(~self.equal(a, b, LENGTH))
        if len(differ):
            x, y = a[differ], b[differ]
            size = np.minimum(self.extension(x, y), LENGTH - 1)
            out[differ] = self.data[x + size] < self.data[y + size]
        return out

    def sort(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (groups lie together): a stable bottom-up mergesort of all at once.

        Two sorted runs merge by rank: an element's place is its own index plus the elements of the other run before it.
        """
        n = len(suffix)
        order = np.arange(n)
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, int)
        sizes = np.diff(np.append(head, n))
        base, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
        width = 1
        while n and width < sizes.max():
            at = np.flatnonzero(size > width)
            inner = at - base[at]
            run = inner // width
            other = base[at] + (run ^ 1) * width
            stop = np.minimum(other + width, base[at] + size[at])
            there = np.flatnonzero(other < stop)
            mine, low, high = suffix[order[at[there]]], other[there].copy(), stop[there].copy()
            right = (run[there] & 1).astype(bool)
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                middle = (low[live] + high[live]) // 2
                before = self.less(suffix[order[middle]], mine[live], right[live])  # an equal one of the left run stays before
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
            rank = np.zeros(len(at), np.int64)
            rank[there] = low - other[there]
            moved = order.copy()
            moved[base[at] + run // 2 * 2 * width + inner % width + rank] = order[at]
            order = moved
            width *= 2
        return order


def resolve(wanted: dict[str, np.ndarray], data: np.ndarray) -> dict[str, np.ndarray]:
    """Repeats among the strings of spans whose texts lie end to end in `data`, in the order of `wanted`."""
    counts = wanted["n"].astype(np.int64)
    base = np.concatenate([[0], np.cumsum(counts + LENGTH - 1)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts).astype(np.int64)
    start = wanted["start"][owner].astype(np.int64) + step
    doc, part, offset = wanted["doc"][owner], wanted["part"][owner], wanted["off"][owner].astype(np.int64) - step
    order = np.lexsort((start, part, doc, offset, wanted["k"][owner]))
    key = wanted["k"][owner][order]
    group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (np.diff(offset[order]) != 0))) if len(order) else order
    sorter, suffix = SuffixSorter(data), (base[owner] + step)[order]
    place = sorter.sort(suffix, group)
    order, group, suffix = order[place], group, suffix[place]
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = (group[1:] == group[:-1]) & sorter.equal(suffix[1:], suffix[:-1], LENGTH)
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH) if len(data) >= LENGTH else np.zeros((0, LENGTH), np.uint8)
    broken = []
    pairs = np.flatnonzero(same)
    for i in range(0, len(pairs), 1 << 14):
        p = pairs[i : i + (1 << 14)]
        broken.append(p[(view[suffix[p]] != view[suffix[p - 1]]).any(axis=1)])
    for g in np.unique(group[np.concatenate(broken)]) if broken else ():  # a hash collision: that group again, by its bytes
        at = np.flatnonzero(group == g)
        exact = sorted(at, key=lambda i: (view[suffix[i]].tobytes(), doc[order[i]], part[order[i]], start[order[i]]))
        order[at], suffix[at] = order[exact], suffix[exact]
        same[at[1:]] = (view[suffix[at[1:]]] == view[suffix[at[:-1]]]).all(axis=1)
    lead = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(order) else order
    first, own = order[lead], order
    repeated = same & ~((doc[own] == doc[first]) & (part[own] == part[first]) & (start[own] == start[first]))
    own = own[repeated]
    return merge({"doc": doc[own], "part": part[own], "start": start[own].astype(np.uint32), "n": np.ones(len(own), np.uint32)})


#: Strings sorted at a time, or those of one k-gram.
SORTED = 200_000


def _resolve(buckets: int):
    def finish(bucket, rows):
        wanted = unpack([p for _, p, _ in rows], WANTED)
        text = b"".join(t for *_, t in rows)  # in the order of the payloads
        sizes = wanted["n"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(wanted["k"], kind="stable")
        key, reach = wanted["k"][order], np.cumsum(wanted["n"][order].astype(np.int64))
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        found, a = [], 0
        while a < len(order):
            limit = (reach[a - 1] if a else 0) + SORTED
            b = int(ends[max(np.searchsorted(reach[ends - 1], limit, side="right") - 1, np.searchsorted(ends, a, side="right"))])
            some = order[a:b]
            data = b"".join(text[s : s + n] for s, n in zip(begin[some].tolist(), sizes[some].tolist(), strict=True))
            found.append(resolve(take(wanted, some), np.frombuffer(data, np.uint8)))
            a = b
        repeats = merge({n: np.concatenate([f[n] for f in found]) for n, _ in REPEAT})
        yield _batch(list(_by(target(repeats["doc"], repeats["part"], buckets), repeats, REPEAT, _REPEATS)))

    return lambda batches: _runs(batches, finish)


RESULT = "key long, part long, n_bytes long, n_removed long, n_spans long, kept binary"


def _apply(key, docs, packed) -> pa.Table:
    """Each text without the bytes that its repeats cover."""
    repeats = merge(unpack(packed.column("payload").to_pylist(), REPEAT))
    by: dict[tuple[int, int], list[int]] = {}
    for i, at in enumerate(zip(repeats["doc"].tolist(), repeats["part"].tolist(), strict=True)):
        by.setdefault(at, []).append(i)
    out = {n: [] for n in ("key", "part", "n_bytes", "n_removed", "n_spans", "kept")}
    for doc, part, text in zip(*(docs.column(c).to_pylist() for c in ("key", "part", "text")), strict=True):
        raw = text.encode()
        kept, done, removed, runs = [], 0, 0, 0
        for i in by.get((doc, part), ()):
            start, stop = int(repeats["start"][i]), int(repeats["start"][i] + repeats["n"][i]) + LENGTH - 1
            if start > done or not runs:
                kept.append(raw[done:start])
                runs += 1
            removed += stop - max(start, done)
            done = stop
        kept.append(raw[done:])
        for n, v in zip(out, (doc, part, len(raw), removed, runs, b"".join(kept)), strict=True):
            out[n].append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row.

    A byte goes if a LENGTH-byte string over it also starts earlier: in a smaller doc_id, or earlier in the same
    document; all is judged on the input. A null or empty text has no bytes; one shorter than LENGTH stays. A null doc_id
    comes before all others. Rows of one doc_id with the same text are one document and get the same result; with
    different texts, however many, they are parts of it, in an order set by a hash of the text. Matches never cross rows. An empty table gives no rows; other columns are not looked
    at.
    """
    spark = docs.sparkSession
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    null = F.col("doc_id").isNull()
    read = read.withColumn("key", F.coalesce("doc_id", F.lit(_NULL).cast("long")))
    by = ["key", null.alias("none")]
    sign = F.shiftrightunsigned(F.xxhash64("text"), 1)
    ids = read.groupBy(*by).agg(F.min(sign).alias("a"), F.max(sign).alias("b"), F.sum(F.octet_length("text")).alias("size"))
    size, shared = ids.agg(F.sum("size"), F.max((F.col("a") != F.col("b")).cast("int"))).first()
    salt, part = 0, F.lit(0).cast("long")
    while shared:  # different texts under one id are told apart by a hash that is checked to do so
        part = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "text"), 1)
        sha = F.sha2("text", 256)
        if not read.groupBy(*by, part.alias("part")).agg((F.min(sha) != F.max(sha)).alias("mixed")).where("mixed").head(1):
            break
        salt += 1
    texts = read.select("key", F.when(null, -1 - part).otherwise(part).alias("part"), "text")  # a null id's parts are negative
    # a task holds a bucket at a time, so there are more of them the more text there is
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES))
    frequent = spark.sparkContext.broadcast(_frequent(texts))
    mapped = texts.mapInArrow(_map(frequent, buckets), _PACKED)
    first = cut(mapped.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_reduce(buckets), _PACKED))
    placed = texts.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int")).groupBy("bucket")
    wanted = first.where(F.col("kind") == _WANTED).groupBy("bucket")
    fetched = placed.cogroup(wanted).applyInArrow(_fetch(buckets), _PACKED + ", text binary")
    second = fetched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(buckets), _PACKED)
    repeats = first.where(F.col("kind") == _REPEATS).unionByName(second).groupBy("bucket")
    out = placed.cogroup(repeats).applyInArrow(_apply, RESULT)
    return out.select(F.when((F.col("key") != _NULL) | (F.col("part") >= 0), F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _frequent(texts: DataFrame) -> np.ndarray | None:
    """A mark for each counter whose k-grams have FREQUENT or more spans in all documents (OVER_MEAN times the mean, if that is
    more), or None without any. Spans count once in each batch of a task, as they reach the reducers. Each task fills WIDTH
    counters, which are summed over the tasks in cells; only marked ones reach the driver."""

    def count(batches):
        totals = np.zeros(WIDTH, np.uint32)
        for batch in batches:
            for part in slices(batch):
                found = entries([(0, 0, t.encode()) for t in part.column("text").to_pylist()], None)
                order = np.lexsort((found["s"], found["k"]))
                key, span = found["k"][order], found["s"][order]
                new = np.append(True, (key[1:] != key[:-1]) | (span[1:] != span[:-1])) if len(key) else np.zeros(0, bool)
                totals += np.bincount(cell(key[new]), minlength=WIDTH).astype(np.uint32)
        for i in range(WIDTH // CELL if totals.any() else 0):
            some = totals[i * CELL : (i + 1) * CELL]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([some.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary())], ["cell", "counts"])  # low bytes first: they pack well

    def add(batches):
        def finish(i, rows):
            total = np.zeros(CELL, np.int64)
            for (raw,) in rows:
                total += np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
            high = np.flatnonzero(total >= FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array([int(total.sum())]), pa.array([(high + i * CELL).tolist()], pa.list_(pa.int32())), pa.array([total[high].tolist()], pa.list_(pa.int64()))], ["total", "high", "counts"])

        yield from _runs(batches, finish)

    summed = texts.select("text").mapInArrow(count, "cell int, counts binary").repartition("cell").sortWithinPartitions("cell")
    rows = summed.mapInArrow(add, "total long, high array<int>, counts array<long>").collect()
    least = max(FREQUENT, OVER_MEAN * sum(r["total"] for r in rows) / WIDTH)
    marks = np.zeros(WIDTH, bool)
    for r in rows:
        marks[[c for c, n in zip(r["high"], r["counts"], strict=True) if n >= least]] = True
    return marks if marks.any() else None


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: For tables with one row for each doc_id: every string of LENGTH bytes, as hex, with all places it starts at.
ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - {LENGTH - 1}, 0))) as i from d)),
repeats as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from strings) where r > 1),
marked as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {LENGTH} then 0 else 1 end as head from repeats),
runs as (
  select doc_id, run, min(i) as a, max(i) + {LENGTH} as b
  from (select doc_id, i, sum(head) over (partition by doc_id order by i) as run from marked) group by 1, 2),
pieces as (
  select doc_id, run, b - a as n, substr(h, 2 * done + 1, 2 * (a - done)) as piece, b
  from (select *, coalesce(lag(b) over (partition by doc_id order by run), 0) as done from runs) join d using (doc_id)),
kept as (select doc_id, count(*) as n_spans, sum(n) as n_removed, string_agg(piece, '' order by run) as front, max(b) as done from pieces group by 1)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(done, 0) + 1))) as kept_sha256
from d left join kept using (doc_id)"""
