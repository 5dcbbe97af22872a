"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into slices; each slice acts as one list owner, whose local score of an entry is the partial inner
product. Phase 1: each owner gathers its best entries; the full scores of these few give a safe cutoff for each query, since the
k-th best of any real scores can't exceed the final k-th best. Phase 2: the cutoff goes back. An entry that reaches it has the
uniform share (cutoff over owners) in at least one slice, so each owner hands in its entries at that share or above; entries whose
norm can't reach it are not multiplied at all. Phase 3: only what was handed in gets its full score, which decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import cut, table

#: Rows of a candidate block, queries of a query block: two score matrices of a block pair stay below 50 MB.
CHUNK, QUERIES = 2048, 1024
SLICES = 2
_EXACT = 2.0**53
#: Entries scored at a time in phase 3.
_STEP = 1 << 16


def quantise(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id and floor(scale * x) of each component as long; drops vectors that are null or hold null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension each: n, dim, ids and values as binary."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim, items):
            return {"n": [len(items)], "dim": [dim], "ids": [np.array([i for i, _ in items], "<i8").tobytes()], "vals": [np.array([v for _, v in items], "<i8").tobytes()]}

        import pyarrow as pa

        types = {"n": pa.int32(), "dim": pa.int32(), "ids": pa.binary(), "vals": pa.binary()}

        def out(d):
            return pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in d.items()})

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield out(block(len(v), held.pop(len(v))))
        for dim, items in held.items():
            yield out(block(dim, items))

    return rows.mapInArrow(run, "n int, dim int, ids binary, vals binary")


class BlockPair:
    """A block of queries and a block of candidates, in exact arithmetic: doubles while all sums stay below 2^53, else integers.

    `scored` counts the entries that got a full score, `multiplied` those that got a local one, by slice.
    """

    def __init__(self, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, slices: int = SLICES):
        dim = queries.shape[1]
        most = [float(max(np.abs(x.astype(float)).max(initial=0), 1)) for x in (queries, candidates)]
        kind = np.float64 if most[0] * most[1] * max(dim, 1) < _EXACT else object
        self.qids, self.ids, self.a, self.b = qids, ids, queries.astype(kind), candidates.astype(kind)
        self.edges = np.linspace(0, dim, slices + 1).astype(int)
        self.slices, self.scored, self.multiplied = slices, 0, 0

    def _part(self, j: int) -> slice:
        return slice(self.edges[j], self.edges[j + 1])

    def local(self, j: int, some=slice(None)) -> np.ndarray:
        """Slice j's scores of all queries with some of the candidates."""
        out = self.a[:, self._part(j)] @ self.b[some, self._part(j)].T
        self.multiplied += out.size
        return out

    def full(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Full scores of single entries (query, candidate)."""
        out = np.zeros(len(q), self.a.dtype)
        for i in range(0, len(q), _STEP):
            out[i : i + _STEP] = (self.a[q[i : i + _STEP]] * self.b[c[i : i + _STEP]]).sum(axis=1)
        self.scored += len(q)
        return out

    def gather(self, k: int) -> list[list[int]]:
        """Phase 1: for each query the k best full scores of what the slices' k best lists hold, the query's own id left out."""
        picks = np.zeros((len(self.qids), len(self.ids)), bool)
        own = self.qids[:, None] == self.ids[None, :]
        rows = np.arange(len(self.qids))[:, None]
        for j in range(self.slices):
            scores = self.local(j)
            if scores.dtype == np.float64:
                scores[own] = -np.inf
            picks[rows, _best(scores, k)] = True
        q, c = np.nonzero(picks & ~own)
        full = self.full(q, c)
        starts = np.searchsorted(q, np.arange(len(self.qids) + 1))
        return [sorted((int(x) for x in full[s:e]), reverse=True)[:k] for s, e in zip(starts, starts[1:], strict=False)]

    def collect(self, cutoffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phase 2: the entries with the uniform share of their query's cutoff in some slice. -inf: no cutoff is known."""
        share = cutoffs / self.slices
        if len(share) and np.isfinite(share).any():  # a share in doubles is never above the exact one
            share = share - np.where(np.isfinite(share), np.maximum(np.abs(share) * 1e-12, 1e-6), 0.0)
        some = np.zeros((len(self.qids), len(self.ids)), bool)
        for j in range(self.slices):
            part = self._part(j)
            size_q, size_c = (np.sqrt((x[:, part].astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) for x in (self.a, self.b))
            # the norm that a candidate needs for the query that asks least of it
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(share <= 0, 0.0, share / size_q)
            live = np.flatnonzero(size_c >= need.min(initial=np.inf))
            if len(live):
                some[:, live] |= self.local(j, live).astype(float) >= share[:, None]
        return np.nonzero(some & (self.qids[:, None] != self.ids[None, :]))

    def resolve(self, cutoffs: np.ndarray, k: int):
        """Phase 3: (query positions, candidate ids, scores): each query's k best of the collected entries, cutoff or above."""
        q, c = self.collect(cutoffs)
        score = self.full(q, c)
        least = cutoffs - np.where(np.abs(cutoffs) < 2.0**52, 0.0, np.where(np.isfinite(cutoffs), np.abs(cutoffs) * 1e-12, 0.0))
        good = score.astype(float) >= least[q]
        q, v, score = q[good], self.ids[c[good]], score[good]
        order = np.lexsort((v, -score, q)) if score.dtype == np.float64 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], v[i])), int)
        q, v, score = q[order], v[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], v[place < k], score[place < k]


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]  # the query's own id may be one
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _pairs(pdfs, slices):
    for pdf in pdfs:
        for row in pdf.to_dict("records"):
            queries, candidates = (np.frombuffer(row[v], "<i8").reshape(row[n], row["dim"]) for v, n in (("vals", "n"), ("cvals", "cn")))
            yield row, BlockPair(np.frombuffer(row["ids"], "<i8"), queries, np.frombuffer(row["cids"], "<i8"), candidates, slices)


def _phase_one(k, slices):
    def run(pdfs):
        import pandas as pd

        for _, pair in _pairs(pdfs, slices):
            yield pd.DataFrame({"query_id": pair.qids.astype("i8"), "scores": pair.gather(k)})

    return run


def _phase_two(k, slices):
    def run(pdfs):
        import pandas as pd

        for row, pair in _pairs(pdfs, slices):
            q, v, score = pair.resolve(np.frombuffer(row["cutoffs"], "<f8"), k)
            yield pd.DataFrame({"query_id": pair.qids[q].astype("i8"), "vec_id": v.astype("i8"), "score": score.astype("i8")})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, slices: int = SLICES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query, ties to the smaller id.

    `is_query` picks the queries by `id`; every other row is a candidate. Queries meet candidates in blocks: candidate
    blocks and query blocks are joined on a salt, so no task holds more than a block pair and no side is broadcast.
    Vectors null or holding null or non-finite components, and null ids, take no part; only vectors of the query's own dimension
    are compared. Rows that share the query's id count as the query's own; of several vectors under a query's id the smallest, component
    by component, asks. Rows repeated under one id each count as a candidate. An empty table gives no rows. Scores must fit a long.
    """
    rows = quantise(vectors, id_col, vec_col)
    chunks = _pack(rows, CHUNK).select("dim", F.col("n").alias("cn"), F.col("ids").alias("cids"), F.col("vals").alias("cvals"))
    chunks = cut(chunks.withColumn("salt", F.pmod(F.xxhash64("cids"), F.lit(1 << 20)).cast("int")))
    salts = max(1, min(chunks.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    chunks = chunks.withColumn("salt", F.col("salt") % salts)
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = cut(_pack(asked, QUERIES).withColumn("block", F.xxhash64("ids", "dim")))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    first = cut(chunks.join(blocks.select("*", spread), ["salt", "dim"]).mapInPandas(_phase_one(k, slices), "query_id long, scores array<long>"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"))
    cutoff = first.select("query_id", F.explode("scores").alias("s")).withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("s").cast("double").alias("cutoff"))
    # one cutoff for each query, packed as the query's block is
    ids = blocks.select("block", "ids").mapInPandas(_positions, "block long, at int, query_id long")
    packed = ids.join(cutoff, "query_id", "left").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("cutoff", F.lit(float("-inf"))).alias("c")))).alias("l")).select("block", F.transform("l", lambda x: x["c"]).alias("flat"))
    packed = cut(packed.mapInPandas(_to_bytes, "block long, cutoffs binary"))
    found = chunks.join(blocks.join(packed, "block").select("*", spread), ["salt", "dim"]).mapInPandas(_phase_two(k, slices), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _positions(pdfs):
    import pandas as pd

    for pdf in pdfs:
        for block, ids in zip(pdf["block"], pdf["ids"], strict=True):
            each = np.frombuffer(ids, "<i8")
            yield pd.DataFrame({"block": block, "at": np.arange(len(each)), "query_id": each})


def _to_bytes(pdfs):
    for pdf in pdfs:
        yield pdf.assign(cutoffs=[np.asarray(x, "<f8").tobytes() for x in pdf.pop("flat")])[["block", "cutoffs"]]


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""
