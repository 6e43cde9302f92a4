"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors are quantised to integers. For each dimension a block of candidates has one list sorted by
that component, made once; a query reads it from the top where its own component is positive and from the
bottom where it is negative, and leaves it out where it is zero. Each round reads the next ``1 / ROUNDS`` of every list, entry by entry: an
entry adds its product to its candidate's lower bound, which counts the list's last value for what is unread, and marks
the list as read for that candidate. The upper bound counts the values read last for what is unread. A candidate is
set aside once its upper bound is below the k-th lower bound; bounds that set nothing aside are compared less often, every
fourth round at least. A query stops when at most ``FEW`` x k candidates are left, whose final
scores are then resolved, or when the lists are read to their ends, where every lower bound is the score. ``endings`` tells
how each query ended. Lower bounds are sums of integers below 2^53, hence exact.

Queries are a stated set compared with all rows in blocks: candidates and queries are dealt into
blocks of bounded size, each pair of blocks is one group of bounded size, and only k rows per query
and block are kept for the final merge.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows with a
null id, take no part; a query is compared with vectors of its own length; rows with the query's id
count as the query's own row; ties go to the smaller id; rows that repeat an id are candidates each, and queries each,
with ranks of their own; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
ROUNDS, LEAST_STEP = 20, 32
FEW = 4
_BATCH = 64
_OUT = "query_id long, _n long, vec_id long, score long, read long, entries long, by_bound boolean"


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs; null unless all components are finite."""
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


@dataclass(frozen=True)
class Answer:
    """places and scores of a query's best candidates, list entries read of how many there are, and whether bounds ended the reading."""

    places: np.ndarray
    scores: np.ndarray
    read: int
    entries: int
    by_bound: bool


class Lists:
    """The candidates of one block, one descending list per dimension: candidates' places and values."""

    def __init__(self, cand: np.ndarray, ids: np.ndarray):
        self.ids, self.cand = ids, cand.astype(float)
        order = np.argsort(-cand, axis=0, kind="stable")
        self.order, self.value = np.ascontiguousarray(order.T), np.ascontiguousarray(np.take_along_axis(self.cand, order, axis=0).T)

    def search(self, query: np.ndarray, own: np.ndarray, k: int) -> list[Answer]:
        """The k best candidates of each query but those of its ``own`` id. The queries read the lists together, each from its own
        end, and stop singly."""
        (dims, n), q = self.value.shape, query.astype(float)
        alive = own[:, None] != self.ids[None, :]
        if not n or not np.any(query):
            return [self._answer(query[i], np.flatnonzero(alive[i]), None, k, 0, False) for i in range(len(query))]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        over, under = self.value - self.value[:, -1:], self.value - self.value[:, :1]  # an entry's value beyond its list's other end
        low = np.repeat((up @ self.value[:, -1] + down @ self.value[:, 0])[:, None], n, axis=1)
        unread_top, unread_end, rows = np.ones((dims, n), np.float32), np.ones((dims, n), np.float32), np.arange(dims)[:, None]
        #: covers the rounding of the upper bounds, which are sums of 32-bit products
        slack = 8 * dims * float(np.finfo(np.float32).eps) * np.abs(q).sum(1) * float(np.abs(self.value).max(initial=0))
        out: list[Answer | None] = [None] * len(query)
        active, depth, step, wait, every = np.arange(len(query)), 0, max(LEAST_STEP, -(-n // ROUNDS)), 0, 1
        while len(active):
            counts = alive.sum(1)
            for i in np.flatnonzero((counts <= FEW * k) | (depth >= n)).tolist():
                out[active[i]] = self._answer(query[active[i]], np.flatnonzero(alive[i]), low[i], k, depth, depth < n)
            stay = np.flatnonzero((counts > FEW * k) & (depth < n))
            if len(stay) < len(active):
                active, low, alive, up, down, slack = active[stay], low[stay], alive[stay], up[stay], down[stay], slack[stay]
            if not len(active):
                break
            was, tops, ends = alive.sum(), [np.flatnonzero(x) for x in up], [np.flatnonzero(x) for x in down]
            while depth < n:
                done, depth = depth, min(n, depth + step)
                first, last = self.order[:, done:depth], self.order[:, n - depth : n - done]
                gain, gain_end = over[:, done:depth], under[:, n - depth : n - done]
                for i, (t, e) in enumerate(zip(tops, ends, strict=True)):
                    at = np.concatenate((first[t].ravel(), last[e].ravel()))
                    low[i] += np.bincount(at, np.concatenate(((gain[t] * up[i, t, None]).ravel(), (gain_end[e] * down[i, e, None]).ravel())), n)
                unread_top[rows, first] = 0
                unread_end[rows, last] = 0
                wait += 1
                if wait >= every:
                    break
            wait = 0
            if depth < n:
                high = low + (up * over[:, depth - 1]).astype(np.float32) @ unread_top + (down * under[:, n - depth]).astype(np.float32) @ unread_end
                if n > k:
                    alive &= high >= np.partition(np.where(alive, low, -np.inf), n - k)[:, n - k, None] - slack[:, None]
                every = 1 if alive.sum() < 0.9 * was else min(4, 2 * every)  # bounds that set nothing aside are looked at less often
        return out

    def _answer(self, query: np.ndarray, left: np.ndarray, low: np.ndarray | None, k: int, depth: int, by_bound: bool) -> Answer:
        """The final scores of the candidates left: resolved if few are, else their lower bounds, which are the scores at the lists' ends."""
        score = self.cand[left] @ query.astype(float) if by_bound or low is None else low[left]
        if len(left) > k:  # ties at the k-th score stay
            held = score >= np.partition(score, len(score) - k)[len(score) - k]
            left, score = left[held], score[held]
        best, lists = np.lexsort((self.ids[left], -score))[:k], int(np.count_nonzero(query))
        return Answer(left[best], score[best].astype(np.int64), depth * lists, len(self.ids) * lists, by_bound)


def search_block(cand: np.ndarray, cand_ids: np.ndarray, query: np.ndarray, query_ids: np.ndarray, k: int) -> list[Answer]:
    """The answer of one block to each query, from lists that are sorted once."""
    lists = Lists(cand, cand_ids)
    return [a for at in range(0, len(query), _BATCH) for a in lists.search(query[at : at + _BATCH], query_ids[at : at + _BATCH], k)]


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _answers(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, block: int) -> DataFrame:
    """The k best of each query in each block, with what was read there."""
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    rows = rows.filter(F.col("_v").isNotNull()).withColumn("_dim", F.size("_v"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_q").alias("q")).first()
    cand_blocks, query_blocks = max(1, math.ceil(total["n"] / block)), max(1, math.ceil(total["q"] / block))
    spread = F.xxhash64("vec_id", "_v")
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    cands = rows.select("_dim", F.pmod(spread, F.lit(cand_blocks)).alias("_cb"), F.explode(_numbers(query_blocks)).alias("_qb"), F.lit(False).alias("_q"), "_n", "vec_id", "_v")
    asks = rows.filter("_q").select("_dim", F.explode(_numbers(cand_blocks)).alias("_cb"), F.pmod(spread, F.lit(query_blocks)).alias("_qb"), F.lit(True).alias("_q"), "_n", "vec_id", "_v")
    names = [x.split()[0] for x in _OUT.split(", ")]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["_q"].to_numpy(bool)
        if not asked.any() or asked.all():
            return pd.DataFrame({c: pd.Series(dtype=bool if c == "by_bound" else "int64") for c in names})
        ids, numbers, vecs = pdf["vec_id"].to_numpy(np.int64), pdf["_n"].to_numpy(np.int64)[asked], np.stack(pdf["_v"].to_numpy()).astype(np.int64)
        found = search_block(vecs[~asked], ids[~asked], vecs[asked], ids[asked], k)
        of = np.repeat(np.arange(len(found)), [len(a.places) for a in found])
        told = {c: np.array([getattr(a, c) for a in found])[of] for c in ("read", "entries", "by_bound")}
        places, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([a.places for a in found], [a.scores for a in found]))
        return pd.DataFrame({"query_id": ids[asked][of], "_n": numbers[of], "vec_id": ids[~asked][places], "score": scores, **told})[names]

    return cands.unionByName(asks).groupBy("_dim", "_cb", "_qb").applyInPandas(kernel, _OUT)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows by inner product of quantised vectors."""
    best = _answers(vectors, is_query, k, id_col, vector_col, scale, block)
    order = Window.partitionBy("query_id", "_n").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def endings(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """by_bound, n, share_read: searches of a query in a block that bounds ended, and those that read the lists to their ends."""
    each = _answers(vectors, is_query, k, id_col, vector_col, scale, block).withColumn("_best", F.row_number().over(Window.partitionBy("_n", "query_id", "read", "entries", "by_bound").orderBy("vec_id")))
    return each.filter("_best = 1").groupBy("by_bound").agg(F.count(F.lit(1)).alias("n"), (F.sum("read") / F.sum("entries")).alias("share_read"))
