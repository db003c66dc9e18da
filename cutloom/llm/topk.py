"""Exact top-k search by inner product, term at a time.

Candidates are dealt to blocks of bounded size.  In a block every dimension
(term) has a posting list; a query scatters its weight times each posting into
a dense score array, one term after another.  The k best of every block are
selected and merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192
CHUNK = 64


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


class Block:
    """Posting lists of one block; rows stand in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: list):
        self.ids = ids
        self.width = max(map(len, vectors), default=0)
        dense = np.zeros((self.width, len(ids)), "f8")
        for i, v in enumerate(vectors):
            dense[: len(v), i] = v
        self.largest = float(np.abs(dense).max(initial=0))
        self.postings = []
        for row in dense:
            at = np.nonzero(row)[0]
            self.postings.append((slice(None), row) if 2 * at.size > row.size else (at, row[at]))

    def best(self, queries: np.ndarray, vectors: list, k: int) -> Iterator[tuple[int, int, int]]:
        if not self.ids.size:
            return
        weights = np.zeros((len(vectors), max(self.width, max(map(len, vectors), default=0))), "f8")
        for i, v in enumerate(vectors):
            weights[i, : len(v)] = v
        exact = float(np.abs(weights).max(initial=0)) * self.largest * max(1, self.width) < 2**49
        scores = np.zeros((len(vectors), self.ids.size), "f8" if exact else object)
        for term, (at, values) in enumerate(self.postings):
            used = np.nonzero(weights[:, term])[0]
            if used.size == 0 or not values.size:
                continue
            w, p = weights[used, term], values
            if not exact:
                w, p = np.array([int(x) for x in w], object), np.array([int(x) for x in p], object)
            if isinstance(at, slice) and used.size == len(vectors):
                scores += np.multiply.outer(w, p)
            elif isinstance(at, slice):
                scores[used] += np.multiply.outer(w, p)
            else:
                scores[np.ix_(used, at)] += np.multiply.outer(w, p)
        if not exact:
            scores = np.clip(scores, -(2**63), 2**63 - 1)
        rows = self.ids.size
        for i, q in enumerate(queries.tolist()):
            others = np.nonzero(self.ids != q)[0]
            if exact:  # score and place as one number, so that the selection settles ties
                key = scores[i].astype("i8") * rows + (rows - 1 - np.arange(rows))
                key = key[others]
                top = others[np.argpartition(-key, k - 1)[:k]] if key.size > k else others
            else:
                top = np.array(sorted(others.tolist(), key=lambda r: (-scores[i, r], r))[:k], "i8")
            for r in top.tolist():
                yield q, int(self.ids[r]), int(scores[i, r])


def top_k(df: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows with the largest inner product for every query row: query_id, rank, vec_id, score.

    Components count as floor(scale * x); missing trailing components are 0.
    Ties go to the smaller id; a query never finds its own id; all rows are
    returned if there are fewer than ``k``.  Rows whose id or vector is null, or
    whose vector holds null or non-finite components, take no part; equal
    repeated rows count once.  Scores beyond 64 bits stand at the limit.

    Queries are sent to every block of :data:`BLOCK` candidates, where they
    stream past the block's postings; a task holds one block and
    :data:`CHUNK` score arrays, and the merge gets k rows per query and block.
    """
    x = F.col(vector)
    rows = df.filter(F.col(vec_id).isNotNull() & finite(x)).select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    blocks = max(1, -(-df.select(vec_id).count() // BLOCK))
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.filter("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def run(batches):
        at, ids, vectors, block, pending = None, [], [], None, []

        def answered():
            nonlocal pending
            found = list(block.best(np.array([q for q, _ in pending]), [v for _, v in pending], k)) if pending else []
            pending = []
            cols = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        for b in batches:
            for place, kind, i, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if place != at:
                    if pending:
                        yield answered()
                    at, ids, vectors, block = place, [], [], None
                if kind == 0:
                    if not (ids and ids[-1] == i and vectors[-1] == v):
                        ids.append(i)
                        vectors.append(v)
                    continue
                if block is None:
                    block = Block(np.array(ids, "i8"), vectors)
                    vectors = []
                if not (pending and pending[-1] == (i, v)):
                    pending.append((i, v))
                if len(pending) == CHUNK:
                    yield answered()
        if pending:
            yield answered()

    dealt = own.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "id", "v")
    best = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
