"""Centroid clustering over a VA-file: exact k-means rounds that read few-bit cells first.

Every vector is compressed to one cell of few bits per dimension.  For a round's
centroids, lookup tables hold what each cell of each dimension adds at least and
at most to a vector's distance from each centroid; the squared length of the
vector itself, which is the same for all of them, is left out, and both are
taken from the centroids' middle, so that intervals are narrow.  Where one
interval ends before all others begin, the vector is assigned by its cells
alone.  Full vectors are fetched only where intervals overlap, or where the
assignment changed and a centroid's sum must follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import dropped, named, written
from cutloom.llm.topk import finite

#: Whole components stand at this limit, so that every squared distance fits a long.
LIMIT = 2**27
#: Where the cells of a dimension lie, in standard deviations around its mean; the outer cells are closed by its extremes.
SPREAD = 2.5


class Cells:
    """The borders of every dimension's cells, and the tables of a round's centroids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, spread: np.ndarray, bits: int):
        inner = np.linspace(-SPREAD, SPREAD, (1 << bits) - 1)
        borders = np.floor(mean[:, None] + spread[:, None] * inner[None, :])
        self.borders = np.clip(borders, low[:, None], high[:, None]).astype("i8")  # a cell k holds borders[k - 1] <= x < borders[k]
        self.low = np.concatenate([low[:, None], self.borders], axis=1)
        self.high = np.concatenate([np.maximum(self.borders - 1, low[:, None]), high[:, None]], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cells of vectors, a byte for each component."""
        return np.stack([np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(self.borders)], axis=1).astype("u1")

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, dimension, cell): the least and the most of c * c - 2 x c, from the centroids' middle."""
        middle = np.floor_divide(centroids.sum(axis=0), len(centroids))
        c = (centroids - middle)[:, :, None]
        one, two = c * c - 2 * c * (self.low - middle[:, None])[None], c * c - 2 * c * (self.high - middle[:, None])[None]
        return np.minimum(one, two), np.maximum(one, two)


def candidates(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(vector, centroid): whether the centroid may be the nearest, by its interval."""
    low, high = tables
    at = np.arange(cells.shape[1])
    least = np.stack([t[at, cells].sum(axis=1) for t in low], axis=1)
    most = np.stack([t[at, cells].sum(axis=1) for t in high], axis=1)
    return least <= most.min(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width).astype(kind)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, width)


def _nearest(x: np.ndarray, centroids: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids that may be it, and the squared distance; ties go to the smaller number."""
    far = np.iinfo("i8").max
    found = np.full((len(x), len(centroids)), far, "i8")
    for k, c in enumerate(centroids):
        at = np.nonzero(may[:, k])[0]
        found[at, k] = ((x[at] - c) ** 2).sum(axis=1)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best]


def _bits(flags: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.packbits(flags, axis=1)]


def _flags(column: pa.Array, k: int) -> np.ndarray:
    return np.unpackbits(_bytes(column, -(-k // 8)), axis=1)[:, :k].astype(bool)


def _judged(state: DataFrame, cells: Cells, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, cells, old, new, may): new is -1 where intervals overlap."""
    tables, k = cells.tables(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                may = candidates(_bytes(s.column("cells"), width), tables)
                new = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1).astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [s.column("id"), s.column("cells"), s.column("cluster"), pa.array(new), pa.array(_bits(may), pa.binary())],
                    names=["id", "cells", "old", "new", "may"],
                )

    return state.mapInArrow(run, "id bigint, cells binary, old int, new int, may binary") if k else state


def _fetched(asked: DataFrame, full: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, cells, cluster, sums, n): assigned by full vectors; rows without id say how sums and counts of clusters change."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, moved = np.zeros((k, width), "i8"), np.zeros(k, "i8"), False
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                x, old = _matrix(s.column("v"), width, "i8"), np.asarray(s.column("old"))
                new, _ = _nearest(x, centroids, _flags(s.column("may"), k))
                for c in range(k):
                    to, away = (new == c) & (old != c), (old == c) & (new != c)
                    sums[c] += x[to].sum(axis=0) - x[away].sum(axis=0)
                    counts[c] += to.sum() - away.sum()
                moved |= bool((new != old).any())
                none = pa.nulls(len(new), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([s.column("id"), s.column("cells"), pa.array(new.astype("i4")), none, pa.nulls(len(new), pa.int64())], names=names)
        if moved:
            own = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype="i4"))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(counts)], names=names)

    names = ["id", "cells", "cluster", "sums", "n"]
    return asked.join(full.select("id", "v"), "id").mapInArrow(run, "id bigint, cells binary, cluster int, sums array<bigint>, n bigint")


def _totals(rows: DataFrame, k: int, width: int) -> tuple[list[list[int]], list[int]]:
    """Sums and counts per cluster: k times width numbers, whatever the table."""
    sums, counts = [[0] * width for _ in range(k)], [0] * k
    total = lambda x: F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0))
    by = rows.filter("id is null").groupBy("cluster")
    for r in by.agg(total(F.col("n")).alias("n"), F.array(*[total(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums")).collect():
        counts[r.cluster], sums[r.cluster] = int(r.n), [int(x) for x in r.sums]
    return sums, counts


def _judge_all(rows: DataFrame, cells: Cells, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, vec_id, cluster, distance), the candidates by cells and the distance by the full vector."""
    tables = cells.tables(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                may = candidates(_bytes(s.column("cells"), width), tables)
                new, far = _nearest(_matrix(s.column("v"), width, "i8"), centroids, may)
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), pa.array(new.astype("i4")), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "cells", "v").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    df: DataFrame, *, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, bits: int = 6,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Kept are vectors with exactly ``width`` components, none null or
    non-finite; each component x becomes floor(scale * x), at most
    :data:`LIMIT` either way.  The first centroids are the ``k`` kept vectors
    whose ids' digests are smallest (ties, of repeated ids: the smaller
    vector); rows without id are none, but are assigned as others.  In each round
    every vector goes to the nearest centroid, ties to the smaller number, and
    every centroid with vectors becomes their floored mean.  With fewer kept
    vectors there are fewer centroids; if none has an id, or the table is
    empty, there is no row.  Repeated rows count each; sums beyond 64 bits
    stand at the limit; other columns are ignored.

    The driver holds the centroids and the cells' borders alone.  ``bits`` (at
    most 8) changes how much is fetched, never the result.  A round's
    states are a written table and the one before is deleted.
    """
    x, n = named(vector), named(vec_id).cast("bigint")
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.lit(scale) * c.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    keep = F.coalesce(F.size(x) == width, F.lit(False)) & finite(x)
    full = df.filter(keep).select(n.alias("vec_id"), whole.alias("v")).withColumn("id", F.monotonically_increasing_id())
    full = written(full)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = full.filter("vec_id is not null").withColumn("digest", digest).orderBy("digest", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], "i8").reshape(-1, width)
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    if not first:
        return df.sparkSession.createDataFrame([], out)
    stats = full.agg(*[F.array(*[f(F.get("v", F.lit(j))).cast("double") for j in range(width)]) for f in (F.min, F.max, F.avg, F.stddev_pop)]).first()
    low, high, mean, spread = (np.array(s, "f8") for s in stats)
    cells = Cells(low.astype("i8"), high.astype("i8"), mean, spread, bits)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                rows = [r.tobytes() for r in cells.of(_matrix(s.column("v"), width, "i8"))]
                yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(rows, pa.binary()), pa.array(np.full(len(rows), -1, "i4"))], names=["id", "cells", "cluster"])

    state = written(full.select("id", "v").mapInArrow(compressed, "id bigint, cells binary, cluster int"))
    sums, counts = [[0] * width for _ in first], [0] * len(first)
    for _ in range(rounds):
        judged = written(_judged(state.filter("id is not null").select("id", "cells", "cluster"), cells, centroids, width))
        still = judged.filter("new = old and new >= 0").select("id", "cells", F.col("new").alias("cluster"))
        new = written(still.unionByName(_fetched(judged.filter("new != old or new < 0"), full, centroids, width), allowMissingColumns=True))
        dropped(state)
        dropped(judged)
        state = new
        more, changed = _totals(state, len(first), width)
        sums = [[a + b for a, b in zip(s, m, strict=True)] for s, m in zip(sums, more, strict=True)]
        counts = [a + b for a, b in zip(counts, changed, strict=True)]
        centroids = np.array([[a // n for a in s] if n else c.tolist() for s, n, c in zip(sums, counts, centroids, strict=True)], "i8")
    last = full.join(state.filter("id is not null").select("id", "cells"), "id")
    found = written(_judge_all(last, cells, centroids, width))
    dropped(state)
    dropped(full)
    most = 2**63 - 1
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [
        (int(c), min(d, most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
        for c, d in inertia.items()
    ]
    per = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    # At most k rows.
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
