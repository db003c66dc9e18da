"""Near-duplicate vectors: quantised tile products with rigorous error bounds.

Equal vectors are one class.  The classes of a label are dealt to tiles of
bounded size, and every pair of tiles is one cell.  In a cell the unit vectors
x are quantised to whole numbers of 8 bits, x = s q + e, and the product of
the quantised tiles bounds every cosine:

    |x.y - s q . t p| <= |s q| |f| + |e| |t p| + |e| |f|

where e and f are the measured quantisation errors.  Only pairs that the bound
cannot rule out are computed again in double precision.  A cell returns counts
and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import components, named, salted, written
from cutloom.llm.topk import finite

TILE = 1024
#: So many labels are broadcast as they are.
FEW = 10_000


class Tile:
    def __init__(self, ids: list[int], copies: list[int], vectors: list):
        self.ids, self.copies = np.array(ids, "i8"), np.array(copies, "i8")
        self.x = np.array(vectors, "f8")
        with np.errstate(over="ignore"):
            self.x = self.x / np.abs(self.x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        unit = self.x / self.norm[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / scale[:, None])
        back = self.q * scale[:, None]
        self.error = np.sqrt(((unit - back) ** 2).sum(axis=1))
        self.size = np.sqrt((back**2).sum(axis=1))
        self.scale = scale

    def possible(self, other: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        # Whole numbers below 2**24 even summed, so single precision is exact here.
        exact = np.float32 if self.q.shape[1] * 127 * 127 < 2**24 else np.float64
        product = (self.q.astype(exact) @ other.q.astype(exact).T).astype("f8")
        product *= self.scale[:, None] * other.scale[None, :]
        product += np.multiply.outer(self.size, other.error) + np.multiply.outer(self.error, other.size + other.error)
        return np.nonzero(product >= threshold - 1e-9)

    def links(self, other: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.possible(other, threshold)
        keep = np.zeros(a.size, bool)
        for i in range(0, a.size, 1 << 15):
            u, v = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            keep[i : i + (1 << 15)] = np.einsum("ij,ij->i", self.x[u], other.x[v]) / (self.norm[u] * other.norm[v]) >= threshold
        return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with links a-b: the smallest node that each reaches."""
    low = np.arange(n)
    while a.size:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new
    return low


def _cell(one: Tile, two: Tile | None, threshold: float) -> Iterator[tuple]:
    """(id, linked id or None, vectors linked) of a cell's linked classes."""
    if two is None:
        a, b = one.links(one, threshold)
        a, b = a[a < b], b[a < b]
        ids, copies = one.ids, one.copies
    else:
        a, b = one.links(two, threshold)
        ids, copies, b = np.concatenate([one.ids, two.ids]), np.concatenate([one.copies, two.copies]), b + one.ids.size
    if not a.size:
        return
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(order.size)
    low = order[forest(ids.size, place[a], place[b])][place]
    links = np.zeros(ids.size, "i8")
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    for i in np.nonzero(links)[0].tolist():
        yield int(ids[i]), int(ids[low[i]]) if low[i] != i else None, int(links[i])


def near_duplicates(df: DataFrame, *, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and their
    cosine in double precision is at least ``threshold``.  Vectors that are
    null, zero, or hold null or non-finite components, rows without label or
    id, and vectors of different lengths link with nothing; equal vectors
    (repeated rows, too) always link.  A row that links with nothing is its own
    component.  Rows of one vec_id with other vectors are vectors of their own,
    with the same name.  Other columns are ignored.

    A cell holds two tiles of about :data:`TILE` vectors, whatever the size of
    a label; a hot label is many cells.  Links among copies are counted, not listed.
    """
    x = named(vector)
    rows = df.select(named(vec_id).cast("bigint").alias("vec_id"), named(label).alias("label"), x.alias("v"))
    ok = finite(F.col("v")) & F.exists("v", lambda c: c != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plain = F.transform("v", lambda c: c.cast("double") + F.lit(0.0))
    # Equal vectors of a label have one key of 128 bits.
    key = F.when(F.coalesce(ok, F.lit(False)), F.unhex(F.md5(F.to_json(F.struct(F.col("label"), plain.alias("v"))))))
    rows = written(rows.withColumn("key", key))
    classes = written(
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first(plain).alias("v"))
        .withColumns({"id": F.monotonically_increasing_id(), "at": F.struct("label", F.size("v").alias("width"))})
    )
    # One row per label and width; where they are many, a hot label's classes are dealt to parts for the join.
    many = written(classes.groupBy("at").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    dealt = (
        (classes.join(F.broadcast(many), "at") if many.count() <= FEW else salted(classes, many, "at"))
        .withColumn("width", F.col("at.width"))
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
        .select("label", "width", "a", "b", "tile", "id", "copies", "v")
    )
    cell = ["label", "width", "a", "b"]

    def run(batches):
        at, tiles = None, {}

        def done():
            parts = [Tile(*t) for _, t in sorted(tiles.items())]
            found = []
            if at and at[2] == at[3]:
                found = list(_cell(parts[0], None, threshold))
            elif len(parts) == 2:
                found = list(_cell(parts[0], parts[1], threshold))
            cols = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "other", "links"])

        for b in batches:
            names = b.schema.names
            cols = {n: b.column(n).to_pylist() for n in names if n != "v"}
            values = b.column("v").to_pylist()
            for place, tile, i, copies, v in zip(zip(*[cols[c] for c in cell], strict=True), cols["tile"], cols["id"], cols["copies"], values, strict=True):
                if place != at:
                    if tiles:
                        yield done()
                    at, tiles = place, {}
                t = tiles.setdefault(tile, ([], [], []))
                t[0].append(i)
                t[1].append(copies)
                t[2].append(v)
        if tiles:
            yield done()

    found = written(dealt.repartition(*cell).sortWithinPartitions(*cell, "tile", "id").mapInArrow(run, "id bigint, other bigint, links bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    own = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = written(own.join(links, "id", "left").select("key", "component", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per = salted(own, own.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("key", "n_links", "component_id")
    return (
        rows.select("vec_id", "key")
        .join(per, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
