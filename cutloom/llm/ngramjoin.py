"""Near-duplicate texts: word n-gram Jaccard join by a MinHash LSH forest.

Every text's shingles are min-hashed into several trees, each a short sequence
of minima.  A tree's sequences are the leaves of a prefix trie; texts under one
node are candidates.  The first nodes are those at full depth, which is chosen
so that a pair at the threshold meets in some tree with high probability.
Candidates are verified on their exact shingle sets.  From the similarities
found follows how many links of each similarity were missed; while the share
found is below the target recall, prefixes are shortened, and the pairs that
first meet under the shorter ones are verified, too.

Texts with the same words are one class.  Classes that share nodes, directly
or through others, are one group; a group is cut into tiles of bounded size,
and each pair of tiles is a cell, where pairs that share a node are verified.
A cell returns counts and a spanning forest, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.cells import dealt, linked, run_cells
from cutloom.llm.common import components, named, salted, slices, written
from cutloom.llm.shingles import mixed, shingle_hashes, word_hashes

TREES, DEPTH, RECALL = 20, 8, 0.995
#: The share of all links that must be found before prefixes are no longer shortened.
TARGET = 0.999
#: Similarities are counted in this many bins.
BINS = 1000
#: A tile holds about this many texts, and shingles.
TILE, TILE_SHINGLES = 256, 250_000


def depth_for(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from ``depth``, under which a pair at the threshold meets with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def sequences(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each tree its ``depth`` minima, as big-endian bytes, so that they sort like their prefixes."""
    factors = mixed(np.arange(1, trees * depth + 1, dtype="u8")) | np.uint64(1)
    low = np.full(trees * depth, np.iinfo("u8").max, "u8")
    for i in range(0, shingles.size, 1024):
        low = np.minimum(low, (shingles[None, i : i + 1024] * factors[:, None]).min(axis=1))
    return (mixed(low) >> np.uint64(32)).astype(">u4").reshape(trees, depth)


def met(similarity: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """How likely pairs share a node at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(found: np.ndarray, trees: int, depth: int, recall: float) -> int:
    """The depth under which the target recall is met, judged by the links found so far at ``depth``, by similarity.

    Every link found stands for 1 / (its probability of being found) links.
    """
    similarity = (np.arange(found.size) + 0.5) / found.size
    there = found > 0
    if not there.any():
        return depth
    likely = found[there] / met(similarity[there], trees, depth)
    while depth > 1 and (likely * met(similarity[there], trees, depth)).sum() < recall * likely.sum():
        depth -= 1
    return depth


def _meet(trees: np.ndarray, depth: int) -> np.ndarray:
    """Which texts share a node at this depth, as a matrix."""
    out = np.zeros((len(trees), len(trees)), bool)
    for t in range(trees.shape[1]):
        node = np.unique(np.ascontiguousarray(trees[:, t, : 4 * depth]).view(f"V{4 * depth}").ravel(), return_inverse=True)[1]
        out |= node[:, None] == node[None, :]
    return out


def _verified(rows: list[dict], same: bool, threshold: float, depth: int, before: int | None) -> Iterator[tuple]:
    """Links of a cell's texts that share a node at ``depth``, but none at the depth compared before."""
    unique = {(r["tile"], r["id"]): r for r in rows}
    rows = list(unique.values())
    tiles = np.array([r["tile"] for r in rows])
    if len(rows) < 2 or (not same and (tiles == tiles[0]).all()):
        return
    size = np.array([len(r["shingles"]) for r in rows])
    trees = np.frombuffer(b"".join([x for r in rows for x in r["trees"]]), "u1").reshape(len(rows), len(rows[0]["trees"]), -1)
    meet = _meet(trees, depth)
    if before is not None:
        meet &= ~_meet(trees, before)
    a, b = np.nonzero(np.triu(meet, 1) if same else np.triu(meet, 1) & (tiles[:, None] != tiles[None, :]))
    fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[fits], b[fits]
    if not a.size:
        return
    used = np.unique(np.concatenate([a, b]))
    where = np.concatenate([np.full(size[i], k) for k, i in enumerate(used)])
    values, column, often = np.unique(np.concatenate([rows[i]["shingles"] for i in used]), return_inverse=True, return_counts=True)
    shared = np.nonzero(often > 1)[0]
    new = np.full(values.size, -1)
    new[shared] = np.arange(shared.size)
    column = new[column]
    both = np.zeros((used.size, used.size), "f4")
    step = max(256, (1 << 22) // used.size)
    order = np.argsort(column, kind="stable")
    column, where = column[order], where[order]
    for start in range(0, shared.size, step):
        x, y = np.searchsorted(column, [start, start + step])
        block = np.zeros((used.size, min(step, shared.size - start)), "f4")
        block[where[x:y], column[x:y] - start] = 1
        both += block @ block.T
    back = np.full(len(rows), -1)
    back[used] = np.arange(used.size)
    common = both[back[a], back[b]].astype("f8")
    good = common >= threshold * (size[a] + size[b] - common) - 1e-9
    similarity = common[good] / (size[a] + size[b] - common)[good]
    for i, n in zip(*np.unique(np.minimum(BINS - 1, (similarity * BINS).astype(int)), return_counts=True), strict=True):
        yield None, None, int(n), int(i)
    yield from linked(np.array([r["id"] for r in rows], "i8"), np.array([r["copies"] for r in rows], "i8"), a[good], b[good])


def near_duplicates(
    df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = 5, threshold: float = 0.8, trees: int = TREES, recall: float = TARGET
) -> DataFrame:
    """One row per document: doc_id, copy_of, class_id, n_links, text_md5, class_no.

    Two documents are linked if the Jaccard similarity of their sets of n-word
    shingles is at least ``threshold`` (words: lower-cased runs of letters and
    digits; a text of fewer than n words is one shingle).  ``copy_of`` is the
    smallest id with the same words, ``class_id`` the smallest id reachable by
    links, ``n_links`` the number of documents linked directly, copies included.
    Texts that are null, empty or without words, and rows without id, link with
    nothing and are their own class.  Equal ids are separate documents of equal
    name: ``text_md5``, of the text with null as empty, tells them apart, and
    ``class_no``, null where nothing can link, their classes.  Other columns are
    ignored.
    """
    full = depth_for(threshold, trees)
    texts = df.select(named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    digested = texts.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))

    def sign(batches):
        for s in slices(batches):
            names, sizes, found = [], [], []
            for t in s.column(1).to_pylist():
                words = word_hashes(t)
                shingles = np.unique(shingle_hashes(words, n))
                names.append(xxhash.xxh3_128_digest(words.tobytes()) if words.size else None)
                sizes.append(shingles.size)
                found.append(sequences(shingles, trees, full) if shingles.size else np.zeros((0, full), ">u4"))
            offsets = np.cumsum([0, *map(len, found)]).astype("i4")
            data = np.concatenate(found)
            bounds = (np.arange(len(data) + 1) * 4 * full).astype("i4")
            leaves = pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [s.column(0), s.column(2), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), leaves)],
                names=["doc_id", "text_md5", "words", "size", "trees"],
            )

    signed = written(digested.mapInArrow(sign, "doc_id bigint, text_md5 string, words binary, size bigint, trees array<binary>"))
    # Classes are named by number, as different texts may have equal ids.
    classes = written(
        signed.filter("words is not null and doc_id is not null")
        .groupBy("words")
        .agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("trees").alias("trees"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    kept = ["grp", "id", "copies", "trees", "tiles"]

    def shingled(batches):
        for s in slices(batches, 64):
            words = [word_hashes(t) for t in s.column("text").to_pylist()]
            right = [bool(w.size) and xxhash.xxh3_128_digest(w.tobytes()) == k for w, k in zip(words, s.column("words").to_pylist(), strict=True)]
            sets = [np.unique(shingle_hashes(w, n)).view("i8") if ok else np.zeros(0, "i8") for w, ok in zip(words, right, strict=True)]
            offsets = np.cumsum([0, *map(len, sets)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            out = pa.RecordBatch.from_arrays([*[s.column(c) for c in kept], lists], names=[*kept, "shingles"])
            yield out.filter(pa.array(right))

    def compared(depth: int, before: int | None) -> DataFrame:
        """(id, other, links, bin) of the pairs that meet at ``depth``, but not at the depth before."""
        leaf, child = F.col("leaf.col"), F.substring("leaf.col", 1, 4 * (before or full))
        under = classes.select("id", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(trees)).alias("tree"), F.col("trees").alias("col"))).alias("leaf"))
        under = under.select("id", F.col("leaf.tree").alias("tree"), F.substring(leaf, 1, 4 * depth).alias("node"), child.alias("child"))
        nodes = under.groupBy("tree", "node").agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("child") < F.max("child")).alias("forks"))
        nodes = nodes.filter((F.col("low") < F.col("high")) & (F.lit(before is None) | F.col("forks"))).select("tree", "node", "low")
        edges = under.join(nodes, ["tree", "node"]).filter("id > low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()
        groups = components(edges).select(F.col("node").alias("id"), F.col("component").alias("grp"))
        members = written(classes.join(groups, "id"))
        tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int")
        members = salted(members, members.groupBy("grp").agg(tiles.alias("tiles")), "grp")
        own = members.withColumnRenamed("low", "doc_id").join(texts, "doc_id").select(*kept, "words", "text")
        sets = own.mapInArrow(shingled, "grp bigint, id bigint, copies bigint, trees array<binary>, tiles int, shingles array<bigint>")
        check = lambda rows, same: _verified(rows, same, threshold, depth, before)
        return written(dealt(sets).mapInArrow(lambda b: run_cells(b, check), "id bigint, other bigint, links bigint, bin bigint"))

    depth, before, found = full, None, None
    while before != depth:
        new = compared(depth, before)
        found = new if found is None else found.unionByName(new)
        counts = np.zeros(BINS)
        for r in found.filter("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # BINS rows at most
            counts[r["bin"]] = r["n"]
        before, depth = depth, shortened(counts, trees, depth, recall)
    links = found.filter("bin is null").groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    own = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = written(own.join(links, "id", "left").select("words", "component", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per = salted(own, own.groupBy("component").agg(F.min("low").alias("class_id")), "component").withColumnRenamed("low", "copy_of")
    rows = signed.select("doc_id", "text_md5", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words"))
    return rows.join(per, "words", "left").select(
        "doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_md5", F.col("component").alias("class_no")
    )
