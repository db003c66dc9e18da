"""Packing of token streams into fixed-length sequences, online and in bounded space.

Each partition keeps a fixed number of open windows.  A document goes to the
window it fits best; when it fits none and all windows are in use, the fullest
one is topped up with the document's head and emitted, so emitted windows have
no padding.  What is still open when a partition ends goes, with its ids, to a
merge over a bounded number of neighbouring partitions: the fullest windows are
filled up from the emptiest, and the last remainder is cut into power-of-two
sequences, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.chunks import Table, latin_rest
from cutloom.llm.common import named, slices, written

# Fixed value: how vocabularies of this kind split lower-case text; here for ASCII and the letters of Latin-1.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+"
#: Partitions whose open windows are merged together.
NEIGHBOURS = 16

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    Texts of Latin letters fall into the pieces that the vocabulary's own rules
    make, which repeat a lot; other texts go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Without the rules on letter case and splitting, which leave lower-case words as they are.
        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces, self.word = re.compile(PIECE).findall, re.compile(f"[{LETTERS}]+").fullmatch
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Table(self._learn, ("u4",))

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), 4096) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        word = [bool(self.word(x)) for x in new]
        plain = iter(self._ids([x for x, ok in zip(new, word, strict=True) if ok], self.bare))
        rest = iter(self._ids([x for x, ok in zip(new, word, strict=True) if not ok]))
        out = [next(plain) if ok else next(rest) for ok in word]
        size = np.fromiter(map(len, out), "i8", len(out))
        return [(np.fromiter(chain.from_iterable(out), "u4", int(size.sum())), size)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        odd = [bool(latin_rest(t)) or any(m in t for m in self.marks) for t in texts]
        split = [[] if o else self.pieces(t.lower()) for t, o in zip(texts, odd, strict=True)]
        values, ends = self.known.flat[0].gather(self.known.places(split))
        data = values.astype("<u4", copy=False).tobytes()
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])].tolist()
        for t, o, a, b in zip(texts, odd, ends, ends[1:], strict=False):
            yield np.array(self._ids([t])[0], "<u4").tobytes() if o else data[4 * a : 4 * b]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """The open windows of one partition; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[list] = []  # [fill, pieces]

    def add(self, doc_id, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> Iterator[list]:
        """Places a document; yields the piece lists of windows that are full."""
        n = len(ids) // 4
        doc_tokens = n if doc_tokens is None else doc_tokens
        at = 0
        while n - at >= self.length:
            yield [(doc_id, start + at, ids[4 * at : 4 * (at + self.length)], doc_tokens)]
            at += self.length
        while at < n:
            need = n - at
            fits = [w for w in self.open if w[0] + need <= self.length]
            if fits:
                best = max(fits, key=lambda w: w[0])
                take = need
            elif len(self.open) < self.most:
                best, take = [0, []], need
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                take = self.length - best[0]
            best[1].append((doc_id, start + at, ids[4 * at : 4 * (at + take)], doc_tokens))
            best[0] += take
            at += take
            if best[0] == self.length:
                self.open.remove(best)
                yield best[1]


def poured(windows: list[list], length: int) -> Iterator[list]:
    """Merges partly filled windows [fill, pieces]: the fullest are filled up from the emptiest."""
    windows = sorted(windows, key=lambda w: -w[0])
    while windows:
        fill, pieces = windows.pop(0)
        while fill < length and windows:
            doc_id, start, ids, total = windows[-1][1].pop()
            take = min(length - fill, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * take], total))
            fill += take
            if take < len(ids) // 4:
                windows[-1][1].append((doc_id, start + take, ids[4 * take :], total))
            windows[-1][0] -= take
            if not windows[-1][1]:
                windows.pop()
        if fill == length:
            yield pieces
            continue
        while pieces:  # the last remainder: powers of two, the largest first
            size, sequence = 1 << (fill.bit_length() - 1), []
            fill -= size
            while size:
                doc_id, start, ids, total = pieces.pop(0)
                take = min(size, len(ids) // 4)
                sequence.append((doc_id, start, ids[: 4 * take], total))
                size -= take
                if take < len(ids) // 4:
                    pieces.insert(0, (doc_id, start + take, ids[4 * take :], total))
            yield sequence


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64())]
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint"


class _Rows:
    def __init__(self):
        self.rows: list[tuple] = []

    def sequence(self, pieces: list, sequence_id: int | None, window: int | None = None) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, sequence_id, offset, window))
            offset += n

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def pack(
    df: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id", length: int = 4096, end_id: int = 2, open_windows: int = 32
) -> DataFrame:
    """Packs all texts; one row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian 32-bit numbers; every document's ids end with
    ``end_id``, so empty and null texts give one id.  Each id is in exactly one
    piece, pieces of a sequence are gapless from offset 0, and sequences have
    ``length`` ids or a power of two.  A null doc_id is kept as null, repeated
    rows are packed each; other columns are ignored.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        enc, windows, out, n = encoder(vocabulary), Windows(length, open_windows), _Rows(), 0
        end = np.array([end_id], "<u4").tobytes()
        for s in slices(batches):
            for d, ids in zip(s.column(0).to_pylist(), enc.encode_all(s.column(1).to_pylist()), strict=True):
                for pieces in windows.add(d, ids + end):
                    out.sequence(pieces, part << 32 | n)
                    n += 1
            if out.rows:
                yield out.batch()
        enc.known.forget()
        for i, (_, pieces) in enumerate(windows.open):
            out.sequence(pieces, None, part * open_windows + i)
        yield out.batch()

    def merge(tables: pa.Table) -> pa.Table:
        rows = sorted(tables.to_pylist(), key=lambda r: (r["window"], r["offset"]))
        windows: dict[int, list] = {}
        for r in rows:
            w = windows.setdefault(r["window"], [0, []])
            w[0] += r["length"]
            w[1].append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        group = rows[0]["window"] // (open_windows * NEIGHBOURS)
        out = _Rows()
        for n, pieces in enumerate(poured(list(windows.values()), length)):
            out.sequence(pieces, 1 << 62 | group << 32 | n)
        return pa.Table.from_batches([out.batch()])

    texts = df.select(named(doc_id).cast("bigint").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    rows = written(texts.mapInArrow(run, SCHEMA))
    left = rows.filter("sequence_id is null").withColumn("_group", F.floor(F.col("window") / (open_windows * NEIGHBOURS)))
    merged = left.groupBy("_group").applyInArrow(lambda t: merge(t.drop_columns(["_group"])), SCHEMA)
    return rows.filter("sequence_id is not null").unionByName(merged).drop("window")
