"""Byte-level BPE by a tokenization automaton, and back.

The merges of a vocabulary file are compiled, one merge gadget after another,
into a deterministic automaton over tokens that accepts exactly the token
sequences BPE produces.  It starts as one state with a loop per byte.  The
gadget of the merge (a, b) -> c sends a's arcs to a copy of their target
without its b arc, and adds next to every a arc a c arc to the place where b
led.  A state's b arc therefore only ever disappears by a gadget, and a c arc
exists exactly where the a arc existed when c was made; this is all the table
has to keep (a few numbers per merge), instead of states x tokens entries.

A pre-split word is encoded by running the automaton over the word's
positions: every prefix has exactly one accepted sequence, so one transition
look-up per (position, token that ends there) decides its last arc.  Decoding
emits the bytes on the arcs.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm.chunks import Table, latin_rest
from cutloom.llm.common import mapped, named, slices

# Fixed value: how byte-level vocabularies split text before merging; here for ASCII and the letters of Latin-1.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+"
#: Longer words, in bytes, are encoded one by one; places that a group of words takes at once.
LONG, CELLS = 48, 1 << 20
#: The table of known arcs has 2 ** ARC_BITS slots of 9 bytes.
ARC_BITS = 21


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if printable, else the next free code."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Hashed:
    """Whole numbers by whole numbers in open addressing, looked up many at a time; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * keys.size).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, "i8"), np.full(1 << self.bits, -1, "i8")
        slot = self._slot(keys)
        while keys.size:
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.value[slot[first]] = keys[first], values[first]
            left = np.ones(keys.size, bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype("i8")

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.value[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[open_]
        while open_.size:
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.key[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.value[slot[hit]]
            more = ~hit & (there >= 0)
            open_, slot = open_[more], slot[more]
        return out


class TokenAutomaton:
    """Deterministic automaton of all BPE token sequences of one vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        code = byte_of_char()
        self.label = {i: bytes(code[c] for c in t) for t, i in vocabulary.items()}
        self.of = {b: i for i, b in self.label.items()}
        self.longest = max(map(len, self.of))
        self.special = special or {}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        self.target: dict[int, int] = {i: 0 for b, i in self.of.items() if len(b) == 1}
        self.shared = {0: len(self.target)}  # arcs' tokens that lead to a state
        self.parent = [-1]  # the state that a state is a copy of
        self.copied = [0]  # and when
        self.gone: dict[tuple[int, int], int] = {}  # (state, token) -> the merge that took the arc away
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for when, (a, b) in enumerate(merges, 1):
            self._gadget(when, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self.starts = np.zeros(max(self.label) + 1, "i8")  # where a token's arc leads
        self.starts[list(self.target)] = list(self.target.values())
        self._compile_trie()
        self.arc_key, self.arc_ok = np.full(1 << ARC_BITS, -1, "i8"), np.zeros(1 << ARC_BITS, bool)

    def _gadget(self, when: int, a: int, b: int, c: int) -> None:
        onward, hit = self.target[b], self.target[a]
        if c in self.target:  # a second way to the same token: both arcs lead on alike
            self.gone.setdefault((self._own(a, hit, when), b), when)
            return
        self.target[c] = onward
        self.shared[onward] += 1
        self.left[c], self.made[c] = a, when
        self.gone.setdefault((self._own(a, hit, when), b), when)

    def _own(self, a: int, hit: int, when: int) -> int:
        if self.shared[hit] > 1:
            self.shared[hit] -= 1
            self.parent.append(hit)
            self.copied.append(when)
            self.target[a] = hit = len(self.parent) - 1
            self.shared[hit] = 1
        return hit

    def _arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``: no gadget took it, or what it was made from, in its time."""
        until = len(self.made) + 10**9
        while True:
            s, limit = state, until
            while s >= 0:
                t = self.gone.get((s, token))
                if t is not None and t <= limit:
                    return False
                limit, s = min(limit, self.copied[s] - 1), self.parent[s]
            if token not in self.left:
                return True
            until, token = self.made[token], self.left[token]

    def encode_word(self, word: bytes) -> list[int]:
        of, target = self.of, self.target
        whole = len(word)
        last, state = [0] * (whole + 1), [0] * (whole + 1)
        for i in range(1, whole + 1):
            for j in range(max(0, i - self.longest), i):
                token = of.get(word[j:i])
                if token is not None and (j == 0 or self._arc(state[j], token)):
                    last[i], state[i] = token, target[token]
                    break
        out, i = [], whole
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return out[::-1]

    def _compile_trie(self) -> None:
        """Tokens' bytes as one transition table: (node, byte) -> node by open addressing, and each node's token."""
        step: dict[int, int] = {}
        token_at = [-1]
        for word, token in self.of.items():
            node = 0
            for byte in word:
                key = node << 8 | byte
                if key not in step:
                    step[key] = len(token_at)
                    token_at.append(-1)
                node = step[key]
            token_at[node] = token
        self.token_at = np.array(token_at, "i8")
        self.steps = Hashed(np.fromiter(step, "i8", len(step)), np.fromiter(step.values(), "i8", len(step)))

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`_arc` for many at a time; the answers stay in a table of fixed size until others take their slots."""
        keys = state << 20 | token
        slot = ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - ARC_BITS)).astype("i8")
        ok = self.arc_ok[slot]
        new = np.flatnonzero(self.arc_key[slot] != keys)
        if new.size:
            few, first, at = np.unique(keys[new], return_index=True, return_inverse=True)
            found = np.array([self._arc(k >> 20, k & 0xFFFFF) for k in few.tolist()], bool)
            ok[new] = found[at]
            slot = slot[new[first]]
            self.arc_key[slot], self.arc_ok[slot] = few, found
        return ok

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words, all words one position further at a time."""
        out: list[np.ndarray] = [np.zeros(0, "i4")] * len(words)
        size = np.fromiter(map(len, words), "i8", len(words))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = np.array(self.encode_word(words[i]), "i4")
        order = np.flatnonzero((size > 0) & (size <= LONG))
        order = order[np.argsort(size[order], kind="stable")]
        while order.size:
            # As many words, the longest first, as their places fit.
            width = int(size[order[-1]])
            rows = max(1, CELLS // (width * width))
            group, order = order[-rows:], order[:-rows]
            for i, ids in zip(group.tolist(), self._group([words[i] for i in group.tolist()], size[group], width), strict=True):
                out[i] = ids
        return out

    def _group(self, words: list[bytes], size: np.ndarray, width: int) -> list[np.ndarray]:
        rows = len(words)
        text = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), "u1").reshape(-1, width).astype("i8")
        found = []  # the tokens from j to i
        row, start = np.nonzero(np.arange(width) < size[:, None])
        node = np.zeros(row.size, "i8")
        for n in range(width):
            inside = start + n < size[row]
            row, start, node = row[inside], start[inside], node[inside]
            node = self.steps.get(node << 8 | text[row, start + n])
            alive = node >= 0
            row, start, node = row[alive], start[alive], node[alive]
            if not row.size:
                break
            token = self.token_at[node]
            has = token >= 0
            found.append((row[has], start[has], np.full(int(has.sum()), n + 1), token[has]))
        row, start, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((start, row, start + length))
        row, start, token, end = row[by], start[by], token[by], (start + length)[by]
        edges = np.searchsorted(end, np.arange(1, width + 2))
        last, state, source = (np.zeros((rows, width + 1), "i8") for _ in range(3))
        for i in range(1, width + 1):
            r, j, t = (x[edges[i - 1] : edges[i]] for x in (row, start, token))
            while r.size:  # of every word the longest token that is left; just one is accepted
                first = np.concatenate([[True], r[1:] != r[:-1]])
                one, begin, label = r[first], j[first], t[first]
                ok = begin == 0
                ok[~ok] = self._arcs(state[one[~ok], begin[~ok]], label[~ok])
                last[one[ok], i], source[one[ok], i], state[one[ok], i] = label[ok], begin[ok], self.starts[label[ok]]
                rest = ~first & ~np.isin(r, one[ok])
                r, j, t = r[rest], j[rest], t[rest]
        # Back from the ends, all words at a time.
        at, row, steps = size.copy(), np.arange(rows), []
        while row.size:
            steps.append((row, last[row, at]))
            at = source[row, at]
            row, at = row[at > 0], at[at > 0]
        row, ids = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        by = np.argsort(row, kind="stable")
        return np.split(ids[by].astype("i4"), np.searchsorted(row[by], np.arange(1, rows)))

    def decode(self, ids) -> bytes:
        return b"".join([self.label.get(i, b"") for i in ids])


class Codec:
    """An automaton with the splitting of texts around it and a table of words met before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})
        self.special = self.automaton.special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = re.compile(LATIN_SPLIT).findall
        self.known = Table(self._learn, ("i4", "u1"))
        self.exact = None
        self.path = path

    def _learn(self, new: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of words, and the labels on their arcs."""
        ids = self.automaton.encode_words([b"" if w in self.special else w.encode() for w in new])
        ids = [np.array([self.special[w]], "i4") if w in self.special else i for w, i in zip(new, ids, strict=True)]
        sizes = np.fromiter(map(len, ids), "i8", len(ids))
        ids = np.concatenate(ids)
        labels = [self.automaton.label[i] for i in ids.tolist()]
        length = np.concatenate([[0], np.cumsum(np.fromiter(map(len, labels), "i8", len(labels)))])
        ends = length[np.cumsum(sizes)]
        return [(ids, sizes), (np.frombuffer(b"".join(labels), "u1"), np.diff(ends, prepend=0))]

    def _words(self, text: str) -> list[str]:
        """Words of a text; where characters' classes may differ between Unicode versions, by the file's own splitter."""
        if any(m in text for m in self.special):
            return [w for x in self.marks.split(text) if x for w in ([x] if x in self.special else self._words(x))]
        if not latin_rest(text):
            return self.split(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, where each text's begin and end), and the same of the bytes on their arcs."""
        parts = [self._words(t) for t in texts]
        places, words = self.known.places(parts), np.cumsum([0, *map(len, parts)])
        out = []
        for flat in self.known.flat:
            values, ends = flat.gather(places)
            out.append((values, np.concatenate([[0], ends])[words]))
        return out

    def forget(self) -> None:
        self.known.forget()

    def decode(self, ids: np.ndarray) -> str:
        return self.automaton.decode(ids.tolist()).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, text: str | Column = "text", *, decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` array<int>, and with ``decoded`` string (the arcs' labels) if asked for.

    Null texts count as empty (no ids).  Other columns pass unchanged, whatever
    their values; a column named like an added one is replaced.  Rows are
    independent: no shuffle, memory is bounded by one slice of rows.
    ``vocabulary`` is a file that every executor can open.
    """
    keep, own = [c for c in df.columns if c not in {"ids", "decoded"}], f"_text{uuid.uuid4().hex}"
    shaped = df.select(*map(named, keep), F.coalesce(named(text) if isinstance(text, str) else text, F.lit("")).alias(own))
    out = df.select(*map(named, keep)).withColumn("ids", F.array().cast("array<int>"))
    out = out.withColumn("decoded", F.lit("")) if decoded else out

    def run(batches):
        c = codec(vocabulary)
        try:
            for b in slices(batches):
                (ids, ends), (labels, bounds) = c.encode_all(b.column(own).to_pylist())
                cols = [b.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids))]
                if decoded:
                    data = labels.tobytes()
                    cols.append(pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", *["decoded"] * decoded])
        finally:
            c.forget()

    return mapped(shaped, run, out.schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the labels of ``ids``; null gives an empty text, unknown ids nothing."""
    keep = [c for c in df.columns if c != "decoded"]

    def run(batches):
        c = codec(vocabulary)
        for b in slices(batches):
            texts = [c.decode(np.array(x or [], "int64")) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    kept = df.select(*map(named, keep))
    return mapped(kept, run, kept.withColumn("decoded", F.lit("")).schema)
