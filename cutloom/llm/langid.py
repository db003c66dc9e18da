"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +-1.  An n-gram's vector binds (multiplies)
its letters' vectors, each rotated once more for every later position; a text's
vector bundles (adds) its n-grams' vectors, a language's prototype bundles the
unit vectors of its texts.  A text gets the language with the largest cosine.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import mapped, named

#: N-gram vectors kept per Python worker; a full table starts anew, results don't change.
KEPT = 40_000
#: Letter vectors kept.
KEPT_LETTERS = 4096
#: What stands for every run of characters that are no letters.
BLANK = 32
#: Partial sums are added as whole numbers, so that their order doesn't matter.
SCALE = 1 << 24


def _letters() -> np.ndarray:
    """Every code point's letter: itself, or a blank if it is none."""
    points = np.arange(0x110000)
    return np.where([chr(p).isalpha() for p in range(0x110000)], points, BLANK)


class Space:
    """The vectors of letters and n-grams, made when first met; what stays is bounded."""

    def __init__(self, dimensions: int, n: int, seed: int):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letter_of = _letters()
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((0, self.dimensions), "i1")
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) >= KEPT_LETTERS:
                self.letters.clear()
            random = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.letters[point] = (2 * random.integers(0, 2, self.dimensions) - 1).astype("i1")
        return self.letters[point]

    def rows(self, codes: list[int]) -> list[int]:
        known = self.row
        if len(known) + len(codes) > KEPT:
            known.clear()
        new = [c for c in codes if c not in known]
        if len(known) + len(new) > len(self.vectors):
            more = np.zeros((min(KEPT + len(codes), 2 * (len(known) + len(new))), self.dimensions), "i1")
            more[: len(self.vectors)] = self.vectors
            self.vectors = more
        for c in new:
            vector = np.ones(self.dimensions, "i1")
            for k in range(self.n):  # the last letter stands lowest
                vector = vector * np.roll(self.letter(c >> 21 * k & 0x1FFFFF), k)
            self.vectors[len(known)] = vector
            known[c] = len(known)
        return [known[c] for c in codes]

    def text(self, text: str) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter."""
        at = self.letter_of[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        at = np.concatenate([[BLANK], at, [BLANK]])
        at = at[(at != BLANK) | np.concatenate([[True], at[:-1] != BLANK])]
        if at.size < 2:
            return None
        if at.size < self.n:
            at = np.concatenate([at, np.full(self.n - at.size, BLANK)])
        codes = at[: at.size - self.n + 1]
        for k in range(1, self.n):
            codes = codes << 21 | at[k : at.size - self.n + 1 + k]
        codes, counts = np.unique(codes, return_counts=True)
        total = np.zeros(self.dimensions, "f4")
        for i in range(0, codes.size, 4096):
            rows = self.rows(codes[i : i + 4096].tolist())
            total += counts[i : i + 4096].astype("f4") @ self.vectors[rows].astype("f4")
        size = float(np.sqrt(np.dot(total, total)))
        return total / size if size else total


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes of the learned languages, in the order of their names."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    dimensions: int
    n: int
    seed: int


_SPACES: dict[tuple, Space] = {}


def _space(*key) -> Space:
    if key not in _SPACES:
        _SPACES[key] = Space(*key)
    return _SPACES[key]


def fit(
    df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 4000,
    most_languages: int = 1000, dimensions: int = 1024, n: int = 3, seed: int = 7,
) -> Profiles:
    """Learns prototypes from the labelled rows of ``df`` (null labels and texts are left out).

    A bounded sample is enough for them: of a language with more rows than
    ``rows_per_language`` about that many, chosen by a hash of ``key`` and the
    text, are used; so neither missing ids nor copies are chosen all at once.  More than ``most_languages`` different labels are no languages but
    a wrong column, and an error; what comes to the driver is at most that many
    prototypes.  ``n`` is 3 at most, as an n-gram is one number of 64 bits.
    """
    known = df.filter(named(lang).isNotNull() & named(text).isNotNull())
    per = known.groupBy(named(lang).alias("_lang")).agg(F.count("*").alias("_n"))
    found = per.limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    bound = {r["_lang"]: min(1.0, rows_per_language / r["_n"]) for r in found}
    if not bound:
        return Profiles((), np.zeros((0, dimensions), "f4"), dimensions, n, seed)
    pairs = [x for k, v in bound.items() for x in (F.lit(k), F.lit(v))]
    share = F.element_at(F.create_map(*pairs), named(lang))
    chosen = known.filter(F.pmod(F.xxhash64(named(key), named(text)), F.lit(1_000_003)) < share * 1_000_003)

    def run(batches):
        space, sums = _space(dimensions, n, seed), {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = space.text(t)
                if v is not None:
                    sums.setdefault(k, np.zeros(dimensions, "i8"))
                    sums[k] += np.rint(v.astype("f8") * SCALE).astype("i8")
        space.forget()
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * dimensions), pa.array(np.arange(dimensions, dtype="i4")), pa.array(v)], names=["lang", "dim", "v"]
            )

    parts = chosen.select(named(lang).cast("string"), named(text)).mapInArrow(run, "lang string, dim int, v bigint")
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect():  # languages x dimensions
        sums.setdefault(r["lang"], np.zeros(dimensions))[r["dim"]] = r["v"]
    names = tuple(sorted(sums))
    vectors = np.array([sums[k] / (np.linalg.norm(sums[k]) or 1) for k in names], "f4").reshape(-1, dimensions)
    return Profiles(names, vectors, dimensions, n, seed)


def predict(df: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the cosine, from 0 to 1).

    Null texts, texts without a letter, and all texts if no language was
    learned are ``und`` with score 0.  Equal cosines go to the first name.
    Columns of these names are replaced, all others pass unchanged.
    """
    keep, own = [c for c in df.columns if c not in {"lang_pred", "score"}], f"_text{uuid.uuid4().hex}"
    schema = df.select(*map(named, keep)).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        space = _space(profiles.dimensions, profiles.n, profiles.seed)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                names, scores = [], []
                for t in s.column(own).to_pylist():
                    v = space.text(t) if t and profiles.languages else None
                    cosines = profiles.vectors @ v if v is not None else None
                    best = int(np.argmax(cosines)) if v is not None else -1
                    names.append(profiles.languages[best] if best >= 0 else "und")
                    scores.append(float(min(1.0, max(0.0, cosines[best]))) if best >= 0 else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[s.column(c) for c in range(len(keep))], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*keep, "lang_pred", "score"],
                )
        space.forget()

    return mapped(df.select(*map(named, keep), named(text).alias(own)), run, schema)
