"""Secret scans: the parts of a credential linked by an interval join within scopes.

Base finds stand by themselves: named assignments, access identifiers, long hex
runs.  Weak candidates (an account's name, a vague assignment, a key-like run, an
endpoint) mean little alone, and are reported only where a complementary part
stands within reach in the same scope, a paragraph of the text.

A task finds the parts of each text.  Texts with a weak candidate and a possible
complement are dealt by text and scope, every part with its interval; the join
of a part's interval, widened by the reach, with those of each group of
complements is one sorted pass with running values, so that it never makes
pairs, however many parts a scope holds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cutloom.llm.common import named, written


def _either(words: str) -> str:
    """A pattern whose small letters a-z stand in either case, and no letter of another alphabet counts as one of them."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


def _assigned(words: str, value: str) -> str:
    return f"({_either(words)})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


# Base patterns in their order, then the weak ones.
PATTERNS = {
    "assign": _assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "account": _assigned("username|user|login|account|client_?id|access_?key_?id|access_?key", "[A-Za-z0-9@+/_.-]+"),
    "pass": _assigned("passphrase|passcode|pass|pwd|pin|auth|bearer|credentials|credential|private_?key", "[A-Za-z0-9+/_.=-]+"),
    "host": _assigned("hostname|host|endpoint|server|bucket|region", "[A-Za-z0-9_.:/-]+"),
    "url": "[A-Za-z][A-Za-z0-9+.-]*://[^\\x00-\\x20\"'<>]+",
    "run": "[A-Za-z0-9+/_=-]+",
}
BASE = ("assign", "access", "hex")
RANK = {k: i for i, k in enumerate(PATTERNS)}
#: The least characters: of an assignment's value, else of the whole match.
LEAST = {"assign": 6, "access": 20, "hex": 24, "account": 3, "pass": 4, "host": 4, "url": 1, "run": 16}
#: So many different characters, a letter and a digit make a run a key.
DIFFERENT = 10
#: Groups of parts, and the groups that complement a weak candidate.
GROUPS = {"identifier": ("access", "account"), "endpoint": ("url", "host"), "secret": ("assign", "hex", "pass", "run"), "named": ("assign", "access", "pass")}
COMPLEMENT = {"account": ("secret",), "pass": ("identifier", "endpoint"), "host": ("named",), "url": ("named",), "run": ("identifier",)}
WEAK = tuple(COMPLEMENT)

# What the search itself uses: no match is lost, but texts and places that can't hold one are passed over.
_SEARCH = {k: re.compile(p) for k, p in PATTERNS.items()} | {
    "hex": re.compile("(?<![0-9a-f])[0-9a-f]{24,}"),
    "run": re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"),
    "url": re.compile("(?:(?<=^)|(?<![A-Za-z0-9+.-])|(?<=[0-9+.-]))(?=[A-Za-z])[A-Za-z][A-Za-z0-9+.-]*://[^\\x00-\\x20\"'<>]+"),
}
_HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "account": ("user", "login", "account", "client", "access"),
    "pass": ("pass", "pwd", "pin", "auth", "bearer", "credential", "private"),
    "host": ("host", "endpoint", "server", "bucket", "region"),
    "url": ("://",),
}
_BREAK = re.compile(r"\n[\x20\t\r]*\n")


def _long_enough(kind: str, m: re.Match) -> bool:
    if kind == "run":
        x = m[0]
        return len(set(x)) >= DIFFERENT and any("0" <= c <= "9" for c in x) and any("A" <= c <= "Z" or "a" <= c <= "z" for c in x)
    return len(m[2] if m.re.groups == 2 else m[0]) >= LEAST[kind]


def _matches(text: str, low: str, kind: str) -> list[tuple[int, int, int]]:
    if kind in _HINTS and not any(h in low for h in _HINTS[kind]):
        return []
    return [(m.start(), RANK[kind], m.end()) for m in _SEARCH[kind].finditer(text) if _long_enough(kind, m)]


def _apart(found: list[tuple[int, int, int]], from_: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``found`` that overlap nothing in ``from_``."""
    by_start = sorted((a, b) for a, _, b in from_)
    starts, ends, most = [a for a, _ in by_start], [], 0
    for _, b in by_start:
        ends.append(most := max(most, b))
    # Of what begins before an end, the last end so far tells whether it reaches the start.
    return [m for m in found if not (i := bisect_right(starts, m[2] - 1)) or ends[i - 1] <= m[0]]


def parts(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base finds and the weak candidates of a text: (start, rank, end), sorted."""
    low = text.encode().lower().decode()  # ASCII letters alone, so that places stay
    base = sorted(x for k in BASE for x in _matches(text, low, k))
    weak = _apart([x for k in ("account", "pass", "host") for x in _matches(text, low, k)], base)
    weak += _matches(text, low, "url")
    if base or weak:  # else no complement is there
        weak += _apart(_matches(text, low, "run"), base + weak)
    return base, sorted(weak)


_RANKS = {g: {RANK[k] for k in kinds} for g, kinds in GROUPS.items()}
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_PART = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])
SPANS = "array<struct<start:int,rank:int,end:int>>"


def _scoped(text: str, base: list, weak: list) -> list[tuple[int, int, int, int]]:
    """All parts with their scope, where a weak candidate may have a complement; else none."""
    there = {r for _, r, _ in base + weak}
    if not any(_RANKS[g] & there for k in WEAK if RANK[k] in there for g in COMPLEMENT[k]):
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    return [(a, r, b, bisect_right(breaks, a)) for a, r, b in sorted(base + weak)]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.columns
        for i in range(0, b.num_rows, 64):
            base, scoped = [], []
            for text in texts.slice(i, 64).to_pylist():
                own, weak = parts(text or "")
                base.append(own)
                scoped.append(_scoped(text, own, weak) if weak else [])
            as_structs = lambda rows, kind: pa.array([[dict(zip(kind.names, x, strict=True)) for x in r] for r in rows], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([ids.slice(i, 64), as_structs(base, _SPAN), as_structs(scoped, _PART)], names=["doc_id", "base", "parts"])


def _linked(found: DataFrame, reach: int) -> DataFrame:
    """(row, start, rank, end, partner): the weak candidates that a complement of theirs meets, with the nearest."""
    x = found.filter(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    order = ["start", "rank", "end"]
    scope = W.partitionBy("row", "scope")
    before = scope.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = scope.orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    is_in = lambda g: F.col("rank").isin(*sorted(_RANKS[g]))
    for g in GROUPS:
        x = x.withColumn(f"{g}_before", F.max(F.when(is_in(g), F.struct("end", "start"))).over(before))
    for g in GROUPS:
        x = x.withColumn(f"{g}_after", F.min(F.when(is_in(g), F.struct("start", "end"))).over(after))

    def partner(g: str) -> list[Column]:
        behind = F.greatest(F.col("start") - F.col(f"{g}_before.end"), F.lit(0))
        ahead = F.greatest(F.col(f"{g}_after.start") - F.col("end"), F.lit(0))
        both = ((behind, f"{g}_before"), (ahead, f"{g}_after"))
        return [F.when(F.col(c).isNotNull() & (d <= reach), F.struct(d.alias("distance"), F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"))) for d, c in both]

    nearest = F.lit(None)
    for kind, groups in COMPLEMENT.items():
        nearest = F.when(F.col("rank") == RANK[kind], F.least(*[p for g in groups for p in partner(g)])).otherwise(nearest)
    return x.withColumn("partner", nearest).filter("partner is not null").select("row", *order, "partner")


def find(df: DataFrame, *, reach: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, base, spans, links.

    ``base`` are the base finds, ``spans`` these and the weak candidates with a
    complement at most ``reach`` characters away in their paragraph; both are
    arrays of (start, rank, end) by start, places in code points, end
    exclusive; ``rank`` counts the kinds of :data:`PATTERNS`.  ``links`` says
    for each weak span where its nearest complement stands.  Weak assignments
    in a base find aren't candidates, nor are runs in any other part.
    A null text is empty; null and repeated ids stay as they are, since each
    row is scanned on its own, whatever its copies; an empty table gives an
    empty one; other columns are ignored.
    """
    rows = df.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {SPANS}, parts array<struct<start:int,rank:int,end:int,scope:int>>"
    found = written(rows.mapInArrow(_found, schema).withColumn("row", F.monotonically_increasing_id()))
    span = F.struct("start", "rank", "end")
    more = _linked(found, reach).groupBy("row").agg(
        F.collect_list(span).alias("weak"),
        F.sort_array(F.collect_list(F.struct("start", "rank", "end", F.col("partner.start").alias("partner_start"), F.col("partner.end").alias("partner_end")))).alias("links"),
    )
    # A weak span's row has parts; all others need no join.
    plain = found.filter(F.size("parts") == 0).select("doc_id", "base", F.col("base").alias("spans"))
    joined = found.filter(F.size("parts") > 0).join(more, "row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("weak", F.array().cast(SPANS))))
    return joined.select("doc_id", "base", spans.alias("spans"), "links").unionByName(plain, allowMissingColumns=True).withColumn(
        "links", F.coalesce("links", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,partner_start:int,partner_end:int>>)"))
    )


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
