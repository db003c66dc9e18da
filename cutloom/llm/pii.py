"""Personal data: patterns, and terms that disclose it by information content.

Base entities (email, ip, card, phone) are found by patterns.  Secrets are
further protected entities: long runs of key characters whose information
content, by the frequencies of their own characters, is that of a random key.
Over the corpus, a term's co-occurrence with a kind of entity estimates how
strongly it reveals that one stood there: the pointwise mutual information
PMI(t; k) as a share of the kind's information content IC(k) = -log2 p(k).
Terms whose share reaches the disclosure threshold are spans of kind ``term``
wherever they stand.  :func:`sanitise` generalises all spans.  DataFrame
operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm.common import dropped, named, written

# What base entities look like, in their order.  Each pattern is
# the plain one with marks that spare the search dead ends: a match can only
# begin where a run of its characters begins or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
RANK = {k: i for i, k in enumerate([*PATTERNS, "secret", "term"])}
#: The least information of a secret's characters, in bits all and each.
SECRET_BITS, CHARACTER_BITS = 64.0, 3.0
WORD = r"[A-Za-z\x80-\x{10FFFF}]++"
NO_WORD = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
#: Bits of the filter of terms, a megabyte whatever the vocabulary; it spares work and decides nothing.
FILTER_BITS = 1 << 23
#: Matches summed up in one go; keeps the work on texts with very many of them linear.
STEP = 256


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with places in code points: array of (start, rank, end, kind, text)."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    empty = F.array().cast(FOUND)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        row = F.struct(start.alias("start"), F.lit(RANK[kind]).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def block(at: Column, x: Column) -> Column:
        return F.aggregate(x, F.struct(at.alias("at"), empty.alias("out")), one)["out"]

    def more(acc: Column, x: Column) -> Column:
        at = F.coalesce(F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(-1))["end"], F.lit(0))
        return F.concat(acc, F.array(block(at, x)))

    n = F.size(hits)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda i: F.slice(both, i * STEP + 1, F.least(F.lit(STEP), n - i * STEP)))
    start = F.array().cast(f"array<{FOUND}>")
    return F.when(n > 0, F.flatten(F.aggregate(blocks, start, more))).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: ~F.exists(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) > 3) | (F.right(p, F.lit(9)).cast("int") > 255)),
    "card": lambda x: (F.length(_digits(x)).between(14, 19)) & _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}
#: What a text must hold for a pattern to be tried.
HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike("[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _bits(x: Column) -> Column:
    """Information of a string's characters in bits, by their frequencies in it."""
    size = F.length(x)
    counts = F.transform(F.array_distinct(F.split(x, "")), lambda c: F.when(c == "", F.lit(0)).otherwise(size - F.length(F.replace(x, c))))
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.when(n > 0, -n * F.log2(n / size)).otherwise(F.lit(0.0)))


def secret_spans(text: Column) -> Column:
    """Runs of key characters with letters and digits that are as surprising as a random key."""
    ok = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (_bits(x) >= F.greatest(F.lit(SECRET_BITS), CHARACTER_BITS * F.length(x)))
    found = F.filter(_matches(text, SECRET, "secret"), lambda m: ok(m["hit"]))
    found = F.transform(found, lambda m: F.struct(m["start"], m["rank"], m["end"], m["kind"]))
    return F.when(text.rlike("[A-Za-z0-9_+/=-]{20}"), found).otherwise(F.array().cast(SPANS))


def _apart(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))


def base_spans(text: Column) -> Column:
    """The base entities of a text, by start, then kind."""
    none = F.array().cast(SPANS)
    found = []
    for kind, pattern in PATTERNS.items():
        found.append(F.when(HINT[kind](text), _valid(text, pattern, kind)).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*found))).otherwise(none)


def _valid(text: Column, pattern: str, kind: str) -> Column:
    kept = F.filter(_matches(text, pattern, kind), lambda m: VALID[kind](m["hit"]))
    return F.transform(kept, lambda m: F.struct(m["start"], m["rank"], m["end"], m["kind"]))


def _place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FILTER_BITS))


def _may_hold(terms: DataFrame, term: Column) -> Column:
    """False only for terms that ``terms`` doesn't hold: a bit for each hash, one row of fixed size that every task reads."""
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    some = terms.select(_place(F.col("term")).alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(bit).alias("b"))
    every = terms.sparkSession.range(FILTER_BITS // 64).join(some, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")).alias("x"))
    bits = every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]).alias("bits")).scalar()
    return F.getbit(F.get(bits, F.shiftright(_place(term), 6).cast("int")), (_place(term) % 64).cast("int")) == 1


def disclosing_terms(df: DataFrame, *, text: str = "text", threshold: float = 0.9, support: int = 5) -> DataFrame:
    """(term, kind, share): terms whose PMI with a kind of entity is at least ``threshold`` of its information content.

    The corpus is its different lines: p(term), p(kind) and p(term, kind) are
    shares of them, so copies of a line or a document say nothing new.  Fewer
    than ``support`` lines with both, or fewer than ``support`` different texts
    that hold such lines, are no evidence.
    """
    body = F.coalesce(named(text), F.lit(""))
    lines = df.select(body.alias("body")).select(F.xxhash64("body").alias("of"), F.explode(F.split("body", "\n")).alias("line"))
    hinted = lines.filter(F.col("line").rlike("[0-9@]"))
    blank = F.col("line")
    for pattern in [*PATTERNS.values(), SECRET]:
        blank = F.regexp_replace(blank, pattern, " ")
    spans = F.concat(base_spans(F.col("line")), secret_spans(F.col("line")))
    # The empty term stands for any: it counts the kind's lines.
    terms = F.array_union(F.filter(F.array_distinct(F.split(F.lower(blank), NO_WORD)), lambda t: F.length(t) >= 3), F.array(F.lit("")))
    near = written(
        hinted.withColumn("kinds", F.array_distinct(F.transform(spans, lambda s: s["kind"])))
        .filter(F.size("kinds") > 0)
        .select("of", F.unhex(F.md5("line")).alias("line"), "kinds", terms.alias("terms"))
    )
    pairs = lambda rows, *keep: rows.select(*keep, "kinds", F.explode("terms").alias("term")).select(*keep, F.explode("kinds").alias("kind"), "term")
    both = written(pairs(near.dropDuplicates(["line"])).groupBy("term", "kind").agg(F.count("*").alias("both")).filter(F.col("both") >= support))
    kinds = both.filter("term = ''").select("kind", F.col("both").alias("of_kind"))
    words = F.array_union(F.array_distinct(F.split(F.lower("line"), NO_WORD)), F.array(F.lit("")))
    # Counted before the join, as only counts combine before a shuffle.
    # Terms that surely have no pairs are passed over before they are counted; most of a vocabulary is rare.
    often = lines.filter("line <> ''").select("line").distinct().select(F.explode(words).alias("term"))
    often = often.filter(_may_hold(both, F.col("term"))).groupBy("term").agg(F.count("*").alias("n"))
    # An inner join: a semi join would be moved below the counts, and every word of the corpus shuffled.
    often = written(often.join(both.select("term").distinct(), "term"))
    total = often.filter("term = ''").select(F.col("n").alias("total"))
    p_kind = F.col("of_kind") / F.col("total")
    given = F.least(F.lit(1.0), F.col("both") / F.col("n"))
    share = F.when(p_kind < 1, 1 + F.log2(given) / -F.log2(p_kind)).otherwise(F.lit(0.0))
    likely = written(
        both.filter("term <> ''")
        .join(often, "term")
        .join(F.broadcast(kinds), "kind")  # one row per kind
        .join(F.broadcast(total))  # one row
        .select("term", "kind", share.alias("share"))
        .filter(F.col("share") >= threshold)
    )
    texts = pairs(near, "of").join(likely, ["term", "kind"]).groupBy("term", "kind", "share").agg(F.count_distinct("of").alias("texts"))
    out = written(texts.filter(F.col("texts") >= support).select("term", "kind", "share"))
    for used in (near, both, often, likely):
        dropped(used)
    return out


def find(df: DataFrame, *, text: str = "text", threshold: float = 0.9, support: int = 5) -> DataFrame:
    """``df`` with ``base`` and ``spans``: the base entities, and these with secrets and disclosing terms.

    Spans are structs (start, rank, end, kind) in code points, end exclusive,
    by start and then kind; a secret never overlaps a base entity, a term none
    of the others.  Every document that holds a disclosing term has it as a
    span, with or without an entity.  Null texts count as empty.  Every row is
    judged on its own text, so repeated rows and null ids stay; columns of the
    added names are replaced, others pass.
    """
    keep = [c for c in df.columns if c not in {"base", "spans"}]
    row, own = f"_r{uuid.uuid4().hex}", f"_b{uuid.uuid4().hex}"  # names that no column has
    body = F.col(own)
    terms = disclosing_terms(df, text=text, threshold=threshold, support=support)
    held = df.select(F.struct(*map(named, keep)).alias(row), F.coalesce(named(text), F.lit("")).alias(own))
    key = F.struct(F.xxhash64(body).alias("a"), F.md5(body).alias("b"))
    # Which texts hold which terms: a table, so that its size decides how it is joined.
    hits = written(
        held.select(key.alias("key"), F.explode(F.array_distinct(F.split(F.lower(body), NO_WORD))).alias("term"))
        .join(terms.select("term").distinct(), "term")
        .groupBy("key")
        .agg(F.collect_set("term").alias("terms"))
    )
    joined = held.join(hits.select("terms", F.col("key").alias("key")), key == F.col("key"), "left")
    spans = joined.select(row, own, "terms", base_spans(body).alias("base"), secret_spans(body).alias("secrets"))
    spans = spans.select(row, own, "terms", "base", F.when(F.size("secrets") > 0, F.array_sort(F.concat("base", _apart(F.col("secrets"), F.col("base"))))).otherwise(F.col("base")).alias("safe"))
    free = _apart(F.filter(_matches(body, WORD, "term"), lambda m: F.array_contains("terms", F.lower(m["hit"]))), F.col("safe"))
    plain = F.transform(free, lambda m: F.struct(m["start"], m["rank"], m["end"], m["kind"]))
    whole = F.when(F.col("terms").isNull(), F.col("safe")).otherwise(F.sort_array(F.concat("safe", plain)))
    return spans.select(*[F.col(row).getField(c).alias(c) for c in keep], "base", whole.alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(df: DataFrame, *, text: str = "text", threshold: float = 0.9, support: int = 5) -> DataFrame:
    """``df`` with every span of ``text`` generalised to its kind in capitals and brackets.

    Overlapping spans become one, named after the first.  Null texts stay null.
    """
    found = find(df, text=text, threshold=threshold, support=support)
    body = named(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(inside)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))))
    new = F.when(F.size("spans") > 0, done).otherwise(body)
    return found.select(*[new.alias(c) if c == text else named(c) for c in found.columns if c in df.columns])
