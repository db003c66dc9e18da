"""Filter interaction audit: what every order of filters removes, and what each filter alone is worth.

A row's failed filters are the bits of its mask, and rows are counted per part
and mask: the cells.  A recursive CTE starts with the empty prefix of every
possible mask and extends prefixes by letters not used yet; it carries the bits
applied so far, joins each level with the mask cells and emits what the step
does to a cell: keep, remove, or find it removed already.  The recursion is of
fixed size (its rows depend on the number of filters alone) and meets the
counted cells once; no row of the table is touched twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cutloom.llm.common import named, written

# When a text fails a filter, by the text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that fails a text which a smaller id has, too.
COPIES = "E"
BLANK = r"[\x20\x09-\x0D]+"
#: 2**n masks times the prefixes of n letters must stay below the recursion's limit of rows.
MOST_FILTERS = 6


def _masks(df: DataFrame, filters: dict[str, Callable], bits: dict[str, int], part: str, text: str, doc_id: str) -> DataFrame:
    """(doc_id, part, digest, mask, n): equal rows counted, without the bit for copies."""
    t = F.coalesce(named(text), F.lit(""))
    rows = df.select(named(doc_id).cast("bigint").alias("doc_id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bits[k]).otherwise(0) for k, fails in filters.items()), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def _flags(labels: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, good, toxic), once per id: labelled so by any of its rows."""
    is_one = lambda c: F.coalesce(F.max(named(c) == 1), F.lit(False))
    return (
        labels.filter(named(doc_id).isNotNull())
        .groupBy(named(doc_id).cast("bigint").alias("doc_id"))
        .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
        .filter("good or toxic")
    )


def cells(
    docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable] = FILTERS, copies: str | None = COPIES,
    part: str = "source", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(part, mask, n, good, toxic): the rows of every part by the filters that they fail.

    Filters' bits go by their letters' order.  A copy is a row whose text a row
    with a smaller id has, anywhere in the table; without an id a row is none,
    and rows of one id aren't copies of each other.  Texts are compared by
    their 256-bit digests, copies are counted before and after the shuffle by
    digest, so a text that a third of the rows share is one row per part there.
    """
    bits = {k: 1 << i for i, k in enumerate(sorted([*filters, *([copies] if copies else [])]))}
    rows = written(_masks(docs, filters, bits, part, text, doc_id))
    known = rows.filter("doc_id is not null").join(_flags(labels, doc_id), "doc_id", "left")
    known = known.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True).fillna(False, ["good", "toxic"])
    alike = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    low = F.min("first.doc_id").over(W.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("first.doc_id") == low, F.col("first.n")).otherwise(0)
    bit = F.lit(bits[copies] if copies else 0)
    both = F.array(F.struct("mask", F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    return (
        alike.withColumn("own", own)
        .select("part", "good", "toxic", F.explode(both).alias("x"))
        .filter("x.n > 0")
        .groupBy("part", F.col("x.mask").alias("mask"))
        .agg(
            F.sum("x.n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("good"), F.col("x.n"))), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.when(F.col("toxic"), F.col("x.n"))), F.lit(0)).alias("toxic"),
        )
    )


def steps(spark, letters: str) -> DataFrame:
    """(prefix, step, letter, bit, mask, keeps, removes, redundant): every prefix of every order, for every mask.

    ``rest`` is the number of full orders that begin with the prefix.
    """
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, for all orders of {len(letters)} are too many")
    values = ", ".join(f"('{k}', {1 << i})" for i, k in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {values}),
        mask_cells(mask) AS (SELECT CAST(id AS INT) FROM range({1 << len(letters)})),
        prefixes(prefix, applied, step, letter, bit, mask, keeps, removes, redundant) AS (
          SELECT CAST('' AS STRING), 0, 0, CAST('' AS STRING), 0, mask, true, false, false FROM mask_cells
          UNION ALL
          SELECT concat(p.prefix, l.letter), p.applied | l.bit, p.step + 1, l.letter, l.bit, c.mask,
            c.mask & (p.applied | l.bit) = 0,
            c.mask & l.bit != 0 AND c.mask & p.applied = 0,
            c.mask & l.bit != 0 AND c.mask & p.applied != 0
          FROM prefixes p JOIN letters l ON p.applied & l.bit = 0 JOIN mask_cells c ON p.mask = c.mask
        )
        SELECT prefix, step, letter, bit, mask, keeps, removes, redundant, CAST(factorial({len(letters)} - step) AS BIGINT) AS rest
        FROM prefixes WHERE step > 0
    """)


def audit(
    docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable] = FILTERS, copies: str | None = COPIES,
    part: str = "source", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` maps letters to conditions under which a text fails, by the text
    and its words; ``copies`` is the letter of the filter against repeated texts
    (see :func:`cells`), or None.  Null texts are empty, a null part is the
    empty string, so it is one part with rows whose part is empty.  Repeated
    rows count each.  Labels without id label nothing; an id with several
    labels is good or toxic if any of them says so.  An empty table gives no
    row.  Other columns are ignored, whatever their names.
    """
    letters = "".join(sorted([*filters, *([copies] if copies else [])]))
    counted = cells(docs, labels, filters=filters, copies=copies, part=part, text=text, doc_id=doc_id)
    plan = steps(docs.sparkSession, letters)
    total = lambda flag, n: F.coalesce(F.sum(F.when(flag, F.col(n))), F.lit(0))
    # The plan's rows are bounded by the number of filters, never by the data.
    levels = (
        counted.join(F.broadcast(plan), "mask")
        .groupBy("part", "prefix", "step", "letter", "rest")
        .agg(
            total(F.col("keeps"), "n").alias("kept"),
            total(F.col("removes"), "n").alias("removed"),
            total(F.col("redundant"), "n").alias("redundant"),
            total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
            total(F.col("removes"), "good").alias("good_lost"),
            total(F.col("removes"), "toxic").alias("toxic_lost"),
        )
        .withColumn("shapley", F.sum(F.col("removed") * F.col("rest")).over(W.partitionBy("part", "letter")))
    )
    orders = plan.filter((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("length")
    )
    orders = orders.select("filter_order", F.expr("substring(filter_order, 1, length)").alias("prefix"))
    return levels.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
