"""Which of five filters removes what, in every order in which they can be applied.

A document fails some of the filters: a mask of five bits.  All 120 orders depend on nothing but the
number of documents of each mask, so a part of the corpus is 32 numbers for each label.  They are
gathered as the 32 Walsh-Hadamard sums, the documents counted with the sign of the parity of
``mask & s``; the transform is its own inverse up to a factor of 32, which divides exactly.  Sums of
the transform add up like counts do, so partial sums are made where the rows are.

Filters A to D look at the text alone.  E asks whether a smaller id has the same text: rows of one text
agree on A to D, and the row that passes E is found by the text's digest and the least id under it.
Only digests, ids and masks are shuffled; a group of copies of any size is met by its id as well as
by its digest, never gathered.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, id_in

LETTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(LETTERS))
CELLS = 1 << len(LETTERS)


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: few words, repetitive, capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    checks = (
        F.size(words) < 50,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        capitals * 100 > F.length(text) * 5,
        text.rlike(r"[#$%&*|]"),
    )
    return sum((c.cast("int") * (1 << k) for k, c in enumerate(checks)), F.lit(0))


def sign(mask: Column, s: int | Column) -> Column:
    """1 where ``mask & s`` has an even number of bits, otherwise -1."""
    return F.lit(1) - F.bit_count(mask.bitwiseAND(s)).bitwiseAND(F.lit(1)) * 2


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every document; see ``audit``."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(id_in("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"))
    facts = checkpointed(facts)
    first = facts.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = facts.join(first, ["sha", "doc_id"], "left").withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + (1 << 4)))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    labelled = known.filter(F.col("doc_id") != NO_ID).join(marked, "doc_id", "left").select("part", "mask", of("good"), of("toxic"))
    return labelled.unionByName(known.filter(F.col("doc_id") == NO_ID).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, good, toxic and ``sums``, the 32 signed sums of the masks."""
    each = [F.sum(sign(F.col("mask"), F.lit(s)).cast("long")).alias(f"s{s}") for s in range(CELLS)]
    return rows.groupBy("part", "good", "toxic").agg(*each).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(CELLS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """Number of rows of each mask, from the signed sums."""
    domain = F.sequence(F.lit(0), F.lit(CELLS - 1))
    turned = lambda m: F.aggregate(domain, F.lit(0).cast("long"), lambda acc, s: acc + F.element_at(sums, s + 1) * sign(m, s))
    return F.transform(domain, lambda m: F.shiftright(turned(m), 5))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: see the columns below.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic.  Null texts are empty and
    a null source is the part ''.  A null id is below all others and has no label; rows that share the
    least id of a text all pass E.  A document that is labelled twice is good, or toxic, if any of its
    labels says so.  Repeated rows count each; no documents give no rows.
    """
    summed = parity_sums(masks(docs, labels))
    of = lambda when: F.array(*[F.coalesce(F.sum(F.when(when, F.element_at("sums", s + 1))), F.lit(0)) for s in range(CELLS)])
    parts = summed.groupBy("part").agg(of(F.lit(True)).alias("all"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))
    parts = parts.select("part", *[cells(F.col(c)).alias(c) for c in ("all", "good", "toxic")])
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    bit_at = lambda at: F.expr(f"shiftleft(1, instr('{LETTERS}', substr(filter_order, {at}, 1)) - 1)")
    steps = steps.withColumn("own", bit_at("step")).withColumn("before", sum((F.when(F.col("step") > j, bit_at(j)).otherwise(0) for j in range(1, 5)), F.lit(0)))

    def over(counts: str, when, weight=lambda m: F.lit(1)) -> Column:
        """Sum of the counts of the masks that ``when`` picks."""
        summed = lambda acc, m: acc + F.when(when(m), F.element_at(counts, m + 1) * weight(m)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), summed)

    # of the orders, a document that fails k filters is removed by each of them in 120 / k
    shares = F.array(*[F.lit(len(ORDERS) // max(1, m.bit_count())).cast("long") for m in range(CELLS)])
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    reached = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: fails(m) & reached(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        over("all", lambda m: reached(m) & ~fails(m)).alias("kept"),
        over("all", removed).alias("removed"),
        over("all", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        over("all", lambda m: m == F.col("own")).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("all", fails, lambda m: F.element_at(shares, m + 1)).alias("shapley"),
    )
